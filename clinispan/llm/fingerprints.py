"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, with DataFrame functions alone.

A sketch has CELLS cells in three parts; a digest is added to one cell of each: a count, an exclusive or of digests and one of
their check hashes. Subtracting the sketches of two versions leaves only the digests that differ, and peeling recovers them
from cells that hold one alone. Where that fails, because too many differ, the pair is sketched again, larger: digests are dealt
out to as many sketches as the pair needs, and a sketch that fails once more is made four times as large, as often as it takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import table

#: Cells of a fingerprint and of the largest sketch; rounds of peeling; digests dealt to each of a pair's larger sketches, about.
CELLS, LARGE, ROUNDS, LOAD = 24, 96, 12, 12
#: Ranges of doc_id in which a document's predecessor is looked up.
RANGES = 1024
#: Stands for a null doc_id, and is read as one.
NULL_ID = -(1 << 63)
_CELL = "struct<n:int,k:bigint,c:bigint>"


def paragraph_digests(text: str) -> Column:
    """The distinct digests of a text's paragraphs (the sentences of its non-blank lines); none for null or blank."""
    return F.expr(f"array_distinct(transform(filter(flatten(transform(split({text}, '\\n+'), l -> split(l, '(?<=[.!?])[ ]+'))), p -> trim(p) <> ''), p -> xxhash64(trim(p))))")


def _held(value: str, name: str, body: str) -> str:
    """body, in which name is value, computed once: a fold over nothing, whose last step is body."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, i) -> {name}, {name} -> {body})"


def _signed(digests: str, sign: int, cells: int) -> str:
    """Digests as struct<d, c, n, p0, p1, p2>: digest, check hash, 1 or -1, and the cell of each third that some bits of it name."""
    bits, first, part = {CELLS: 3, LARGE: 5}[cells], 8 if cells == CELLS else 30, cells // 3
    places = ", ".join(f"'p{i}', shiftrightunsigned(d, {bits * i + first}) & {part - 1}L" for i in range(3))
    return f"transform({digests}, d -> named_struct('d', d, 'c', xxhash64(d) & 4294967295L, 'n', {sign}, {places}))"


def _added(signed: str, cells: int, to: str | None = None) -> str:
    """The cells (empty ones without to) with signed digests, which are computed once for all of them, added: each cell takes in one pass those that fall into it."""
    part = cells // 3

    def cell(j: int) -> str:
        start = f"{to}[{j}]" if to else f"cast(named_struct('n', 0, 'k', 0L, 'c', 0L) as {_CELL})"
        return f"aggregate(f, {start}, (s, e) -> if(e.p{j // part} = {j % part}L, named_struct('n', s.n + e.n, 'k', s.k ^ e.d, 'c', s.c ^ e.c), s))"

    return _held(signed, "f", f"array({', '.join(map(cell, range(cells)))})")


def sketch(digests: str, cells: int = CELLS) -> str:
    """SQL for the cells of an array of distinct digests."""
    return _added(_signed(digests, 1, cells), cells)


def difference(x: str, y: str, cells: int = CELLS) -> str:
    """SQL for the sketch of x less that of y: as cells add up, one pass over both."""
    return _added(f"concat({_signed(x, 1, cells)}, {_signed(y, -1, cells)})", cells)


def peeled(cells_sql: str, cells: int = CELLS) -> str:
    """SQL for struct<cells, more, fewer, open>: the cells that peeling leaves, how many digests it finds on the first side alone and on the second, and whether it could go on."""

    def alone(sign: int) -> str:
        return f"array_distinct(transform(filter(u, q -> q.n = {sign}), q -> q.k))"

    pure = "filter(t.cells, q -> (q.n = 1 or q.n = -1) and q.c = (xxhash64(q.k) & 4294967295L))"
    rest = _added(f"concat({_signed('z.p', -1, cells)}, {_signed('z.m', 1, cells)})", cells, "t.cells")
    found = _held(f"named_struct('p', {alone(1)}, 'm', {alone(-1)})", "z", f"named_struct('cells', {rest}, 'more', t.more + size(z.p), 'fewer', t.fewer + size(z.m), 'open', true)")
    step = _held(pure, "u", f"if(size(u) = 0, named_struct('cells', t.cells, 'more', t.more, 'fewer', t.fewer, 'open', false), {found})")
    start = f"named_struct('cells', cast({cells_sql} as array<{_CELL}>), 'more', 0L, 'fewer', 0L, 'open', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (t, r) -> if(t.open, {step}, t))"


def _clean(state: str) -> str:
    return f"forall({state}.cells, q -> q.n = 0 and q.k = 0L and q.c = 0L)"


def fingerprint(cells: str) -> Column:
    """A sketch as text: counts, digests and checks in base 64."""
    return F.translate(F.expr(f"base64(unhex(array_join(transform({cells}, q -> concat(lpad(hex(q.n), 4, '0'), lpad(hex(q.k), 16, '0'), lpad(hex(q.c), 8, '0'))), '')))"), "\r\n", "")


def likeness(n_x: str, n_y: str, more: str, fewer: str) -> Column:
    """Common digests as a share of all, from the sizes of two sets and how many each has alone; 1 for two empty sets."""
    return F.expr(f"case when {n_x} + {fewer} = 0 then 1d else ({n_x} - {more}) / cast({n_x} + {fewer} as double) end")


def sketch_likeness(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key columns and likeness of rows (key, x, y): arrays of distinct digests, compared through sketches.

    key must identify rows. Pairs are first compared by sketches of CELLS cells; those that do not peel are compared in parts, each by CELLS
    cells and then by LARGE. Parts that these leave mixed are hashed anew and dealt out once more, until none is left: every round gives
    their digests other cells, so few outlast two.
    """
    first = table(_compared(pairs.select(*key, "x", "y"), key, F.size("x").alias("nx"), F.size("y").alias("ny")))
    told, hard, made = [first.where("ok").select(*key, "more", "fewer")], first.where("not ok").select(*key, "x", "y"), []
    while True:
        parts = table(_dealt(hard, key, len(made)))
        made.append(parts)
        told.append(parts.where("ok").select(*key, "more", "fewer"))
        hard = parts.where("not ok").select(*key, "x", "y")
        if hard.isEmpty():
            break
    sums = reduce(DataFrame.union, told).groupBy(*key).agg(F.sum("more").alias("more"), F.sum("fewer").alias("fewer"))
    sizes = first.select(*key, "nx", "ny")
    return sizes.join(sums, key, "left").select(*key, likeness("nx", "ny", "coalesce(more, 0)", "coalesce(fewer, 0)").alias("likeness"))


def _compared(pairs: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """pairs (key, x, y) with ok, and more and fewer (digests of x and of y alone) where a sketch of CELLS cells peels; x and y only where not."""
    state = pairs.withColumn("d", F.expr(peeled(difference("x", "y")))).withColumn("ok", F.expr(_clean("d")))
    return state.select(*key, *more, "ok", F.col("d.more").alias("more"), F.col("d.fewer").alias("fewer"), *(F.when(~F.col("ok"), F.col(c)).alias(c) for c in ("x", "y")))


def _dealt(hard: DataFrame, key: list[str], round_: int) -> DataFrame:
    """_compared() for the parts of pairs, of LOAD digests about, by sketches of CELLS cells and then of LARGE. After the first round digests stand for others, hashed by its number."""
    known = hard.withColumns({c: F.expr(f"array_distinct(transform({c}, d -> xxhash64({round_}, d)))") for c in ("x", "y")}) if round_ else hard
    sized = known.withColumn("parts", F.expr(f"cast(ceil((size(x) + size(y)) / {LOAD}.0) as int)"))
    dealt = sized.select(*key, "parts", F.explode(F.expr("concat(transform(x, d -> named_struct('d', d, 'side', 1)), transform(y, d -> named_struct('d', d, 'side', 2)))")).alias("e")).select(*key, F.expr("pmod(shiftrightunsigned(e.d, 17), parts)").alias("part"), "e.d", "e.side")
    parts = dealt.groupBy(*key, "part").agg(F.expr("collect_list(d) filter (where side = 1)").alias("x"), F.expr("collect_list(d) filter (where side = 2)").alias("y"))
    parts = parts.withColumn("s", F.expr(peeled(difference("x", "y"))))
    parts = parts.withColumn("l", F.expr(f"case when not {_clean('s')} then {peeled(difference('x', 'y', LARGE), LARGE)} end"))
    found = [F.expr(f"case when {_clean('s')} then s.{n} when {_clean('l')} then l.{n} end").alias(n) for n in ("more", "fewer")]
    ok = F.expr(f"{_clean('s')} or coalesce({_clean('l')}, false)")
    return parts.withColumn("ok", ok).select(*key, "ok", *found, *(F.when(~F.col("ok"), F.col(c)).alias(c) for c in ("x", "y")))


def _predecessors(docs: DataFrame) -> DataFrame:
    """(o, th) of each document to (o, th, n) of the one before it in the order (o, th); the last one is before the first."""
    ids = table(docs.select("o", "th", "n").distinct())
    edges = ids.agg(F.percentile_approx("o", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("edges")).first()["edges"] or []
    steps = [RANGES >> i for i in range(1, RANGES.bit_length())]
    bounds = ", ".join(f"{int(x)}L" for x in edges) or "0L"
    # Binary search for the number of edges at or under o.
    ids = ids.withColumn("range", F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> if(coalesce(get(array({bounds}), at + step - 1) <= o, false), at + step, at))"))
    me = F.struct("o", "th", "n")
    before = ids.withColumn("before", F.expr("lag(struct(o, th, n)) over (partition by range order by o, th)"))
    ends = ids.groupBy("range").agg(F.max(me).alias("last"))  # RANGES rows at most
    ends = ends.withColumn("before_range", F.expr("coalesce(lag(last) over (order by range), max(last) over ())")).select("range", "before_range")
    both = before.join(F.broadcast(ends), "range").select("o", "th", F.coalesce("before", "before_range").alias("p"))
    return both.select("o", "th", F.col("p.o").alias("po"), F.col("p.th").alias("pth"), F.col("p.n").alias("pn"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text; more columns are left out): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document's, in the
    ascending order of doc_id, null first, then of a hash of the text; after the last comes the first. A null text is empty. Rows equal in
    doc_id and text are one document with as many result rows. A single document is its own next one. Texts without paragraphs have equal, empty fingerprints.
    """
    texts = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("o"), F.xxhash64(texts).alias("th"), texts.alias("text"))
    # Both joins need the same three columns of base, so that its texts are shuffled once.
    linked = base.join(_predecessors(base.withColumn("n", F.length("text").cast("long"))), ["o", "th"]).withColumn("rn", F.expr("row_number() over (partition by o, th order by o)")).where("rn = 1")
    heads = linked.select(F.col("po").alias("o"), F.col("pth").alias("th"), F.expr("substring(text, 1, cast(pn div 4 as int))").alias("head"), paragraph_digests("text").alias("next_units"))
    # Rows equal in doc_id and text are numbered where the join has put them, without another shuffle.
    both = base.join(heads, ["o", "th"]).withColumn("rn", F.expr("row_number() over (partition by o, th order by o)"))
    both = both.withColumn("n", F.length("text").cast("long")).withColumn("doc_id", F.nullif("o", F.lit(NULL_ID)))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n - n div 4 as int)), head)"))
    rows = both.select("o", "th", "rn", "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), paragraph_digests("text").alias("units"), paragraph_digests("edited").alias("edited_units"), "next_units")
    rows = table(rows)
    one = rows.where("rn = 1")
    sides = one.select("o", "th", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("edited_units").alias("y")), F.struct(F.lit(1).alias("w"), F.col("next_units").alias("y")))).alias("s"), F.col("units").alias("x")).select("o", "th", "s.w", "x", "s.y")
    near = sketch_likeness(sides, ["o", "th", "w"])
    near = near.groupBy("o", "th").agg(F.max(F.when(F.col("w") == 0, F.col("likeness"))).alias("near_edited"), F.max(F.when(F.col("w") == 1, F.col("likeness"))).alias("near_next"))
    prints = rows.select("o", "th", "doc_id", "n_chars", "edited_sha256", "units", "edited_units").join(near, ["o", "th"]).withColumns({"a": F.expr(sketch("units")), "b": F.expr(sketch("edited_units"))})
    return prints.select("doc_id", "n_chars", "edited_sha256", fingerprint("a").alias("fingerprint"), fingerprint("b").alias("edited_fingerprint"), "near_edited", "near_next")
