"""Lexicons, sections, scopes and codes as tables, against plain versions and against extraction within a document's row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_behaviour import plain_terms

from clinispan import lexicon
from clinispan.functions import text
from clinispan.operators import evaluate, extract, joins, phrases, rows, terminology, views
from clinispan.plans import queries
from clinispan.sources import notes


def plan(df):
    return df._jdf.queryExecution().toString()


def table(spark, entries, kind="k"):
    return spark.createDataFrame([(kind, p, c, i) for i, (p, c) in enumerate(entries)], phrases.LEXICON)


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_index_finds_what_a_dictionary_finds(spark, limit):
    """Chains, digits, punctuation at the ends, phrases that overlap themselves, letters that are not ASCII; phrases that match nothing."""
    rng = random.Random(4)
    entries = [*lexicon.pairs(lexicon.CONDITION_TERMS), ("é x", "e"), ("x", "x"), ("2", "two"), ("heart heart", "h"), ("-x", "dash"), ("x-", "end"), (", heart", "comma"), ("heart", "other"), ("type 2", "t"), ("a.b", "dots")]
    parts = [p for p, _ in entries] + ["mellitus", "diabetes mellitus", "acquired", "community", "é", ",", "-", "heart", "a", ".b"]
    texts = ["".join(rng.choice(parts) + rng.choice((" ", "  ", "", "-", ", ")) for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, low string")
    odd = [(" x", "blank"), ("", "empty"), (None, "null"), ("x ", "blank")]
    found = phrases.longest_matches(phrases.find_phrases(df, table(spark, [*entries, *odd]), limit=limit), ["i"])
    got = {}
    for r in found.collect():
        got.setdefault(r["i"], []).append((r["s"], r["e"], r["concept"]))
    assert all(sorted(got.get(i, [])) == plain_terms(t, entries) for i, t in enumerate(texts))
    assert len(got) > 300 and len(texts) not in got
    assert phrases.find_phrases(df, table(spark, [])).collect() == [] and phrases.find_phrases(df.limit(0), table(spark, entries)).collect() == []


def test_large_lexicon(spark, sf, tmp_path):
    """A hundred thousand phrases more, many of which begin with one word, change nothing that the package's find; no phrase is in the plan."""
    texts = views.sentences(notes.customer_notes(spark, sf)).select("note_id", "sent_id", F.lower("text").alias("low"))
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    own = table(spark, lexicon.pairs(lexicon.CONDITION_TERMS), "condition")
    more = spark.range(100_000).select(F.lit("more").alias("kind"), F.concat(F.element_at(F.array(F.lit("fever "), F.lit("history of fever "), F.lit("n")), (F.col("id") % 3 + 1).cast("int")), "id").alias("phrase"), F.lit("m").alias("concept"), F.col("id").alias("ord"))
    both = phrases.longest_matches(phrases.find_phrases(texts, own.union(more)), ["note_id", "sent_id", "kind"])
    want = texts.select("note_id", "sent_id", F.inline_outer(text.terms(F.col("low"), text.dictionary(lexicon.pairs(lexicon.CONDITION_TERMS))))).where("s is not null")
    keys = ("note_id", "sent_id", "s", "e", "concept")
    assert sorted(both.where("kind = 'condition'").select(*keys).collect()) == sorted(want.select(*keys).collect())
    shown = plan(both)
    assert "pneumonia" not in shown and "Cartesian" not in shown and "NestedLoop" not in shown


def test_lookup_join_deals_out_hot_keys(spark):
    rng = random.Random(1)
    many = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "z"])) for i in range(3000)]
    one = [("hot", 1), ("a", 2), ("a", 3), ("unused", 4), (None, 5)]
    x, y = spark.createDataFrame(many, "i int, k string"), spark.createDataFrame(one, "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(repr, x.join(y, "k", how).select("i", "k", *(["v"] if how in ("inner", "left") else [])).collect()))
        for limit in (1 << 20, 0):
            got = joins.lookup_join(x, y, ["k"], how, limit, hot=100)
            assert sorted(map(repr, got.select("i", "k", *(["v"] if how in ("inner", "left") else [])).collect())) == plain


def test_intervals_meet_once(spark):
    rng = random.Random(2)

    def made(n):
        out = []
        for i in range(n):
            a = rng.randrange(0, 4000)
            out.append((rng.choice("pq"), i, a, a + rng.choice([0, 1, 5, 40, 3000])))
        return out

    left, right = made(250), [*made(250), ("p", 900, None, 5)]
    x, y = spark.createDataFrame(left, "d string, i int, start int, end int"), spark.createDataFrame(right, "d string, j int, a int, b int")
    want = sorted((m[1], r[1]) for m in left for r in right if m[0] == r[0] and r[2] is not None and m[2] < m[3] and r[2] < r[3] and m[2] < r[3] and r[2] < m[3])
    for width in (None, 1, 64, 100_000):
        got = joins.interval_join(x, y, ["d"], ("start", "end", "a", "b"), width=width)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    inside = joins.interval_join(x, y, ["d"], ("start", "end", "a", "b"), (F.col("r.a") <= F.col("l.start")) & (F.col("l.end") <= F.col("r.b")))
    assert 0 < inside.count() < len(want)


def test_document_of_very_many_intervals(spark):
    """Spans side by side, in one document: each point is in one, found by its bin and not by trying all."""
    spans = spark.range(100_000).select(F.lit("d").alias("note_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"), F.concat(F.lit("s"), "id").alias("section"))
    points = spark.range(200_000).select(F.lit("d").alias("note_id"), (F.col("id") * 5).alias("start"), F.col("id").alias("p"))
    placed = joins.place_in(points, spans, ["note_id"], "start", ["section"])
    shown = plan(placed)
    assert "Cartesian" not in shown and "NestedLoop" not in shown
    n, held, right = placed.agg(F.count("*"), F.count("section"), F.count_if(F.col("section") == F.concat(F.lit("s"), F.floor(F.col("start") / 10)))).first()
    assert (n, held, right) == (200_000, 200_000, 200_000)
    assert joins.place_in(points, spans.limit(0), ["note_id"], "start", ["section"]).where("section is null").count() == 200_000


def test_scopes_of_a_long_document(spark):
    """A document of twenty thousand sentences, by rows and within its row."""
    rng = random.Random(6)
    lines = [t for t in ("No fever, chills, or cough.", "Denies asthma but has gout; stroke is ruled out.", "Mother had stroke, no history of fever, cough.", "Plain words.", "Pneumonia cannot be ruled out, asthma resolved; no evidence of MI, though cough.")]
    doc = spark.createDataFrame([("d", " ".join(rng.choice(lines) for _ in range(20_000)))], "note_id string, text string")
    lexicon_, triggers, _ = rows.package_tables(spark)
    texts = views.sentences(doc).select("note_id", "sent_id", F.lower("text").alias("low")).cache()
    asked = texts.join(rows.hits(texts, lexicon_).select("note_id", "sent_id").distinct(), ["note_id", "sent_id"], "left_semi")
    got = rows.scopes(asked, triggers).collect()
    want = views.scopes(doc).where("start < end").select("note_id", "sent_id", "label", "start", "end").collect()
    assert len(want) > 20_000 and sorted(got) == sorted(want)


def test_texts_in_rows_as_in_a_document(spark):
    """The documents of test_behaviour, entity by entity."""
    from test_behaviour import TEXTS

    df = spark.createDataFrame(list(TEXTS.items()), "note_id string, text string")
    lexicon_, triggers, codes = rows.package_tables(spark)
    got = terminology.coded(rows.entities(views.sentences(df), lexicon_, triggers), terminology.as_of(codes))
    nested = extract.extract_documents(df)
    got = rows.with_sections(got, views.section_spans(nested))
    want = views.entities(extract.with_sections(extract.with_entities(df), apply=False)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_terminology_by_version(spark):
    codes = spark.createDataFrame([("condition", "gout", "S", "1", "Gout", 1), ("condition", "gout", "S", "2", "Gout, new", 3), ("condition", "flu", "S", "9", "Flu", 1), ("condition", "flu", "S", None, None, 2), ("medication", "gout", "R", "7", "Drug", 1)], terminology.TERMINOLOGY)
    found = spark.createDataFrame([("condition", "gout"), ("condition", "flu"), ("condition", None), ("allergy", "x"), ("medication", "gout"), ("condition", "flu")], "kind string, concept string")
    for version, gout, flu in ((1, "1", "9"), (2, "1", None), (None, "2", None)):
        got = {(r["kind"], r["concept"]): r["code"] for r in terminology.coded(found, terminology.as_of(codes, version)).collect()}
        assert got == {("condition", "gout"): gout, ("condition", "flu"): flu, ("condition", None): None, ("allergy", "x"): None, ("medication", "gout"): "7"}
    assert sorted(map(tuple, terminology.misses(found, terminology.as_of(codes)).collect()), key=repr) == [("condition", "flu", 2), ("condition", None, 1)]


def test_terminology_of_a_million_codes(spark):
    """Too large to broadcast under the limit given; a third of the findings have one concept."""
    codes = spark.range(1_000_000).select(F.lit("condition").alias("kind"), F.concat(F.lit("c"), "id").alias("concept"), F.lit("S").alias("code_system"), F.col("id").cast("string").alias("code"), F.lit("x").alias("code_display"), F.lit(1).alias("version"))
    found = spark.range(60_000).select(F.lit("condition").alias("kind"), F.when(F.col("id") % 3 == 0, "c7").otherwise(F.concat(F.lit("c"), F.col("id") * 31)).alias("concept"), "id")
    got = joins.lookup_join(found, codes, terminology.KEY, "left", limit=1 << 20, hot=1000)
    assert "BroadcastHashJoin" not in plan(got).split("Physical Plan")[0]
    n, right, missing = got.agg(F.count("*"), F.count_if(F.concat(F.lit("c"), "code") == F.col("concept")), F.count_if(F.col("code").isNull())).first()
    assert (n, right, missing) == (60_000, 60_000 - missing, sum(1 for i in range(60_000) if i % 3 and i * 31 >= 1_000_000))


def test_tables_match_as_multisets(spark):
    rng = random.Random(3)
    pick = lambda: (rng.choice([1, 2, None]), rng.choice(["a", "b", None]), "k", rng.choice(["present", "absent", None, "family"]))
    sides = [[(i, *pick()) for i in range(120)] for _ in range(2)]
    dfs = [spark.createDataFrame(s, "ord int, case_id int, concept string, kind string, assertion string") for s in sides]
    got = Counter(tuple(r) for r in evaluate.match_tables(*dfs).collect())
    left, right = (Counter(x[1:] for x in s) for s in sides)
    exact = left & right
    want = Counter({(c, n, k, a, a, "exact"): m for (c, n, k, a), m in exact.items()})
    rest = []
    for side, full in zip(sides, (left, right), strict=True):
        seen, out = Counter(), {}
        for x in side:
            seen[x[1:]] += 1
            if seen[x[1:]] > exact[x[1:]]:
                out.setdefault(x[1:4], []).append(x[4])
        rest.append(out)
    for key in {*rest[0], *rest[1]}:
        a, b = (r.get(key, []) for r in rest)
        for i in range(max(len(a), len(b))):
            outcome = "missed" if i >= len(b) else "spurious" if i >= len(a) else "wrong_assertion"
            want[(*key, a[i] if i < len(a) else None, b[i] if i < len(b) else None, outcome)] += 1
    assert got == want


@pytest.mark.parametrize("name", ["entity_axes", "section_defaults", "reconcile_rows", "fhir_conditions", "section_audit", "batch_results", "gold_errors"])
def test_extraction_is_in_the_plan_once(spark, sf, name):
    """Sentences are split once: a filter inferred from a generator would hold the extraction again."""
    shown = queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(text.SENTENCE_END) <= 2


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    values = list(range(n))
    (row,) = spark.createDataFrame([(values,)], "v array<int>").select(text.running_sums(F.col("v")).alias("s")).collect()
    assert row["s"] == [sum(values[:i]) for i in range(n)]


def test_only_lexicons_are_broadcast(spark, sf):
    """entity_axes_by_rows looks up in the lexicon once and in the triggers twice for masked and plain text; found rows meet by shuffle."""
    for name in ("entity_axes_by_rows", "entity_sections_by_rows"):
        shown = queries.queries()[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        joined = [line for line in shown.splitlines() if "BroadcastHashJoin" in line]
        assert joined and all("first#" in line for line in joined)


def test_large_lexicons_are_not_broadcast(spark):
    many, table_ = spark.range(10).selectExpr("id as k"), spark.range(10).selectExpr("id as k", "'x' as v")
    shown = joins.lookup_join(many, table_, ["k"], "inner", limit=0)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in [line for line in shown.splitlines() if "Join" in line][0] and joins.lookup_join(many, table_, ["k"], "inner", limit=0).count() == 10


def test_relatives_are_extracted_once(spark, sf):
    shown = queries.fhir_family(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(text.SENTENCE_END) <= 2


def test_bundles_are_not_joined(spark, sf):
    for name in ("fhir_bundle_sizes", "fhir_bundle_entries"):
        assert "Join" not in queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_with_one_beginning_are_joined_whole(spark):
    """Of very many phrases that begin alike a place meets those that stand there, and the texts are cut into tokens once."""
    texts = spark.range(300).select("id", F.concat(F.lit("no heart failure "), F.col("id") * 7, F.lit(" , heart failure today; x"), "id").alias("low"))
    lexicon_ = spark.range(2000).select(F.lit("k").alias("kind"), F.concat(F.lit("heart failure "), "id").alias("phrase"), F.col("id").cast("string").alias("concept"), F.col("id").alias("ord")).union(table(spark, [("heart failure", "h"), (", heart failure today", "t")]))
    for limit in (0, joins.BROADCAST_BYTES):
        found = phrases.find_phrases(texts, lexicon_, limit=limit)
        shown = found._jdf.queryExecution().sparkPlan().toString()
        assert any("phrase#" in line for line in shown.splitlines() if "Join" in line) and shown.count("low#") and shown.count("Generate") <= 2
        got = Counter(r["concept"] for r in found.collect())
        assert got == Counter({"h": 600, "t": 300} | {str(i * 7): 1 for i in range(286)})


def test_sentences_are_searched_for_triggers_once(spark, sf):
    """Masked and plain sentences are searched together, and those with a finding are not found again for it."""
    shown = queries.queries()["entity_axes_by_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count(text.SENTENCE_END) <= 10 and shown.count("source#") > 0
    texts = spark.createDataFrame([("d", 0, "no fever, denies cough but has gout; stroke is ruled out.")], "note_id string, sent_id int, low string")
    plan_ = rows.scopes(texts, rows.trigger_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("Join Inner") == 2 and "LeftAnti" not in plan_
