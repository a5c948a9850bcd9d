"""Sentences, phrase positions, dictionary matches and medication attributes as columns.

Offsets are code points from 0, half-open. Everything is a Spark expression, so it runs in the JVM, in batches and in streams.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinispan import lexicon

#: What Python and Java both call white space, wherever they differ.
SPACE = r"[\s\x1c-\x1f]"
# Patterns of sentence ends, doses, routes, frequencies, breaks in lists and talk of allergies.
SENTENCE_END = rf"(?U)(?<=[.;!?]){SPACE}+|\n+"
DOSE = r"(?iU)(\d+(?:\.\d+)?)\s*(mg|mcg|g|units?|ml|iu)\b"
ROUTE = r"(?iU)\b(po|by mouth|orally|iv|intravenous(?:ly)?|im|sublingual|sl|subcutaneous(?:ly)?|subq|sc|inhaled|nebulized|topical|pr|rectally|transdermal)\b"
FREQUENCY = r"(?iU)\b(qd|q\.?d\.?|daily|once daily|bid|b\.?i\.?d\.?|twice daily|tid|t\.?i\.?d\.?|three times daily|qid|q\.?i\.?d\.?|four times daily|qhs|nightly|at bedtime|weekly|every other day|q\d+h|every \d+ hours|prn|as needed)\b"
LIST_BREAK = r"(?U)\b(and|,|;)\s+(?=[a-z])"
ALLERGY_CONTEXT = "allerg|adverse reaction|intoleran"
# Fixed value: characters after a drug's name in which its attributes are looked for.
ATTRIBUTE_WINDOW = 60
# Fixed value: characters of the words that dictionaries' phrases stand between.
TERM = "a-z0-9"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a fold over nothing, whose last step is body. It hands the result on, where a transform copies it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def let_each(value: Column, body: Callable[[Column], Column]) -> Column:
    """let() as a transform of an array of value alone, by which plans show that body is made once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers that running_sums() adds up one by one.
SUM_BLOCK = 256


def running_sums(values: Column) -> Column:
    """For each of an array of ints the sum of those before it. In blocks, as an array that grows is copied at each step: sums of blocks first, then within each."""

    def sums(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")))["out"]

    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / SUM_BLOCK).cast("int")), lambda i: F.slice(values, i * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return let(totals, lambda t: let(sums(t, F.lit(0)), lambda before: F.flatten(F.transform(blocks, lambda b, i: sums(b, F.get(before, i))))))

    return let(cut, joined)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{SPACE}*$")


def sentences(text: Column) -> Column:
    """array<struct<text, start, end>>: sentences end after . ! ? ; before white space, and at line ends; abbreviations do not end one."""
    guarded = text
    for word in lexicon.ABBREVIATIONS:
        guarded = F.replace(guarded, F.lit(word), F.lit(word.replace(".", "\0")))

    def placed(chunks: Column, before: Column) -> Column:
        each = F.transform(chunks, lambda x, i: F.struct(F.replace(x, F.lit("\0"), F.lit(".")).alias("text"), F.get(before, i).alias("start"), (F.get(before, i) + F.length(x)).alias("end")))
        return F.filter(each, lambda s: ~is_blank(s["text"]))

    def split(whole: Column) -> Column:
        gaps = F.transform(F.regexp_extract_all(whole, F.lit(SENTENCE_END), F.lit(0)), F.length)

        def lengths(c: Column, g: Column) -> Column:
            return F.transform(c, lambda x, i: F.length(x) + F.coalesce(F.get(g, i), F.lit(0)))

        return let(F.split(whole, SENTENCE_END, -1), lambda c: let(gaps, lambda g: let(running_sums(lengths(c, g)), lambda before: placed(c, before))))

    return let(guarded, split)


def positions(text: Column, phrase: Column, word: str) -> Column:
    """Starts of phrase in text, which holds it, where no character of the class word touches it on either side, left to right, apart."""
    none = F.array().cast("array<int>")

    def several() -> Column:
        parts = F.split(text, F.concat(F.lit(f"(?<![{word}])\\Q"), phrase, F.lit(f"\\E(?![{word}])")), -1)

        def starts(p: Column) -> Column:
            before = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
            step = F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), before, lambda s, x: F.struct((s["pos"] + F.length(x) + F.length(phrase)).alias("pos"), F.array_append(s["out"], s["pos"] + F.length(x)).alias("out")))
            return F.when(F.size(p) > 1, step["out"]).otherwise(none)

        return let(parts, starts)

    def first(at: Column) -> Column:
        # Most phrases occur once; a pattern, which is compiled for each phrase and text, is for the others.
        sides = F.concat(F.when(at > 1, F.substring(text, at - 1, F.lit(1))).otherwise(""), F.substring(text, at + F.length(phrase), F.lit(1)))
        once = F.when(sides.rlike(f"[{word}]"), none).otherwise(F.array(at - 1))
        return F.when(F.position(phrase, text, at + 1) > 0, several()).when(at > 0, once).otherwise(none)

    return let(F.position(phrase, text), first)


def constant(value: str | int | None) -> str:
    """SQL for a value. Tables of many are given to the JVM as one text, since a call for each of their values takes longer than the query."""
    if value is None:
        return "null"
    if not isinstance(value, str):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def array_of(values: Sequence[str | int | None]) -> Column:
    """A literal array."""
    return F.expr(f"array({', '.join(map(constant, values))})")


def map_of(entries: Mapping) -> Column:
    """A literal map."""
    return F.expr(f"map({', '.join(constant(x) for pair in entries.items() for x in pair)})")


def table_of(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    """A literal array of structs, folded once for the whole query."""
    if not rows:
        return F.array().cast(f"array<struct<{', '.join(f'{n}:string' for n in names)}>>")
    structs = (", ".join(f"{constant(n)}, {constant(v)}" for n, v in zip(names, row, strict=True)) for row in rows)
    return F.expr(f"array({', '.join(f'named_struct({s})' for s in structs)})")


#: Lists that an index of phrases has, by a checksum of their first words; one more is for phrases that begin with no word.
BUCKETS = 1024


def index_of(rows: Sequence[tuple], names: Sequence[str], word: str) -> Column:
    """A literal table (the first of names is phrase) as lists by the checksum of the first run of characters of the class word."""
    kind = f"array<struct<ord:int,{','.join(f'{n}:string' for n in names)}>>"
    lists: list[list[str]] = [[] for _ in range(BUCKETS + 1)]
    for i, row in enumerate(rows):
        first = re.match(f"[{word}]+", row[0])
        cells = "".join(f", {constant(n)}, {constant(v)}" for n, v in zip(names, row, strict=True))
        lists[zlib.crc32(first[0].encode()) % BUCKETS if first else BUCKETS].append(f"named_struct('ord', {i}{cells})")
    return F.expr(f"cast(array({', '.join(f'array({', '.join(x)})' for x in lists)}) as array<{kind}>)") if rows else F.expr(f"array_repeat(cast(array() as {kind}), {BUCKETS + 1})")


def asked(text: Column, index: Column, word: str) -> Column:
    """Rows of an index (index_of() of the same class word) in the order of its table: those that text holds, and, as a word begins them, has the first word of."""
    lists = F.array_distinct(F.transform(F.split(text, f"[^{word}]+"), lambda t: F.pmod(F.crc32(t), F.lit(BUCKETS)).cast("int")))
    return F.array_sort(F.flatten(F.transform(F.array_append(lists, F.lit(BUCKETS)), lambda i: F.filter(F.get(index, i), lambda row: F.contains(text, row["phrase"])))))


def places(text: Column, rows: Column, word: str, extra: Sequence[str] = ()) -> Column:
    """array<struct<s, e, extra...>>: each place in text of each of rows (their column phrase), in their order."""

    def spans(row: Column) -> Column:
        return F.transform(positions(text, row["phrase"], word), lambda s: F.struct(s.alias("s"), (s + F.length(row["phrase"])).alias("e"), *(row[x].alias(x) for x in extra)))

    return F.flatten(F.transform(rows, spans))


def phrase_spans(text: Column, index: Column, word: str, extra: Sequence[str] = ()) -> Column:
    """array<struct<s, e, extra...>>: each place of each phrase of index (index_of() of the same class word), in the order of its table."""
    return places(text, asked(text, index, word), word, extra)


def dictionary(entries: Sequence[tuple[str, str]]) -> Column:
    return index_of(sorted(entries, key=lambda x: -len(x[0])), ("phrase", "concept"), TERM)


def apart(hits: Column, kind: str, same: Callable[[Column, Column], Column] | None = None) -> Column:
    """Of hits (array<struct<s, e, ...>>, its type kind) those that overlap none taken before them; with same only such as it holds for are compared."""

    def over(t: Column, hit: Column) -> Column:
        meet = (hit["s"] < t["e"]) & (t["s"] < hit["e"])
        return meet & same(t, hit) if same else meet

    return F.aggregate(hits, F.array().cast(kind), lambda taken, hit: F.when(F.exists(taken, lambda t: over(t, hit)), taken).otherwise(F.array_append(taken, hit)))


def terms(low: Column, table: Column) -> Column:
    """Dictionary matches in lower-cased text, longer phrases first; one that overlaps a match already taken is left out; by place."""
    return F.array_sort(apart(phrase_spans(low, table, TERM, ("concept",)), "array<struct<s:int,e:int,concept:string>>"))


def medication_attributes(sentence: Column, end: Column) -> Column:
    """struct<dose, route, frequency> in the window after the drug; a dose that begins after a break in a list is another drug's."""

    def group(window: Column, pattern: str, n: int) -> Column:
        return F.nullif(F.regexp_extract(window, pattern, n), F.lit(""))

    def first(window: Column, pattern: str) -> Column:
        return F.length(F.get(F.split(window, pattern, 2), F.lit(0)))

    def attributes(window: Column) -> Column:
        other = window.rlike(LIST_BREAK) & (first(window, DOSE) > first(window, LIST_BREAK))
        dose = F.when(~other, F.concat(group(window, DOSE, 1), F.lit(" "), F.lower(group(window, DOSE, 2))))
        return F.struct(dose.alias("dose"), F.lower(group(window, ROUTE, 1)).alias("route"), F.lower(group(window, FREQUENCY, 1)).alias("frequency"))

    return let(F.substring(sentence, end + 1, F.lit(ATTRIBUTE_WINDOW)), attributes)
