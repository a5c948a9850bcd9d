"""What the extraction does once a note or a sentence, and no more often."""

import re

from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions import context, sections, text
from clinispan.operators import extract
from clinispan.plans import queries


def below(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from below(children.apply(i))


def test_sections_are_made_once_a_note(spark, tmp_path):
    """Only a let() (a transform of one value) may hold the search for headers, no transform of entities."""
    df = spark.createDataFrame([(1, "PMH: asthma.\nPLAN: gout.")], "note_id int, text string")
    extract.with_entities(df).write.parquet(str(tmp_path / "found"))
    out = extract.with_sections(spark.read.parquet(str(tmp_path / "found"))).select("entities")
    expressions = out._jdf.queryExecution().optimizedPlan().expressions()
    nodes = [n for i in range(expressions.size()) for n in below(expressions.apply(i)) if n.getClass().getSimpleName() == "ArrayTransform"]
    searching = [n for n in nodes if any(x.getClass().getSimpleName() == "RegExpExtractAll" for x in below(n.children().apply(1)))]
    assert searching and all(n.children().apply(0).getClass().getSimpleName() == "CreateArray" for n in searching)


def test_a_held_value_is_made_once_and_handed_on(spark):
    """let() is no transform, which copies what its body makes; a null is held like any value."""
    df = spark.createDataFrame([("a",), (None,)], "x string")
    held = df.select(text.let(F.rand(), lambda r: r - r).alias("same"), text.let(F.col("x"), lambda x: F.coalesce(x, F.lit("none"))).alias("x"))
    assert sorted(tuple(r) for r in held.collect()) == [(0.0, "a"), (0.0, "none")]
    expressions = held._jdf.queryExecution().optimizedPlan().expressions()
    assert not any(n.getClass().getSimpleName() == "ArrayTransform" for i in range(expressions.size()) for n in below(expressions.apply(i)))


def test_phrases_are_looked_for_where_their_first_word_is(spark):
    """A phrase in the middle of a word is not asked for; one that begins with no word always is; rows keep the order of the table."""
    table = text.index_of([("type 2", "a"), ("-x", "b"), ("ye", "c"), ("type", "d")], ("phrase", "concept"), text.TERM)
    df = spark.createDataFrame([("eye type 2-x", ), ("", ), ("prototype",)], "low string")
    got = [[x["concept"] for x in r["a"]] for r in df.select(text.asked(F.col("low"), table, text.TERM).alias("a")).collect()]
    assert got == [["a", "b", "d"], [], []]
    assert text.phrase_spans(F.col("low"), table, text.TERM, ("concept",)) is not None
    (row,) = df.limit(1).select(text.phrase_spans(F.col("low"), table, text.TERM, ("concept",)).alias("p")).collect()
    assert [tuple(x) for x in row["p"]] == [(4, 10, "a"), (4, 8, "d")]


def test_a_trigger_beside_a_hidden_phrase(spark):
    """Hiding a pseudo-negation uncovers a trigger that had a letter of it beside it, and consuming that uncovers words of the rest."""
    pseudo = next(p for p in lexicon.PSEUDO_NEGATION if p[-1].isalpha())
    df = spark.createDataFrame([(f"{pseudo}denies asthma",), (f"{pseudo}no evidence ofpossible asthma",), ("no no asthma, no gout",)], "low string")
    got = [[tuple(x) for x in r["s"]] for r in df.select(context.scopes(F.col("low")).alias("s")).collect()]
    n = len(pseudo)
    assert ("absent", n + 6, n + 13) in got[0]
    assert [x[0] for x in got[2]] == ["absent"] * 3


def test_section_summary_extracts_once(spark, sf):
    plan = queries.section_summary(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(re.escape(sections.HEADER)) <= 3 and plan.count("regexp_extract_all") == 3


def test_gold_cases_are_extracted_and_shuffled_once(spark, sf):
    """Of two tables each is made once, whatever becomes of its leftovers; cases of one row are one extraction, dealt out by case once for every window."""
    for query, extractions, dealt in ((queries.gold_errors, 1, 1), (queries.gold_confusion_margins, 1, 1), (queries.gold_errors_by_tables, 2, None), (queries.gold_leakage, 2, None)):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == extractions
        assert dealt is None or len(re.findall(r"Exchange hashpartitioning\(case_id", plan)) == dealt
