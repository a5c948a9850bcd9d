"""Extraction as joins of rows: lexicons, triggers, sections and codes are tables, and so is everything found.

operators.extract does the same in one row per document, which is faster for notes and the package's lexicons. This form is for
lexicons that are too large for a plan, and for documents too large for a row: what it holds at once is a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions import context, text
from clinispan.functions.sections import PREAMBLE
from clinispan.operators import joins, phrases, terminology
from clinispan.operators.extract import DICTIONARIES

TRIGGERS = "phrase string, label string, dir string, source string"
_LETTER = context.LETTER


def trigger_table(spark: SparkSession) -> DataFrame:
    """The package's triggers; source: the form of a sentence that they are looked for in, stop for terminations."""
    groups = (("masked", context.ON_MASKED), ("rest", context.ON_REST), ("raw", context.ON_RAW), ("stop", ((None, None, lexicon.TERMINATION),)))
    return spark.createDataFrame([(p, label, way, source) for source, gs in groups for label, way, ps in gs for p in dict.fromkeys(ps)], TRIGGERS)


def _breaks(low: Column) -> Column:
    """Places of commas and semicolons."""
    sizes = F.transform(F.split(low, "[,;]", -1), lambda x: F.length(x) + 1)
    return F.filter(F.transform(text.running_sums(sizes), lambda s, i: s + F.get(sizes, i) - 1), lambda p: p < F.length(low))


def scopes(texts: DataFrame, triggers: DataFrame, by: tuple[str, ...] = ("note_id", "sent_id")) -> DataFrame:
    """by, label, start, end: what each trigger of a lower-cased sentence low of texts covers; none that are empty.

    Triggers, stops and the places that bound scopes are one stream per sentence; what is nearest before and after is the
    running greatest or least of it, in the order of places or the reverse. One search for phrases, one shuffle by sentence, no join of places with places.
    """
    low, masked = F.col("low"), F.col("form") == "masked"
    forms = F.array(*(F.struct(F.lit(name).alias("form"), form.alias("low")) for name, form in (("masked", context.mask(low)), ("plain", low))))
    texts = texts.select(*by, _breaks(low).alias("breaks"), F.length("low").alias("size"), forms.alias("forms")).select(*by, "breaks", "size", F.explode_outer("forms").alias("of")).select(*by, "breaks", "size", "of.*")
    found = phrases.find_phrases(texts, triggers, _LETTER).where(F.when(masked, F.col("source").isin("masked", "stop")).otherwise(F.col("source") != "stop"))
    # What a forward negation covers hides triggers of the rest: of the negations that start before a trigger's end, one ends after its start.
    negation = masked & (F.col("source") == "masked") & (F.col("dir") == "fwd")
    starts = F.when(negation, F.col("s")).otherwise(F.col("e") - 1)
    covered = F.max(F.when(negation, F.col("e"))).over(joins.running(by, starts, F.when(negation, 0).otherwise(1)))
    hidden = ~masked & (F.col("source") == "rest") & F.coalesce(covered > F.col("s"), F.lit(False))
    # At one place stops and bounds come before openers, as their names do.
    kinds = F.array(
        F.when(F.when(masked, F.col("source") == "masked").otherwise((F.col("source") == "raw") | ((F.col("source") == "rest") & ~F.col("hidden"))), "opener"),
        F.when(masked & (F.col("source") == "stop"), "a stop"),
        F.when(~masked & (F.col("source") != "raw"), "bound"),
    )
    stream = found.withColumn("hidden", hidden).select(*by, "s", "e", "label", "dir", "breaks", "size", F.explode_outer(kinds).alias("is")).where("is is not null")
    opener, forward = F.col("is") == "opener", F.col("dir") == "fwd"

    def before(kind: str, at: Column, value: Column) -> Column:
        """The greatest value of a kind that ends at or before at."""
        return F.max(F.when(F.col("is") == kind, value)).over(joins.running(by, F.when(opener, at).otherwise(F.col("e")), F.col("is")))

    def after(kind: str, at: Column) -> Column:
        """The first place of a kind that starts at or after at."""
        return F.min(F.when(F.col("is") == kind, F.col("s"))).over(joins.running(by, F.when(opener, at).otherwise(F.col("s")).desc(), F.col("is")))

    opened = stream.withColumns({"last_stop": before("a stop", F.col("s"), F.col("e")), "next_stop": after("a stop", F.col("e"))})
    opened = opened.withColumns({"a": F.when(forward, F.col("e")).otherwise(F.coalesce("last_stop", F.lit(0))), "b": F.when(forward, F.coalesce("next_stop", "size")).otherwise(F.col("s"))})
    broken = opened.withColumns({"from": F.array_min(F.filter("breaks", lambda p: p >= F.col("a"))) + 1, "to": F.array_max(F.filter("breaks", lambda p: p < F.col("b")))})
    bounded = broken.withColumns({"next": after("bound", F.col("from")), "last": before("bound", F.col("to"), F.struct("s", "e"))}).where(opener)
    start = F.when(forward | F.col("to").isNull(), F.col("a")).otherwise(F.greatest("a", "last.e"))
    end = F.when(forward & F.col("from").isNotNull(), F.least("b", "next")).otherwise(F.col("b"))
    return bounded.select(*by, "label", start.alias("start"), end.alias("end")).where("start < end")


def hits(texts: DataFrame, table: DataFrame, by: tuple[str, ...] = ("note_id", "sent_id")) -> DataFrame:
    """by, s, e and the columns of table: dictionary matches of a lexicon in lower-cased sentences low; allergens only where the sentence speaks of allergies."""
    speaks = texts.select(*by, "low", F.col("low").rlike(text.ALLERGY_CONTEXT).alias("speaks"))
    found = phrases.find_phrases(speaks, table).where("kind <> 'allergy' or speaks").drop("speaks")
    return phrases.longest_matches(found, [*by, "kind"])


def entities(sentences: DataFrame, table: DataFrame, triggers: DataFrame, key: str = "note_id") -> DataFrame:
    """A row per finding of sentences (key, sent_id, text, start): sent_id, start, end, text, kind, concept, the axes, and dose, route and frequency."""
    by = (key, "sent_id")
    texts = sentences.select(*by, F.lower("text").alias("low"))
    found = hits(texts, table, by)
    own = found.select(*by, "s", "e", "kind", "concept")
    # Scopes of all sentences, as to choose those with a finding takes finding them again.
    covered = joins.interval_join(own, scopes(texts, triggers, by), by, ("s", "e", "start", "end"), (F.col("r.start") <= F.col("l.s")) & (F.col("l.e") <= F.col("r.end")), width=text.ATTRIBUTE_WINDOW)
    labels = covered.groupBy(*by, "s", "e", "kind").agg(F.collect_set("label").alias("labels"))
    placed = own.join(joins.shuffled(labels), [*by, "s", "e", "kind"], "left").join(joins.shuffled(sentences.select(*by, F.col("text").alias("sentence"), F.col("start").alias("at"))), list(by))
    empty = F.array().cast("array<string>")
    axes, attributes = context.axes(F.coalesce("labels", empty)), F.when(F.col("kind") == "medication", text.medication_attributes(F.col("sentence"), F.col("e")))
    out = placed.select(*by, (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e")).alias("end"), F.substring("sentence", F.col("s") + 1, F.col("e") - F.col("s")).alias("text"), "kind", "concept", axes.alias("x"), attributes.alias("m"))
    return out.select(*by, "start", "end", "text", "kind", "concept", "x.*", *(F.col(f"m.{n}").alias(n) for n in ("dose", "route", "frequency")))


def with_sections(found: DataFrame, spans: DataFrame, key: str = "note_id") -> DataFrame:
    """found (entities()) with section, from the rows of spans (key, section, start, end): the preamble outside all."""
    return joins.place_in(found, spans, [key], "start", ["section"]).withColumn("section", F.coalesce("section", F.lit(PREAMBLE)))


def package_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The package's lexicon, triggers and terminology as tables."""
    return phrases.lexicon_table(spark, DICTIONARIES), trigger_table(spark), terminology.terminology_table(spark)
