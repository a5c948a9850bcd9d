"""Nested results as rows: sentences, trigger hits, scopes, entities, sections, and the terminology report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.functions import context
from clinispan.functions.text import let
from clinispan.operators.extract import with_entities, with_sentences

# Generators are outer ones, and a filter takes out the row that an empty array gives. From an inner one Spark infers that the array has
# elements, and pushes that down below the projections that make the array, which are then evaluated once more.


def sentences(docs: DataFrame, key: str = "note_id", column: str = "text") -> DataFrame:
    return with_sentences(docs, column).select(key, F.posexplode_outer("sentences").alias("sent_id", "s")).where("s is not null").select(key, "sent_id", "s.text", "s.start", "s.end")


def trigger_hits(docs: DataFrame, key: str = "note_id", column: str = "text") -> DataFrame:
    """Every place of any trigger in each sentence, with offsets in the sentence."""
    each = with_sentences(docs, column).select(key, F.posexplode_outer("sentences").alias("sent_id", "s")).where("s is not null")
    return each.select(key, "sent_id", F.explode_outer(let(F.lower("s.text"), context.trigger_spans)).alias("t")).where("t is not null").select(key, "sent_id", F.col("t.s").alias("start"), F.col("t.e").alias("end"))


def scopes(docs: DataFrame, key: str = "note_id", column: str = "text") -> DataFrame:
    """The scopes of sentences that have a match, with offsets in the sentence."""
    staged = with_entities(docs, column, keep_stages=True).select(key, F.explode_outer("matched").alias("m"))
    return staged.select(key, "m.sent_id", F.explode_outer("m.scopes").alias("x")).where("x is not null").select(key, "sent_id", "x.label", F.col("x.a").alias("start"), F.col("x.b").alias("end"))


def entities(docs: DataFrame, key: str = "note_id") -> DataFrame:
    """A row per entity of docs (with entities)."""
    flat = docs.select(key, F.inline_outer("entities")).where("start is not null")
    return flat.select(*(c for c in flat.columns if c != "attrs"), "attrs.dose", "attrs.route", "attrs.frequency")


def section_spans(docs: DataFrame, key: str = "note_id") -> DataFrame:
    return docs.select(key, F.posexplode_outer("sections").alias("ord", "x")).where("x is not null").select(key, "ord", "x.section", "x.start", "x.end")


def section_audit(docs: DataFrame, key: str = "note_id") -> DataFrame:
    return docs.select(key, F.inline_outer("section_changes")).where("start is not null")


def mapping_rate(found: DataFrame) -> DataFrame:
    """One row from entities(): distinct concepts seen and mapped, and their ratio (0 without concepts); allergies have no codes."""
    seen = found.where("kind in ('condition', 'medication')").groupBy("kind", "concept").agg(F.max("code").alias("code"))
    counts = seen.agg(F.count("*").alias("n_concepts"), F.count("code").alias("n_mapped"))
    return counts.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("n_mapped", "n_concepts"), F.lit(0.0)), 6))


def mapping_misses(found: DataFrame) -> DataFrame:
    """Concepts without a code and how often they occur, most frequent first."""
    missed = found.where("kind in ('condition', 'medication') and code is null")
    return missed.groupBy("kind", "concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "concept")
