"""Phrases of a table found in texts by an inverted index: looked up by their first words, joined whole, reduced to the longest.

A lexicon is a table (kind, phrase, concept, ord), of any size. Texts are lower-cased rows (keys ..., low), of the size of sentences. Tokens that begin no phrase
go first; from the others on, as many tokens as any phrase with that beginning has are joined with the phrases by equality, so that beginnings which many
phrases share do not meet all of them. The index is broadcast if its counted bytes allow, else shuffled. Nothing of the lexicon is in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions.text import let, running_sums
from clinispan.operators.joins import BROADCAST_BYTES, lookup_join, row_bytes

LEXICON = "kind string, phrase string, concept string, ord long"
#: The characters of words in dictionary phrases.
WORD = "a-z0-9"


def lexicon_table(spark: SparkSession, dictionaries: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Dictionaries by kind as a lexicon; ord is a phrase's place in its dictionary."""
    return spark.createDataFrame([(kind, p, c, i) for kind, entries in dictionaries.items() for i, (p, c) in enumerate(lexicon.pairs(entries))], LEXICON)


def _pattern(word: str) -> str:
    return rf"([{word}]+|[^{word}\s])"


def tokens(low: Column, word: str = WORD) -> Column:
    """array<struct<token, start>>: runs of the characters word, and each other one that is no white space."""
    pattern = _pattern(word)
    found, gaps = F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), F.transform(F.split(low, pattern, -1), F.length)

    def placed(t: Column, g: Column) -> Column:
        lengths = F.transform(t, lambda x, i: F.length(x) + F.get(g, i))
        return let(running_sums(lengths), lambda before: F.transform(t, lambda x, i: F.struct(x.alias("token"), (F.get(before, i) + F.get(g, i)).alias("start"))))

    return let(found, lambda t: let(gaps, lambda g: placed(t, g)))


def phrase_index(table: DataFrame, word: str = WORD) -> DataFrame:
    """table with first: the token that a phrase begins with, and count: how many it has. Null phrases and those that begin or end with white space are in no index."""
    t = F.regexp_extract_all("phrase", F.lit(_pattern(word)), F.lit(1))
    return table.where(r"phrase rlike '^\\S(.*\\S)?$'").withColumn("__t", t).withColumns({"first": F.get("__t", F.lit(0)), "count": F.size("__t")}).drop("__t")


def find_phrases(texts: DataFrame, table: DataFrame, word: str = WORD, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(texts' columns but low, s, e, and table's columns): each place of each phrase of table in low that no character of the class word touches on either side."""
    index = phrase_index(table, word)
    longest, size = index.agg(F.coalesce(F.max(F.length("phrase")), F.lit(0)), row_bytes(index)).first()
    keys = [c for c in texts.columns if c != "low"]
    start = F.col("__at.start")
    ahead = F.substring("low", start + 1, F.lit(longest + 1))
    touched = (start > 0) & F.substring("low", start, F.lit(1)).rlike(f"[{word}]")
    at = texts.select(*keys, "low", F.explode_outer(tokens(F.col("low"), word)).alias("__at")).where("__at is not null")
    each = at.select(*keys, start.alias("s"), F.col("__at.token").alias("first"), ahead.alias("ahead"), touched.alias("touched"))
    counts = lookup_join(each, index.groupBy("first").agg(F.collect_set("count").alias("counts")), ["first"], "inner", limit, hot=None)

    def runs(t: Column, n: Column) -> Column:
        last = F.get(t, n - 1)
        return F.substring("ahead", F.lit(1), last["start"] + F.length(last["token"]))

    # A phrase stands where so many tokens as it has are, with what is between them, the phrase.
    held = let(tokens(F.col("ahead"), word), lambda t: F.transform(F.filter("counts", lambda n: n <= F.size(t)), lambda n: runs(t, n)))
    candidates = counts.select(*keys, "s", "first", "ahead", "touched", F.explode_outer(held).alias("phrase")).where("phrase is not null")
    met = lookup_join(candidates, index.drop("count"), ["first", "phrase"], "inner", limit, hot=None, size=size)
    length = F.length("phrase")
    begins, ends = F.col("phrase").rlike(f"^[{word}]"), F.substring("ahead", length + 1, F.lit(1)).rlike(f"^[{word}]")
    # A phrase whose last character is none of the class may still not be touched by one.
    return met.where(~ends & (begins | ~F.col("touched"))).withColumn("e", F.col("s") + length).select(*keys, "s", "e", *table.columns)


def longest_matches(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of hits (find_phrases()) those that remain when longer phrases are taken first (equal ones by ord, then left to right), a phrase does not overlap itself, and none
    overlaps one that is taken.

    Hits of one key that overlap in a chain are weighed together, so what a task holds at once is a chain, not a text.
    """
    names = [c for c in hits.columns if c not in by]
    so_far = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    begins = hits.withColumn("__begins", F.when(F.max("e").over(before) > F.col("s"), 0).otherwise(1))
    ranked = F.struct((-F.length("phrase")).alias("__size"), F.col("ord").alias("__ord"), F.col("phrase").alias("__phrase"), F.col("s").alias("__s"), *names)
    chains = begins.withColumn("__chain", F.sum("__begins").over(so_far)).groupBy(*by, "__chain").agg(F.sort_array(F.collect_list(ranked)).alias("__all"))

    def step(state: Column, hit: Column) -> Column:
        again = (state["phrase"] == hit["__phrase"]) & (state["ord"] == hit["ord"]) & (hit["s"] < state["end"])
        free = ~F.exists(state["taken"], lambda t: (hit["s"] < t["e"]) & (t["s"] < hit["e"]))
        taken = F.when(free, F.array_append(state["taken"], hit)).otherwise(state["taken"])
        return F.when(again, state).otherwise(F.struct(hit["__phrase"].alias("phrase"), hit["ord"].alias("ord"), hit["e"].alias("end"), taken.alias("taken")))

    nothing = F.struct(F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("long").alias("ord"), F.lit(0).alias("end"), F.filter("__all", lambda _: F.lit(False)).alias("taken"))
    free = F.when(F.size("__all") == 1, F.col("__all")).otherwise(F.aggregate("__all", nothing, step)["taken"])
    return chains.select(*by, F.inline_outer(free)).select(*by, *names)
