"""Temperature mixing of sources, from token counts to a realised, ordered multiset of rows.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they come). Bisection finds the largest
exponent whose mixture has a target entropy, or the smallest whose mixture repeats no source more often than a limit. A
source's budget is then met by whole blocks of its rows: each epoch takes the source's blocks in another random order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan.llm.packing import word_count


@dataclass(frozen=True)
class Settings:
    """budget: tokens of the mixture as a multiple of the input's; entropy: target as a share of the largest there is (log of
    the number of sources), or None; repeats: the most times that a source's tokens may be taken; blocks: of a source;
    steps: of the bisection; seed: of the orders."""

    budget: float = 1.0
    entropy: float | None = None
    repeats: float | None = 2.0
    blocks: int = 512
    steps: int = 60
    seed: int = 7


def source_weights(tokens: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """tokens (source, tokens) to source, tokens, exponent, weight (sums to 1) and target (tokens of the mixture).

    Sources without tokens are left out. A number per source is all that this holds in one place. With both limits given, the
    entropy target decides first, and the repetition limit raises the exponent if it has to. With neither it is 1. A limit that no
    exponent meets gives the nearest: 1 for repeats, 0 for entropy.
    """
    total = tokens.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("all"), F.sum("tokens").cast("double").alias("sum"))
    total = total.withColumn("p", F.transform("all", lambda x: x["tokens"] / F.col("sum")))

    def norm(e: Column) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda t, x: t + F.pow(x, e))

    def mixes_enough(e: Column) -> Column:
        logs = F.aggregate("p", F.lit(0.0), lambda t, x: t + F.pow(x, e) * F.ln(x))
        return F.ln(norm(e)) - e * logs / norm(e) >= F.lit(settings.entropy) * F.ln(F.size("p"))

    def repeats_little(e: Column) -> Column:
        return F.pow(F.array_min("p"), e - 1) / norm(e) * settings.budget <= settings.repeats

    def bisected(meets: Callable[[Column], Column], low: Column, keep: str) -> Column:
        """The end keep ('lo' or 'hi') of [low, 1], halved again and again, which moves to each middle that meets the limit."""
        other = {"lo": "hi", "hi": "lo"}[keep]

        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            ends = [F.struct(*(mid.alias(n) if n == moved else s[n].alias(n) for n in ("lo", "hi"))) for moved in (keep, other)]
            return F.when(meets(mid), ends[0]).otherwise(ends[1])

        return F.aggregate(F.sequence(F.lit(1), F.lit(settings.steps)), F.struct(low.alias("lo"), F.lit(1.0).alias("hi")), halve)[keep]

    open_ = settings.entropy is None and settings.repeats is None
    total = total.withColumn("exponent", F.lit(1.0 if open_ else 0.0))
    if settings.entropy is not None:
        total = total.withColumn("exponent", bisected(mixes_enough, F.lit(0.0), "lo"))
    if settings.repeats is not None:
        total = total.withColumn("exponent", F.when(repeats_little(F.col("exponent")), F.col("exponent")).otherwise(bisected(repeats_little, F.col("exponent"), "hi")))
    total = total.withColumn("norm", norm(F.col("exponent")))
    each = total.select("sum", "exponent", "norm", F.explode("all").alias("x"))
    weight = F.pow(F.col("x.tokens") / F.col("sum"), F.col("exponent")) / F.col("norm")
    return each.select("x.source", F.col("x.tokens").cast("long").alias("tokens"), "exponent", weight.alias("weight"), (weight * F.col("sum") * settings.budget).alias("target"))


def mix_sources(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs, each row as often as the mixture takes it, with n_tokens, weight (of its source), epoch, block and position.

    position orders the mixture: epoch, then the random place of the source's block in that epoch, then the row's hash (0 to 1,
    the blocks of all sources interleaved). Blocks are taken whole while that brings a source's tokens nearer to its target, so each
    source misses its target by half a block at most, or by half a row's tokens where a block is one row. A null source is a source of its own. Rows without
    tokens (null or blank texts) are left out, as is everything of a source beyond its target. Rows with equal doc_id, source and text share their fate. Columns of docs with
    the new names are replaced; the others stay as they are.
    """
    new = ("n_tokens", "weight", "epoch", "block", "position")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept).withColumn("n_tokens", word_count(F.col("text").cast("string"))).where("n_tokens > 0")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id", "source"), F.lit(settings.blocks)).cast("int"))
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    weights = source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), settings).select("source", F.col("tokens").alias("all"), "weight", "target")
    taken = blocks.join(weights, blocks["source"].eqNullSafe(weights["source"])).select(blocks["source"], "block", "tokens", "weight", F.floor(F.col("target") / F.col("all")).cast("int").alias("whole"), (F.col("target") - F.floor(F.col("target") / F.col("all")) * F.col("all")).alias("rest"))
    order = f"xxhash64({settings.seed}, source, block, whole + 1)"
    taken = taken.withColumn("before", F.expr(f"coalesce(sum(tokens) over (partition by source order by {order}, block rows between unbounded preceding and 1 preceding), 0)"))
    taken = taken.withColumn("copies", F.col("whole") + F.when(F.col("before") + F.col("tokens") / 2 < F.col("rest"), 1).otherwise(0)).where("copies > 0").select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "copies")
    # At most settings.blocks rows a source; Spark broadcasts them if they are few enough.
    both = rows.join(taken, rows["source"].eqNullSafe(taken["s"]) & (rows["block"] == taken["b"])).withColumn("epoch", F.explode(F.expr("sequence(1, copies)")))
    place = F.pmod(F.xxhash64(F.lit(settings.seed), "source", "block", "epoch"), F.lit(1 << 30)) / float(1 << 30)
    return both.withColumn("position", F.col("epoch") - 1 + place + F.pmod(F.xxhash64("doc_id", "epoch"), F.lit(1 << 20)) / float(1 << 52)).select(*kept, *new)

