"""Joins with tables whose size is not known beforehand, and joins of intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a table that is looked things up in goes to every executor whole.
BROADCAST_BYTES = 8 << 20
#: Rows of a key from which they are dealt out, with a copy of the key's rows in the table for each share.
HOT_ROWS = 100_000


def row_bytes(table: DataFrame) -> Column:
    """The bytes of all values of a table, as an aggregate of it."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))).cast("long")), F.lit(0))


def counted_bytes(table: DataFrame) -> int:
    """The bytes of all values of a table, counted by one pass over it."""
    return table.agg(row_bytes(table)).first()[0]


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, to be joined by shuffle. Spark takes rows that generators make out of few others for as few and would broadcast them through the driver."""
    return rows.hint("merge")


def lookup_join(many: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES, hot: int | None = HOT_ROWS, size: int | None = None) -> DataFrame:
    """many joined with table (inner, left, left_semi or left_anti) on equal columns of the names on.

    A table of up to limit bytes (size, or counted now) is broadcast. Beyond that both are shuffled; rows of a key that more than hot rows of many
    have are dealt out in shares, and so are rows without a key, which match nothing. Keys are counted by more passes over many;
    without hot none are dealt out, for a many that is dear to make and a table with few rows of a key: a frequent key then makes a task longer, no larger.
    """
    on = list(on)
    if (counted_bytes(table) if size is None else size) <= limit:
        return many.join(F.broadcast(table), on, how)
    if hot is None:
        return many.join(shuffled(table), on, how)
    keys = many.groupBy(*on).agg(F.ceil(F.count("*") / hot).cast("int").alias("__shares")).where("__shares > 1")
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    # Hot keys are at most the rows of many divided by hot; AQE broadcasts them if they are few.
    shares = keys.where(present)
    spread = F.xxhash64(*many.columns)
    left = many.where(present).join(shares, on, "left").withColumn("__share", F.pmod(spread, F.coalesce("__shares", F.lit(1)))).drop("__shares")
    right = table.join(shares, on, "left").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__shares", F.lit(1)).cast("long") - 1))).drop("__shares")
    out = left.join(shuffled(right), [*on, "__share"], how).drop("__share")
    if how in ("inner", "left_semi"):
        return out
    return out.unionByName(many.where(~present), allowMissingColumns=True)


def _mean_length(rows: DataFrame, start: str, end: str) -> float:
    return rows.agg(F.avg(F.greatest(F.col(end) - F.col(start), F.lit(0)))).first()[0] or 1.0


def _binned(rows: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    low, high = (F.floor(x / width) for x in (F.col(start), F.col(end) - 1))
    return rows.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(low, high)))


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], spans: Sequence[str] = ("start", "end", "start", "end"), condition: Column | None = None, width: int | None = None) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals overlap, each pair once; condition: what else must hold.

    spans: the names of start and end on the left and on the right; all names but by must differ between the sides where they are used
    later. Intervals are dealt to bins of width, the mean length of the side whose intervals are longer, so that a side has at most three rows for each of its
    intervals, on average, and a key with very many intervals is dealt out by its bins. Empty intervals and null ends overlap nothing.
    """
    a, b, c, d = spans
    width = width or max(1, round(max(_mean_length(left, a, b), _mean_length(right, c, d))))
    x, y = _binned(left, a, b, width, "__bin").alias("l"), _binned(right, c, d, width, "__bin").alias("r")
    same = reduce(lambda p, q: p & q, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*by, "__bin")))
    meet = (F.col(f"l.{a}") < F.col(f"r.{d}")) & (F.col(f"r.{c}") < F.col(f"l.{b}"))
    # Of the bins that both are in, the first.
    first = F.floor(F.greatest(F.col(f"l.{a}"), F.col(f"r.{c}")) / width) == F.col("l.__bin")
    on = same & meet & first
    pairs = x.join(shuffled(y), on if condition is None else on & condition)
    return pairs.select(*(F.col(f"l.{n}") for n in left.columns), *(F.col(f"r.{n}") for n in right.columns if n not in by))


def place_in(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, values: Sequence[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """points, every row once, with the values of the interval of spans that holds at; nulls if none does. The intervals of a key must not overlap."""
    width = width or max(1, round(_mean_length(spans, start, end)))
    binned = _binned(spans.select(*by, F.col(start).alias("__start"), F.col(end).alias("__end"), *values), "__start", "__end", width, "__bin")
    x, y = points.withColumn("__bin", F.floor(F.col(at) / width)).alias("p"), binned.alias("s")
    same = reduce(lambda p, q: p & q, (F.col(f"p.{k}") == F.col(f"s.{k}") for k in (*by, "__bin")))
    found = x.join(shuffled(y), same & (F.col("s.__start") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s.__end")), "left")
    return found.select(*(F.col(f"p.{n}") for n in points.columns), *(F.col(f"s.{v}") for v in values))


def running(by: Sequence[str], *order: Column):
    """The window of a key's rows so far. An order turned round gives the rows from here on, at the cost of so far."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
