"""Connected components as repeated joins (large star, small star), for any graph size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import drop, join_counted, table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the undirected edges; component is the smallest node reachable.

    Rows with a null end and self loops add nothing; repeated edges count once; no edges give no rows.
    A minimum by node is pre-aggregated in the map tasks, and joined with the edges of a node with very many as they lie, so such a node is no hot group.
    """
    now = table(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = None
    while True:
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if size["n"] == 0 or (size["n"], size["s"]) == state:
            break
        state = (size["n"], size["s"])
        both = now.union(now.select("v", "u"))
        least = table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = table(join_counted(both.where("v > u"), least, "u", "n").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        with_low = join_counted(large, lowest, "u", "n")
        star = with_low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m")).distinct()
        after = table(star)
        for used in (now, least, large, lowest):
            drop(used)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
