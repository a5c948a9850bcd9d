"""Tables that cut lineage, kept in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for deleting a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows up to which a narrow table (ids, hashes, a few numbers: under 64 bytes a row) may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of a key from which join_counted() doesn't shuffle them to one task.
HOT_ROWS = 1_000
#: Keys up to which join_counted() shuffles nothing.
FEW_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where it is unset, a folder of our own, for local runs only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/clinispan"


def scratch_path(spark: SparkSession) -> str:
    """A new path for this application; the folder of the application may go when it has ended."""
    return f"{checkpoint_dir(spark)}/clinispan-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from the shared folder. The shuffle files that made them go at once, as nothing reads them again."""
    return tables([df])


def tables(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, which have the same columns, as one table(). A part's shuffle files go before the next part's are made."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or scratch_path(spark)
        before = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table() that nothing needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"clinispan-{spark.sparkContext.applicationId}" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the narrow table df, counted now, has few enough rows; else df, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(many: DataFrame, one: DataFrame, on: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """many joined with the narrow table one (a row per key; count: about how many rows of many have it), inner or left.

    With few keys all are joined by broadcast. Else keys with more than HOT_ROWS rows, or with as many more as leave BROADCAST_ROWS
    keys at most, are, and the rest by shuffle, so a key that a third of the rows have is dealt out as the rows lie. Both tables are read more than once.
    """
    if one.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return many.join(F.broadcast(one), on, how)
    least = HOT_ROWS
    while (n := one.where(F.col(count) > least).count()) > BROADCAST_ROWS:
        least *= 16
    if not n:
        return many.join(one, on, how)
    hot = F.broadcast(one.where(F.col(count) > least))
    rest = many.join(hot.select(*([on] if isinstance(on, str) else on)), on, "left_anti").join(one.where(f"not coalesce({count} > {least}, false)"), on, how)
    return many.join(hot, on).unionByName(rest)
