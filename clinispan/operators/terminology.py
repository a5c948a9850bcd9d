"""Terminologies as versioned tables (kind, concept, code_system, code, code_display, version), of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan.operators.extract import TERMINOLOGIES
from clinispan.operators.joins import BROADCAST_BYTES, lookup_join

TERMINOLOGY = "kind string, concept string, code_system string, code string, code_display string, version int"
KEY = ("kind", "concept")
CODE = ("code_system", "code", "code_display")


def terminology_table(spark: SparkSession, terminologies: Mapping[str, tuple[str, Mapping[str, tuple[str, str]]]] = TERMINOLOGIES, version: int = 1) -> DataFrame:
    return spark.createDataFrame([(kind, c, system, code, show, version) for kind, (system, codes) in terminologies.items() for c, (code, show) in codes.items()], TERMINOLOGY)


def as_of(table: DataFrame, version: int | None = None) -> DataFrame:
    """The codes in force: of each concept the row of its latest version, up to version if one is given. A row whose code is null withdraws the concept's code."""
    known = table if version is None else table.where(F.col("version") <= version)
    latest = known.groupBy(*KEY).agg(F.max_by(F.struct(*CODE), F.struct("version", "code")).alias("c"))
    return latest.where("c.code is not null").select(*KEY, *(F.col(f"c.{n}").alias(n) for n in CODE))


def coded(entities: DataFrame, table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """entities (kind, concept, ...) with code_system, code and code_display from table (as_of()), nulls for concepts without a code."""
    return lookup_join(entities.drop(*CODE), table, KEY, "left", limit)


def misses(entities: DataFrame, table: DataFrame, kinds: tuple[str, ...] = tuple(TERMINOLOGIES), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Concepts of the kinds that table has no code for, and how often they occur. Occurrences are counted first, so that the join meets each concept once."""
    seen = entities.where(F.col("kind").isin(*kinds)).groupBy(*KEY).agg(F.count("*").alias("n"))
    return lookup_join(seen, table.select(*KEY), KEY, "left_anti", limit)
