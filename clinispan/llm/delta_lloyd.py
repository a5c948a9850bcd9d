"""Centroid clustering by Lloyd's rounds in integers, each of which looks only at what the one before changed.

Assignments, distances and the centroids' sums are tables that each round reads and writes anew. A vector is compared with the centroids that
changed, and with all of them only if its own went farther away: no other can have come nearer. Vectors that change hands make signed
transfers, added up in the tasks; the sums take them in, so no round adds up all vectors but the first. What the driver holds is
a number for each centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import drop, table

#: Greatest magnitude of a component, before scaling: squared distances of 64 such components fit a long.
GREATEST = 1 << 19
#: Magnitude of scaled components up to which sums of products are exact as doubles.
_EXACT = 1 << 22
_STATE = "vec_id long, q array<int>, was int, cluster int, distance long"
_COUNT = -1


@dataclass(frozen=True)
class Settings:
    """k: centroids; rounds: of assigning and replacing; length: components of the vectors that take part; scale: steps of a unit; seed: of the order in which the first k vectors are taken."""

    k: int = 40
    rounds: int = 5
    length: int = 64
    scale: int = 256
    seed: int = 2


def whole_vectors(vectors: DataFrame, settings: Settings, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q array<int>) of the vectors that take part."""
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = df.where(f"v is not null and size(v) = {settings.length} and forall(v, x -> x is not null and not isnan(x) and abs(x) <= {GREATEST})")
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x * settings.scale).cast("int")).alias("q"))


def _distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly, as longs."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT else np.int64
    x, c = q.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def _assign(held):
    """Each vector's nearest centroid, from its last one, its distance then, and the centroids that have changed since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, changed = held.value
        numbers = np.flatnonzero(changed)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            q = np.asarray(batch.column("q").flatten()).reshape(n, -1)
            was = np.asarray(batch.column("cluster").fill_null(-1))
            before = np.asarray(batch.column("distance").fill_null(0))
            owner, own = was.astype(np.int64), before.copy()
            near = _distances(q, centroids[numbers])
            place = np.searchsorted(numbers, owner).clip(0, max(len(numbers) - 1, 0))
            moved = (owner >= 0) & (numbers[place] == owner if len(numbers) else False)
            own[moved] = near[moved, place[moved]]
            if len(numbers):
                best = near.argmin(1)
                least, number = near[np.arange(n), best], numbers[best]
                better = (least < own) | ((least == own) & (number < owner))
                owner[better], own[better] = number[better], least[better]
            again = np.flatnonzero((was < 0) | (moved & (near[np.arange(n), place] > before) if len(numbers) else False))
            if len(again):
                every = _distances(q[again], centroids)
                owner[again] = every.argmin(1)
                own[again] = every.min(1)
            columns = [batch.column("vec_id"), batch.column("q"), batch.column("cluster"), pa.array(owner, pa.int32()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "was", "cluster", "distance"])

    return run


def _transfers(k: int, length: int):
    """A task's signed sums of the vectors that changed hands: out of was, into cluster. One row per centroid; the count is component -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, length + 1), dtype=np.int64)
        for batch in batches:
            q = np.asarray(batch.column("q").flatten()).reshape(len(batch), -1).astype(np.int64)
            q = np.concatenate([np.ones((len(q), 1), np.int64), q.reshape(len(q), length)], axis=1)
            for column, sign in (("was", -1), ("cluster", 1)):
                at = np.asarray(batch.column(column).fill_null(-1))
                order = np.argsort(at, kind="stable")
                order = order[at[order] >= 0]
                if len(order):
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    total[at[order][first]] += sign * np.add.reduceat(q[order], first, axis=0)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "total"])

    return run


def cluster(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster (int), distance (long, squared), cluster_inertia, inertia (long), centroid_sha256: a row per vector that takes part.

    Vectors take part that have settings.length components, all finite and of a magnitude up to GREATEST (beyond it squared distances do
    not fit a long); a null id doesn't keep one out, but it is no first centroid; repeated rows count each. Each component x becomes
    floor(scale * x). Centroids 0, 1, ... start as the k vectors with smallest SHA-256 of 'seed:id' (equal ids: smallest vector first); fewer vectors, fewer
    centroids. A round gives each vector the nearest centroid (ties: the smaller number), then replaces each that has vectors by
    their componentwise floor(sum / count). After the rounds vectors are assigned once more. Rounds after one that changes no centroid
    would change nothing and are not run. A sum that does not fit a long is null. No vectors give no rows.
    """
    spark = vectors.sparkSession
    base = table(whole_vectors(vectors, settings, id_col, vector_col))
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    first = base.where("vec_id is not null").orderBy(order, "q").limit(settings.k).select("q").collect()
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, settings.length)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    changed = np.ones(len(centroids), dtype=bool)
    state = base.select("vec_id", "q", F.lit(None).cast("int").alias("was"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    sums = None
    for r in range(settings.rounds + 1):
        used, state = state, table(state.mapInArrow(_assign(spark.sparkContext.broadcast((centroids, changed))), _STATE))
        drop(used)
        if r == settings.rounds:
            break
        moved = state.where("not (was <=> cluster)").mapInArrow(_transfers(len(centroids), settings.length), "cluster int, total array<long>")
        moved = moved.select("cluster", F.posexplode("total").alias("at", "total")).select("cluster", F.col("at") + _COUNT, F.col("total").cast("decimal(38,0)"))
        every = (moved if sums is None else sums.union(moved)).toDF("cluster", "at", "total").groupBy("cluster", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
        used, sums = sums, table(every)
        if used is not None:
            drop(used)
        centroids, changed = _replaced(centroids, sums.collect())
        if not changed.any():
            break
    if sums is not None:
        drop(sums)
    inertia = {x["cluster"]: int(x["d"]) for x in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    rows = [(c, _fitting(d), _fitting(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _fitting(x: int) -> int | None:
    return x if x < 1 << 63 else None


def _replaced(centroids: np.ndarray, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after a round (those without vectors stay), and which differ."""
    count = {r["cluster"]: int(r["total"]) for r in sums if r["at"] == _COUNT}
    now = centroids.copy()
    for r in sums:
        if r["at"] != _COUNT and count[r["cluster"]]:
            now[r["cluster"], r["at"]] = int(r["total"]) // count[r["cluster"]]
    return now, (now != centroids).any(1)
