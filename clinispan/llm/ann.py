"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample in the driver; every vector is then assigned and encoded in tasks. A
query probes the cells whose centroids are nearest, as many as the true neighbours of some queries, found by brute force, turn
out to need. Neighbouring cells make a shard, to which a query is sent once, with the cells that it probes there; asymmetric distance
tables rank their codes, and all that may be among the k nearest are ranked again by exact distance. Shards and their
queries are dealt out in blocks, so a crowded cell is no hot group. Vectors go with the codes, so that ties among very many near copies
are ranked where they lie, and a block gives no more than k rows a query.

How far a vector lies from its code is kept with it. A row whose code is farther from the query than that and the k-th least upper bound together cannot
be among the k nearest; all others are ranked exactly, so of the probed rows none is missed, however badly the codes fit. Cells and codes are made
of centred and scaled components in double precision: neither large values nor a large common offset drown the differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import drop, table

_ROW = "vec_id long, cell int, code binary, off double, vector array<double>"


@dataclass(frozen=True)
class Settings:
    """sample: vectors to fit on, at most; lists: coarse centroids, at most (the square root of the rows, if fewer); width:
    components in a subspace; probes: cells for a query, at least; recall: share of the true neighbours that the probed cells must hold
    (more are probed until they do); trials: queries that this is measured on, at most; wanted: rows that these must hold, or more cells are
    probed; rerank: codes of a block that are ranked exactly, at least; block: vectors of a task, and of a shard unless one
    cell has more; asked: queries of a task; rounds: of k-means; seed."""

    sample: int = 40_000
    lists: int = 4096
    width: int = 4
    probes: int = 32
    recall: float = 0.96
    trials: int = 256
    wanted: int = 1_000
    rerank: int = 200
    block: int = 16_384
    asked: int = 4_096
    rounds: int = 12
    seed: int = 17


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray
    books: np.ndarray  # subspace, code, component
    shift: np.ndarray
    scale: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale - self.shift


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part.

    Left out: null ids; vectors that are null, empty, zero, or hold null or non-finite components.
    """
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return df.where("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((to * to).sum(1) - 2 * (part @ to.T), axis=1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, int)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        count = np.bincount(at, minlength=len(centroids))
        total = np.stack([np.bincount(at, x[:, j], len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids[count > 0] = (total[count > 0] / count[count > 0, None]).astype(x.dtype)
    return centroids


def _split(x: np.ndarray, width: int) -> np.ndarray:
    """x as (row, subspace, component), zeros added at the end."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % width))).reshape(len(x), -1, width)


def fit(vectors: DataFrame, n: int, settings: Settings = Settings()) -> Model:
    """Fit on at most settings.sample of the n rows of vectors, picked by the hash of their ids."""
    share = min(1.0, settings.sample / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * settings.sample).toArrow()
    x = np.array(picked.column("vector").combine_chunks().flatten()).reshape(len(picked), -1)[: settings.sample]
    # Medians, as a single vast vector would make all others one point.
    scale = float(np.median(np.abs(x))) or float(np.abs(x).max())
    x = x / scale
    shift = np.median(x, axis=0)
    x = x - shift
    rng = np.random.default_rng(settings.seed)
    centroids = _k_means(x, max(1, min(settings.lists, int(n**0.5))), settings.rounds, rng)
    parts = _split(x - centroids[_nearest(x, centroids)], settings.width)
    return Model(centroids, np.stack([_pad(_k_means(np.ascontiguousarray(parts[:, s]), 256, settings.rounds, rng)) for s in range(parts.shape[1])]), shift, scale)


def _pad(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], 256 - len(book), axis=0)])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _encode(held, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            if not len(batch):
                continue
            x = model.scaled(_matrix(batch.column(1)))
            cells = _nearest(x, model.centroids)
            parts = _split(x - model.centroids[cells], width)
            codes = np.stack([_nearest(np.ascontiguousarray(parts[:, s]), book) for s, book in enumerate(model.books)], axis=1).astype(np.uint8)
            off = np.sqrt(((parts - model.books[np.arange(len(model.books)), codes]) ** 2).sum((1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), batch.column(1)], names=["vec_id", "cell", "code", "off", "vector"])

    return run


def _shards(centroids: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The shard of each cell: cells halved at the median of their widest component, until a shard has one cell or block vectors at most."""
    shard, todo, last = np.zeros(len(centroids), dtype=np.int32), [np.arange(len(centroids))], 0
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and sizes[cells].sum() > block:
            cells = cells[np.argsort(centroids[cells, np.ptp(centroids[cells], axis=0).argmax()], kind="stable")]
            todo += [cells[: len(cells) // 2], cells[len(cells) // 2 :]]
        else:
            shard[cells] = last
            last += 1
    return shard


def _probe(held, sizes: np.ndarray, shards: np.ndarray, probes: int, wanted: int):
    """A row for each query and shard that it probes cells of."""
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.list_(pa.float64())), ("shard", pa.int32()), ("cells", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = held.value.centroids
        for batch in batches:
            rows, at, cells, ends = [], [], [], [0]
            for i, q in enumerate(held.value.scaled(_matrix(batch.column(1)))):
                order = np.argsort(((to - q) ** 2).sum(1), kind="stable")
                last = max(probes, int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1)
                order = order[:last][sizes[order[:last]] > 0]
                order = order[np.argsort(shards[order], kind="stable")]
                which, count = np.unique(shards[order], return_counts=True)
                rows += [i] * len(which)
                at += which.tolist()
                cells.append(order)
                ends += (ends[-1] + np.cumsum(count)).tolist()
            taken = pa.array(rows, pa.int64())
            probed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cells) if cells else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken).cast(schema[1].type), pa.array(at, pa.int32()), probed], schema=schema)

    return run


def _true_cells(held, k: int):
    """The cells of each trial query's k nearest rows of a task, by exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = held.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(asked)
        for batch in batches:
            ids, cells, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
            for i, query_id in enumerate(asked):
                score = np.sqrt(((x - q[i]) ** 2).sum(1))
                score[ids == query_id] = np.inf
                near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
                near = near[score[near] < np.inf]
                score, at, cell = (np.concatenate(c) for c in zip(best[i], (score[near], ids[near], cells[near]), strict=True))
                order = np.lexsort((at, score))[:k]
                best[i] = (score[order], at[order], cell[order])
        rows = [np.repeat(np.arange(len(asked)), [len(b[0]) for b in best]), *(np.concatenate(c) for c in zip(*best, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["trial", "score", "vec_id", "cell"])

    return run


def probes_needed(asked: DataFrame, rows: DataFrame, model: Model, k: int, settings: Settings) -> int:
    """The fewest cells, but settings.probes, that hold settings.recall of the k true neighbours of trial queries, picked by the hash of their ids."""
    if settings.probes >= len(model.centroids):
        return settings.probes
    few = asked.orderBy(F.xxhash64("query_id")).limit(settings.trials).toArrow()
    if not len(few):
        return settings.probes
    q = _matrix(few.column("query"))
    trial = rows.sparkSession.sparkContext.broadcast((few.column("query_id").to_pylist(), q))
    near = rows.select("vec_id", "cell", "vector").mapInArrow(_true_cells(trial, k), "trial int, score double, vec_id long, cell int")
    near = near.withColumn("rank", F.expr("row_number() over (partition by trial order by score, vec_id)")).where(F.col("rank") <= k).select("trial", "cell").toArrow()
    place = np.stack([np.argsort(np.argsort(((model.centroids - x) ** 2).sum(1), kind="stable")) for x in model.scaled(q)])
    needed = np.sort(place[np.asarray(near.column("trial")), np.asarray(near.column("cell"))]) + 1
    return max(settings.probes, int(needed[max(0, int(np.ceil(settings.recall * len(needed))) - 1)])) if len(needed) else settings.probes


def _rough(model: Model, q: np.ndarray, cells: np.ndarray, codes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Squared distances by tables of q to the codes, which lie cell by cell, those of cells[i] from first[i] to first[i + 1]."""
    out, places = np.empty(len(codes)), np.arange(codes.shape[1])
    norms = (model.books * model.books).sum(2)
    for low in range(0, len(cells), 64):
        part = cells[low : low + 64]
        rest = _split(q - model.centroids[part], width)
        tables = norms[None] - 2 * np.einsum("csw,skw->csk", rest, model.books) + (rest * rest).sum(2)[:, :, None]
        a, b = first[low], first[low + len(part)]
        own = np.repeat(np.arange(len(part)), np.diff(first[low : low + len(part) + 1]))
        out[a:b] = tables[own[:, None], places, codes[a:b]].sum(1)
    return out


def _search(held, width: int, k: int, rerank: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        model: Model = held.value
        cell = np.asarray(rows.column("cell"))
        by_cell = np.argsort(cell, kind="stable")
        cell, ids, off, x = cell[by_cell], np.asarray(rows.column("vec_id"))[by_cell], np.asarray(rows.column("off"))[by_cell], _matrix(rows.column("vector"))[by_cell]
        codes, out = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[by_cell], []
        for query_id, q, cells in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("query")), queries.column("cells").to_pylist(), strict=True):
            cells = np.sort(np.array(cells))
            low, high = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            own = model.scaled(q)
            rough = np.sqrt(np.maximum(_rough(model, own, cells, codes[at], np.concatenate([[0], np.cumsum(high - low)]), width), 0))
            other = ids[at] != query_id
            at, rough = at[other], rough[other]
            # What rounding may take from the rough distances.
            slack = 1e-7 * (1 + np.sqrt((own * own).sum()))
            few = len(at) <= max(k, rerank)
            best = at if few else at[(rough <= np.partition(rough, rerank - 1)[rerank - 1]) | ~(rough - off[at] > np.partition(rough + off[at], k - 1)[k - 1] + slack)]
            exact = np.sqrt(((x[best] - q) ** 2).sum(1))
            order = np.lexsort((ids[best], exact))[:k]
            out.append((np.full(len(order), query_id), ids[best][order], exact[order]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance, double): the k nearest rows found of each query.

    queries has the columns of vectors. Candidates are the rows of vectors that take part (valid_vectors), but those with the
    query's id; ties go to the smaller vec_id; a query whose vector does not take part has no rows, and one id counts as one
    query (its least vector). Fewer than k candidates: all. Repeated rows are candidates each. Vectors of different lengths have no
    distance: each length is an index of its own (a table has a few at most, one run of the jobs for each).
    """
    every = table(valid_vectors(vectors, id_col, vector_col).withColumn("length", F.size("vector")))
    asked = valid_vectors(queries, id_col, vector_col).groupBy("vec_id", F.size("vector").alias("length")).agg(F.min("vector").alias("query"))
    asked = table(asked.withColumn("first", F.expr("row_number() over (partition by vec_id order by query)")).where("first = 1").select(F.col("vec_id").alias("query_id"), "query", "length"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length, n in sorted((r["length"], r["count"]) for r in every.groupBy("length").count().collect()):
        own = asked.where(F.col("length") == length).drop("length")
        out = out.union(_search_length(every.where(F.col("length") == length).drop("length"), own, n, k, settings))
    for df in (every, asked):
        drop(df)
    return out


def _search_length(base: DataFrame, asked: DataFrame, n: int, k: int, settings: Settings) -> DataFrame:
    """search() among the n vectors of base (vec_id, vector), all of one length, for asked (query_id, query)."""
    spark, made = base.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        made.append(out := table(df))
        return out

    held = spark.sparkContext.broadcast(fit(base, n, settings))
    rows = keep(base.mapInArrow(_encode(held, settings.width), _ROW))
    sizes = np.zeros(len(held.value.centroids), dtype=np.int64)
    for r in rows.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]

    shards = _shards(held.value.centroids, sizes, settings.block)
    counts = spark.createDataFrame([(int(s), int(v)) for s, v in enumerate(np.bincount(shards, sizes)) if v], "shard int, vectors long")
    of_cell = F.broadcast(spark.createDataFrame([(int(c), int(shards[c])) for c in np.flatnonzero(sizes)], "cell int, shard int"))

    def found(asked: DataFrame, probes: int, wanted: int) -> DataFrame:
        probed = asked.mapInArrow(_probe(held, sizes, shards, probes, wanted), "query_id long, query array<double>, shard int, cells array<int>")
        load = probed.groupBy("shard").agg(F.count("*").alias("queries"))
        deal = keep(counts.join(load, "shard").select("shard", F.ceil(F.col("vectors") / settings.block).cast("int").alias("nv"), F.ceil(F.col("queries") / settings.asked).cast("int").alias("nq")))
        v = rows.join(of_cell, "cell").join(F.broadcast(deal), "shard").withColumn("vb", F.expr("pmod(xxhash64(vec_id), nv)")).withColumn("qb", F.explode(F.expr("sequence(0L, nq - 1L)")))
        q = probed.join(F.broadcast(deal), "shard").withColumn("qb", F.expr("pmod(xxhash64(query_id), nq)")).withColumn("vb", F.explode(F.expr("sequence(0L, nv - 1L)")))
        key = ["shard", "vb", "qb"]
        both = q.select(*key, "query_id", "query", "cells").groupBy(*key).cogroup(v.select(*key, "vec_id", "cell", "code", "off", "vector").groupBy(*key))
        hits = both.applyInArrow(_search(held, settings.width, k, settings.rerank), "query_id long, vec_id long, score double")
        ranked = hits.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)"))
        return keep(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    hits = found(asked, probes_needed(asked, rows, held.value, k, settings), settings.wanted)
    full = hits.groupBy("query_id").count().where(F.col("count") >= k)
    short = keep(asked.join(full, "query_id", "left_anti"))
    if n > settings.wanted and not short.isEmpty():
        hits = hits.join(short.select("query_id"), "query_id", "left_anti").union(found(short, len(sizes), n))
    out = table(hits)
    for df in made:
        drop(df)
    return out
