"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Documents are dealt to shards of bounded size by a hash that no source, copy or repeated row can crowd; each shard is
packed by best fit, longest piece first. Bins are kept in the order of their residuals, each with a bitmap of the sources and one
of the duplicate clusters it holds; the search starts at the first bin with room and goes on to its successors until one is
compatible, which is the tightest compatible bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "bin_id string, slot int, doc_id long, copy int, piece int, start long, n_tokens long, source string, cluster long"


@dataclass(frozen=True)
class Settings:
    """capacity: tokens in a bin; shard: pieces in a shard, on average; per_source: whether a bin takes one piece of a source at most."""

    capacity: int = 2048
    shard: int = 4096
    per_source: bool = True


def word_count(text: Column) -> Column:
    """Words (runs of anything but space and the ASCII controls tab to carriage return); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_cluster(text: Column) -> Column:
    """The duplicate cluster of equal texts: a hash of the text without case and without the kind and number of its spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))


class Bins:
    """Open bins in the order of their residuals, with bitmaps as rows of 64-bit words."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity, self.count = capacity, 0
        self.left = np.zeros(0, np.int64)  # residuals, ascending
        self.ids = np.zeros(0, np.int64)
        size = 64
        self.sources = np.zeros((size, sources // 64 + 1), np.uint64)  # by bin
        self.clusters = np.zeros((size, clusters // 64 + 1), np.uint64)

    def place(self, n: int, source: int, cluster: int) -> int:
        """The bin that takes a piece of n tokens; source and cluster are bits, -1 for one that never conflicts."""
        at = int(np.searchsorted(self.left, n))
        ids = self.ids[at:]
        fits = np.ones(len(ids), bool)
        for bits, bit in ((self.sources, source), (self.clusters, cluster)):
            if bit >= 0:
                fits &= (bits[ids, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 0
        step = int(fits.argmax()) if len(fits) else 0
        if len(fits) and fits[step]:
            found, left = int(ids[step]), int(self.left[at + step]) - n
            self.left, self.ids = np.delete(self.left, at + step), np.delete(self.ids, at + step)
        else:
            found, left = self.count, self.capacity - n
            self.count += 1
            if found == len(self.sources):
                self.sources, self.clusters = (np.concatenate([b, np.zeros_like(b)]) for b in (self.sources, self.clusters))
        for bits, bit in ((self.sources, source), (self.clusters, cluster)):
            if bit >= 0:
                bits[found, bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)
        if left:
            to = int(np.searchsorted(self.left, left))
            self.left, self.ids = np.insert(self.left, to, left), np.insert(self.ids, to, found)
        return found


def _bits(values: list) -> list[int]:
    """A bit for each value that two rows or more have; -1 for one of a kind, which conflicts with nothing."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    place = {v: i for i, v in enumerate(v for v, n in count.items() if n > 1)}
    return [place.get(v, -1) for v in values]


def _pack(settings: Settings):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sources = shard.column("source").to_pylist()
        source_bits = _bits(sources) if settings.per_source else [-1] * len(sources)
        cluster_bits = _bits(shard.column("cluster").to_pylist())
        bins = Bins(settings.capacity, max(source_bits, default=0) + 1, max(cluster_bits, default=0) + 1)
        name, slots, ids, slot = shard.column("shard")[0].as_py(), {}, [], []
        for n, s, c in zip(shard.column("n_tokens").to_pylist(), source_bits, cluster_bits, strict=True):
            found = bins.place(n, s, c)
            ids.append(f"{name}-{found}")
            slot.append(slots.get(found, 0))
            slots[found] = slot[-1] + 1
        columns = {"bin_id": pa.array(ids, pa.string()), "slot": pa.array(slot, pa.int32()), **{c: shard.column(c) for c in ("doc_id", "copy", "piece", "start", "n_tokens", "source", "cluster")}}
        return pa.table(columns)

    return run


def pack(docs: DataFrame, settings: Settings = Settings(), n_tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """A row per piece of a row of docs: bin_id, slot in the bin, doc_id, copy, piece, start and n_tokens of the piece, source, cluster.

    docs: doc_id long, text string, source string; more columns are left out. n_tokens (default: words) and cluster (default:
    equal texts but for case and spaces) are columns of docs. Rows longer than the capacity are cut into pieces: full ones fill a bin each
    and the rest is packed. No token is lost: rows without tokens (null or blank texts) make one piece of none. A bin holds
    no two pieces of one cluster and, with per_source, of one source; a null source never conflicts. Rows that are equal in doc_id, tokens,
    source and cluster are copies 0, 1, ... of it. The result does not depend on partitions or the order of rows.
    """
    cap = settings.capacity
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (word_count(F.col("text").cast("string")) if n_tokens is None else n_tokens.cast("long")).alias("tokens"),
        (text_cluster(F.col("text").cast("string")) if cluster is None else cluster.cast("long")).alias("cluster"),
    )
    rows = rows.groupBy("doc_id", "source", "tokens", "cluster").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.expr("sequence(0, cast(copies - 1 as int))")))
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(0L, (tokens - 1) div {cap}L) as int))"))).withColumn("start", F.col("piece").cast("long") * cap).withColumn("n_tokens", F.least(F.lit(cap).cast("long"), F.col("tokens") - F.col("start")))
    pieces = pieces.select("doc_id", "copy", "piece", "start", "n_tokens", "source", "cluster")
    full = pieces.where(F.col("n_tokens") == cap)
    alone = full.select(F.format_string("f-%s-%s-%s-%s-%s", "doc_id", "copy", "piece", "cluster", F.coalesce(F.col("source"), F.lit(""))).alias("bin_id"), F.lit(0).alias("slot"), *pieces.columns)
    shards = max(1, -(-docs.count() // settings.shard))
    rest = pieces.where(F.col("n_tokens") < cap).withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, cluster, source, copy), {shards}L)"))
    # A null source gets a value of its own row's, so that it meets no other.
    own = rest.withColumn("source", F.coalesce("source", F.format_string("\0%s-%s-%s", "doc_id", "copy", "cluster")))
    packed = own.groupBy("shard").applyInArrow(_pack(settings), _OUT)
    return alone.unionByName(packed.withColumn("source", F.when(~F.col("source").startswith("\0"), F.col("source"))))
