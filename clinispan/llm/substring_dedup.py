"""Removal of word sequences that an earlier document has too, by Rabin-Karp hashes of fixed-length word windows.

Every window of k words could repeat, but few do. A first pass keeps of each document only anchors, picked by winnowing
from the hashes of its shorter windows: any two equal windows of k words hold a common anchor at one place. Windows around
anchors that two documents share are then hashed one by one, counted in Spark by hash, and those whose smallest document is
not their own are merged into maximal intervals. No repeat is missed, and most windows never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm import tokens
from clinispan.llm.scratch import BROADCAST_ROWS, drop, join_counted, small, table

#: Words in an anchor; a window of k words holds k - ANCHOR + 1 places for one. Less for k under twice as long.
ANCHOR = 12
_KEY = ["doc_id", "s1", "s2"]


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each run of width entries, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some run of width places."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = _slide(hashes, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_slide(padded, width, np.maximum) == hashes)


def _prepare(k: int, short: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("words", pa.large_string()), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, w in tokens.groups(batch.column(1), lower=False):
                grams = tokens.windows(w.hashes, short)
                n, s1, s2, text, h, at = [], [], [], [], [], []
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    n.append(b - a)
                    text.append(b" ".join(w.data[w.starts[a] : w.ends[b - 1]].tobytes().split()) if b > a else b"")
                    whole = xxhash.xxh3_128_intdigest(text[-1])
                    s1.append(whole >> 64)
                    s2.append(whole & 0xFFFFFFFFFFFFFFFF)
                    own = grams[a : b - short + 1] if b - a >= k else grams[:0]
                    places = winnow(own, k - short + 1)
                    h.append(tokens.signed(own[places]))
                    at.append(places)
                columns = [batch.column(0).slice(done, len(n)), n, np.array(s1, np.uint64).view(np.int64), np.array(s2, np.uint64).view(np.int64), pa.array(text, pa.large_binary()).cast(pa.large_string()), h, at]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                done += len(n)

    return run, "doc_id long, n_words long, s1 long, s2 long, words string, h array<long>, at array<int>"


def _near_anchors(k: int, short: int):
    """The windows of k words of rows (doc_id, s1, s2, words, at) that hold an anchor at one of the places at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, s1, s2, ats = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            row = 0
            for _, w in tokens.groups(batch.column(3), lower=False):
                w1 = tokens.windows(w.hashes, k)
                w2 = tokens.windows(tokens.mix(w.hashes ^ np.uint64(0x2545F4914F6CDD1D)), k)
                out = []
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    edge, n, places = np.zeros(b - a + 1, np.int64), b - a - k + 1, np.array(ats[row])
                    np.add.at(edge, np.maximum(places + short - k, 0), 1)
                    np.add.at(edge, np.minimum(places + 1, n), -1)
                    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                    out.append((w1[a + starts], (w2[a + starts] >> np.uint64(33)), np.full(len(starts), ids[row]), np.full(len(starts), s1[row]), np.full(len(starts), s2[row]), starts))
                    row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(c) if i == 0 else c.astype(np.int64), t) for i, (c, t) in enumerate(zip(columns, kinds, strict=True))], names=["w1", "w2", "doc_id", "s1", "s2", "start"])

    return run, "w1 long, w2 int, doc_id long, s1 long, s2 long, start int"


def _cut(k: int):
    """Rows (doc_id, n_words, words, starts) with the maximal intervals that the windows at starts cover, and the words left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for words, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                all_ = words.split(" ")
                edge = np.zeros(len(all_) + 2, np.int64)
                np.add.at(edge, np.array(starts) + 1, 1)
                np.add.at(edge, np.array(starts) + k + 1, -1)
                inside = np.cumsum(edge) > 0
                turn = np.flatnonzero(inside[1:] != inside[:-1])
                spans.append([{"start": a, "end": b} for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)])
                kept.append(" ".join(x for x, gone in zip(all_, inside[1:], strict=False) if not gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.large_string())], schema=schema)

    return run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """A row per row of docs: doc_id, n_words, spans (removed intervals of words, maximal, half-open), kept (the other words, joined by one space).

    docs: doc_id long, text string; more columns are left out. Words are runs of anything but space and the ASCII
    controls tab to carriage return, as they are. A word is removed if a window of k words that covers it, in its own
    document, also starts in a document with a smaller doc_id; windows are judged on the input. A null text has no
    words and leaves ''. Rows with a null doc_id keep all words and are no source of removals. Rows with one doc_id do
    not remove from each other. Documents of under k words keep all.
    """
    short = min(ANCHOR, max(1, k // 2))
    run, schema = _prepare(k, short)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = table(docs.mapInArrow(run, schema))
    whole = base.where(F.col("n_words") >= k).where("doc_id is not null")
    first = table(whole.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("s1", "s2", "low", "n"))
    copies = table(join_counted(whole.select(*_KEY), first, ["s1", "s2"], "n").where("doc_id > low").select(*_KEY).distinct())
    own = whole.join(small(copies), _KEY, "left_anti")
    anchors = own.select(*_KEY, F.explode(F.arrays_zip("h", "at")).alias("x")).select(*_KEY, "x.h", "x.at")
    shared = table(anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("h", "n"))
    # join_counted() shuffles the anchors of all texts from fewer keys on than are broadcast here.
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = anchors.join(F.broadcast(shared.select("h")), "h", "left_semi") if few else join_counted(anchors, shared, "h", "n")
    hits = table(met.groupBy(*_KEY).agg(F.collect_set("at").alias("at")))
    run, schema = _near_anchors(k, short)
    texts = own.select(*_KEY, "words").join(small(hits.select(*_KEY)), _KEY, "left_semi")
    found = table(texts.join(hits, _KEY).select(*_KEY, "words", "at").mapInArrow(run, schema))
    repeated = table(found.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("w1", "w2", "low", "n"))
    starts = join_counted(found, repeated, ["w1", "w2"], "n").where("doc_id > low").groupBy(*_KEY).agg(F.collect_set("start").alias("starts"))
    starts = table(starts)
    for df in (first, shared, hits, found, repeated):
        drop(df)
    run, schema = _cut(k)
    row = ["doc_id", "n_words", "words"]
    cut = base.join(small(starts.select(*_KEY)), _KEY, "left_semi").join(starts, _KEY).select(*row, "starts").mapInArrow(run, schema)
    touched = small(starts.select(*_KEY).union(copies))
    left = base.join(touched, _KEY, "left_anti").select("doc_id", "n_words", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.col("words").alias("kept"))
    gone = base.join(small(copies), _KEY, "left_semi").select("doc_id", "n_words", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("spans"), F.lit("").alias("kept"))
    return left.union(cut).union(gone)
