"""Language identification by compression: the language whose dictionary makes the text smallest.

Each learned language has a raw-content zstandard dictionary of sampled texts. A text is compressed once with each, in
blocks that each begin with the dictionary alone, so that a long text gains from it as a short one does; the margin is how much larger
the second smallest sum of sizes is than the smallest, and a narrow margin rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDECIDED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and the margin.

    sample: documents that may be sampled for a language; dictionary: bytes of its dictionary, at most; total: bytes of all dictionaries, at
    most (with more languages each gets less, and none is left out); level: compression level; block: bytes compressed at a time; margin:
    relative to the second smallest size, below which a text is rejected.
    """

    sample: int = 400
    dictionary: int = 1 << 16
    total: int = 1 << 24
    level: int = 6
    block: int = 8192
    margin: float = 0.002


def normal(text: str) -> bytes:
    """The text as it is compressed: in lower case, runs of spaces as one, with a space at either end."""
    return f" {' '.join(text.lower().split())} ".encode()


def train(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """The dictionary of each language of labelled (text string, lang string), from a sample that repeats from run to run.

    Rows with a null lang or without text are left out. Texts are sampled by their hash, so copies count once, and
    follow each other until the dictionary is full, each as far as it could fill one. No labelled rows give no dictionary.
    """
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", "text").withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return {}
    size = min(settings.dictionary, settings.total // len(sizes))
    #: Twice the wanted share of each language by a threshold of the hash, so that the exact pick sorts a bounded rest.
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2 * settings.sample / r["n"]))))
    few = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    few = few.dropDuplicates(["lang", "h"]).withColumn("rank", F.expr("row_number() over (partition by lang order by h)")).where(F.col("rank") <= settings.sample)
    found: dict[str, list[bytes]] = {}
    # As many characters of a text as its dictionary has bytes, at most, come to the driver.
    for r in few.orderBy("lang", "rank").select("lang", F.substring("text", 1, size).alias("text")).toLocalIterator():
        if sum(map(len, found.setdefault(r["lang"], []))) < size:
            found[r["lang"]].append(normal(r["text"]))
    return {lang: b"\n".join(texts)[:size] for lang, texts in found.items()}


def _classify(dictionaries: dict[str, bytes], settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(dictionaries)
        tools = []
        for name in names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=settings.level)
            tools.append(zstandard.ZstdCompressor(level=settings.level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            best, margins = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                if not names or text is None or not any(map(str.isalpha, text)):
                    best.append(UNDECIDED)
                    margins.append(0.0)
                    continue
                data = normal(text)
                blocks = [data[i : i + settings.block] for i in range(0, len(data), settings.block)]
                sizes = sorted((sum(len(tool.compress(block)) for block in blocks), name) for tool, name in zip(tools, names, strict=True))
                best.append(sizes[0][1])
                margins.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(margins, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """docs with lang_pred (a learned language; 'und' for a null text or one without a letter), score and rejected.

    score is the margin, 0 to 1; equal sizes go to the language that comes first in the alphabet, with score 0. rejected
    is true for 'und' and for a score under settings.margin (lang_pred is then still the smallest). Without a learned
    language every text is 'und'. Columns of docs with these names are replaced; the others stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches):
        return _classify(held.value, settings)(batches)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    found = docs.select(*kept, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
    return found.withColumn("rejected", (F.col("lang_pred") == UNDECIDED) | (F.col("score") < settings.margin))
