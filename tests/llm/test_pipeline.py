"""The corpus pipeline: each stage and run() against plain versions on a small fixture, and every stage on awkward rows."""

import math
import random
import re

import zstandard
from pyspark.sql import functions as F
from test_pairs_and_spans import WORD, components, linked, lowered, shingles

import corpus_pipeline
from clinispan.llm import language_id, mixing, packing

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    """Two languages, exact and near copies of documents and lines, a hot source, a long document, junk."""
    rng = random.Random(21)
    words = {"en": ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(600)], "fr": ["".join(rng.choice("mnopqrstuv") for _ in range(rng.randrange(2, 9))) for _ in range(600)]}

    def line(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows = []
    for i in range(40):
        lang = "en" if i % 3 else "fr"
        rows.append((i, "\n".join(line(lang, rng.randrange(12, 40)) for _ in range(rng.randrange(2, 5))), lang, "hot" if i % 2 else f"s{i % 5}"))
    rows += [(50 + i, rows[i][1], rows[i][2], "copies") for i in range(4)]
    for i in range(4, 10):
        lines = rows[i][1].split("\n")
        own = line(rows[i][2], 30)
        rows.append((60 + i, "\n".join([lines[0].replace(lines[0].split()[5], "changed", 1), *lines[1:], own]), rows[i][2], "near"))
    rows += [(80, "\n".join(line("en", 30) for _ in range(150)), "en", "s1"), (81, None, "en", "s1"), (82, "", "fr", "s2"), (83, "12 34 !!", "fr", "s2"), (84, line("en", 25), None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def plain_language(rows, dictionaries, settings=language_id.Settings()):
    out = []
    for i, text, _, source, n in rows:
        if not text or not any(c.isalpha() for c in text):
            continue
        data = (" " + " ".join(text.lower().split()) + " ").encode()
        sizes = []
        for name, raw in dictionaries.items():
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((sum(len(zstandard.ZstdCompressor(level=settings.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[a : a + settings.block])) for a in range(0, len(data), settings.block)), name))
        sizes.sort()
        if 1 - sizes[0][0] / sizes[1][0] >= settings.margin:
            out.append((i, text, sizes[0][1], source, n))
    return out


def plain_lines(rows):
    places = [(i, p, x.strip(" \t\r\f\v")) for i, text, *_ in rows for p, x in enumerate((text or "").split("\n"))]
    places = sorted((x for x in places if x[2]), key=lambda x: x[:2])
    distinct = sorted({x for _, _, x in places})
    group = {t: k for t, k in zip(distinct, linked(distinct).values(), strict=True)}
    first = {}
    for i, p, x in places:
        first.setdefault(group[x], (i, p))
    out = []
    for i, text, lang, source, n in rows:
        all_ = (text or "").split("\n")
        kept = [x for p, x in enumerate(all_) if not x.strip(" \t\r\f\v") or first[group[x.strip(" \t\r\f\v")]] == (i, p)]
        lost = len(kept) < len(all_)
        if not lost or any(x.strip(" \t\r\f\v") for x in kept):
            new = text if not lost else "\n".join(kept)
            out.append((i, new, lang, source, len(new) if new is not None else None))
    return out


def plain_join(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    edges = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    low = components({i for i, _ in sets}, edges)
    return [r for r in rows if low[r[0]] == r[0]]


def plain_weights(tokens, repeats):
    """The exponent, by trying them in steps, and the weights."""
    total = sum(tokens.values())

    def weights(e):
        norm = sum((t / total) ** e for t in tokens.values())
        return {s: (t / total) ** e / norm for s, t in tokens.items()}

    e = next(k / 2000 for k in range(2001) if all(weights(k / 2000)[s] * total / t <= repeats + 1e-9 for s, t in tokens.items()))
    return weights(e)


def plain_pack(rows, capacity):
    """Best fit, longest first: the contents of the bins."""
    pieces = []
    for i, text, _, source, _ in rows:
        n = len(WORD.findall(text or ""))
        cluster = re.sub(r"\s+", " ", (text or "").lower()).strip()
        copy = sum(1 for p in pieces if p[1] == i and p[3] == cluster and p[2] == 0 and p[5] == source)
        pieces += [(min(capacity, n - at), i, at, cluster, copy, source) for at in range(0, max(n, 1), capacity)]
    full = [[p] for p in pieces if p[0] == capacity]
    bins = []
    for p in sorted((p for p in pieces if p[0] < capacity), key=lambda p: (-p[0], p[1], p[4], p[2])):
        fits = [b for b in bins if 0 < capacity - sum(q[0] for q in b) >= p[0] and all(q[3] != p[3] and (q[5] != p[5] or p[5] is None) for q in b)]
        best = min(fits, key=lambda b: capacity - sum(q[0] for q in b), default=None)
        if best is None:
            bins.append([p])
        else:
            best.append(p)
    return full + bins


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_against_plain_versions(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, now = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    dictionaries = language_id.train(docs)
    plain = {"language_id": lambda r: plain_language(r, dictionaries), "line_dedup": plain_lines, "ngram_jaccard_join": plain_join}
    removed = {}
    for name in plain:
        got = STAGES[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        want = plain[name](now)
        assert key(got.collect()) == key(want), name
        removed[name] = len(now) - len(want)
        now = want
        docs = spark.createDataFrame(now, COLUMNS)
    assert removed["language_id"] >= 3 and removed["line_dedup"] >= 4

    mixed = STAGES["source_mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= {tuple(r) for r in now}
    tokens, biggest, taken = {}, {}, {}
    for r in now:
        n = len(WORD.findall(r[1] or ""))
        tokens[r[3]], biggest[r[3]] = tokens.get(r[3], 0) + n, max(biggest.get(r[3], 0), n)
    for r in got:
        taken[r[3]] = taken.get(r[3], 0) + len(WORD.findall(r[1]))
    tokens = {s: n for s, n in tokens.items() if n}
    for s, w in plain_weights(tokens, mixing.Settings().repeats).items():
        # Nearly every block is one document here, so half a document is what a source may miss its target by.
        assert abs(taken.get(s, 0) - w * sum(tokens.values())) <= biggest[s] + 2

    packed = STAGES["best_fit_packing"](spark, spark.createDataFrame(got, COLUMNS), str(tmp_path)).collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["bin_id"], []).append((r["n_tokens"], r["doc_id"], r["start"], r["copy"]))
    want = [sorted((p[0], p[1], p[2], p[4]) for p in b) for b in plain_pack(got, packing.Settings().capacity)]
    assert sorted(sorted(b) for b in bins.values()) == sorted(want)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert key(whole.collect()) == key(packed)


def test_every_stage_on_awkward_rows(spark, docs, empty):
    """Nulls in any column, empty and long texts, repeated rows, ties and clashing names lose nothing that a stage does not say."""
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name
        out = stage(spark, docs, "").collect()
        ids = [r["doc_id"] for r in out]
        if name != "best_fit_packing":
            assert list(out[0].asDict()) == docs.columns, name
        if name == "language_id":
            # Every label is 'x', so it is all that a text with letters can be told as; the others are rejected.
            assert {40, 41, 42}.isdisjoint(ids) and set(ids) <= {r["doc_id"] for r in docs.collect()} and {r["lang"] for r in out} <= {"x"}
        if name in ("line_dedup", "ngram_jaccard_join"):
            assert {40, 41, 42, None} <= set(ids) and len(ids) <= kept
        if name == "source_mixing":
            # A budget takes less of a dominant source, so which of its documents are left out is not fixed; what has no words goes.
            assert ids and {40, 41, 42}.isdisjoint(ids) and set(ids) <= {r["doc_id"] for r in docs.collect()}
        if name == "best_fit_packing":
            assert sum(r["n_tokens"] for r in out) == docs.agg(F.sum(packing.word_count(F.col("text")))).first()[0]
            assert {i for i in ids if i is not None} == {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None}


def test_lowered_is_ascii_only():
    assert lowered("AÉZ") == "aÉz" and math.isclose(sum(plain_weights({"a": 90, "b": 10}, 2.0).values()), 1)
