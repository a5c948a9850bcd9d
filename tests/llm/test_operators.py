"""Archives, URLs, languages, neighbours, packing, mixing and fingerprints against brute force, round trips and held-out rows."""

import hashlib
import io
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from clinispan.llm import ann, fingerprints, language_id, mixing, packing, queries, url_filter, warc
from clinispan.llm.scratch import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_statement_agrees(spark, sf, name):
    assert difference(spark, connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_packages_round_trip(spark, tmp_path):
    html = ["<p>one</p>", "<p>one</p>", None, "", "é中😀", "x" * 300_000, "<p>one</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n{i}", h, "z") for i, h in enumerate(html)] + [(None, None, "solo", "z")], "page_id long, url string, html string, sha string")
    listed = warc.write_packages(pages, f"file://{tmp_path}/w")
    got = {r["key"]: r for r in warc.read_packages(listed).collect()}
    assert len(got) == 8
    for i, h in enumerate(html):
        group = [j for j, x in enumerate(html) if (x or "") == (h or "")]
        first = i == max(group)
        assert (got[i]["type"], got[i]["refers_to"]) == (("response", None) if first else ("revisit", max(group)))
        assert bytes(got[i]["payload"]) == ((h or "").encode() if first else b"")
        assert got[i]["digest"] == warc.base32_sha1((h or "").encode())
    full = {r["key"]: r["payload_bytes"] for r in warc.archive_and_read(pages).collect()}
    assert [full[i] for i in range(7)] == [len((h or "").encode()) for h in html]
    for path in tmp_path.glob("w/*.zip"):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_small_payloads_do_not_refer(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["key"]: r["type"] for r in warc.archive_and_read(pages, min_payload=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_directory_with_zip64_records():
    """An archive by hand whose sizes, offset and counts are only in ZIP64 fields."""
    data, name = b"hello", b"a/b"
    extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data
    pad = b"#" * 100
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(pad + local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    f = io.BytesIO(pad + local + central + end64 + locator + end)
    (member,) = warc.directory(f)
    assert member == warc.Member("a/b", 0, 5, 5, 100)
    f.seek(warc.data_offset(f, member))
    assert f.read(member.size) == data
    for broken in (b"", b"PK\x05\x06", b"no archive at all"):
        with pytest.raises(warc.ArchiveError):
            warc.directory(io.BytesIO(broken))


def test_urls_against_every_rule(spark):
    rules = [url_filter.UrlRule(*r) for r in (("block", "b.com", "/x"), ("allow", "a.b.com", "/x/y"), ("block", "org", "/"), ("allow", "deep.v.w.org", "/1/2/3/"), ("block", "b.com", "/x/y/z.html"))]
    urls = ["http://b.com/xy", "http://A.B.com/x/yz?q=/x", "https://q.a.b.com/x/y/z.html", "http://org", "http://org/", "x.org/", None, "", "a://z.deep.v.w.org/1/2/3/4#x", "a://b.com/x/y/z.html/more", "http://u:p@b.com:80/x", "http://notb.com/x", "http://b.com", "http://b.com/" + "x/" * 2000, "http://" + "s." * 500 + "b.com/x", "one://two://b.com/x", "http://a.b.com\n/x/y"]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)] + [(0, urls[0], "r", "h")], "page_id long, url string, rule string, full string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = r["url"]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((best.host + best.path, best.verdict) if best else (None, "allow"))
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_language_of_held_out_rows(spark, sf):
    r = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = r.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.9


def test_language_edges(spark):
    rows = [("the cat and the dog are in the house", "en"), ("le chat et le chien sont dans la maison", "fr"), (None, "en"), ("", "fr"), ("nothing", None)]
    learned = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(learned) == {"en", "fr"}
    asked = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 !? 34", 0.5), (4, "the dog and the cat", 0.5), (5, "le chien et le chat " * 5000, 0.5)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in language_id.identify(asked, learned).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "und", "en", "fr"]
    assert [got[i]["rejected"] for i in range(1, 5)] == [True, True, True, False]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(asked, {}).collect()} == {"und"}
    assert language_id.train(spark.createDataFrame([], "text string, lang string")) == {}


def long_text_score(n, settings):
    """The score of a text of n characters in words of one of two languages, whose order no dictionary knows."""
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(4000)] for lang, letters in (("aa", "abcdefghijklm"), ("bb", "nopqrstuvwxyz"))}
    learned = {lang: " ".join(rng.choice(w) for _ in range(9000)).encode()[: settings.dictionary] for lang, w in words.items()}
    text = " ".join(rng.choice(words["aa"]) for _ in range(n // 7))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    (got,) = language_id._classify(learned, settings)(iter([batch]))
    assert got.column(0)[0].as_py() == "aa"
    return got.column(1)[0].as_py()


def test_score_does_not_depend_on_length():
    settings = language_id.Settings()
    assert long_text_score(3_000_000, settings) > 0.9 * long_text_score(20_000, settings) > 0.1


def brute(vectors, query, k):
    x = np.array(dict(vectors)[query])
    return sorted((math.dist(x, v), i) for i, v in vectors if i != query)[:k]


def test_neighbours_recall_and_order(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in e.collect()]
    few = ann.Settings(probes=4, wanted=60, rerank=50)
    for settings, least in ((ann.Settings(), 0.9), (few, 0.5)):
        got = {}
        for r in ann.search(e, e.where("vec_id % 100 = 0"), 10, settings).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        hits = 0
        for q, found in got.items():
            want = brute(rows, q, 10)
            found.sort()
            assert [f[0] for f in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[1], f[2]))
            assert all(math.isclose(s, math.dist(dict(rows)[q], dict(rows)[i]), rel_tol=1e-12) for _, s, i in found)
            hits += len({i for _, i in want} & {f[2] for f in found})
        assert hits >= least * 10 * len(got)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    got = [tuple(r) for r in ann.search(df, df, 10).collect()]
    assert sorted(got) == sorted((q, r, v, 0.0) for q in range(3) for r, v in enumerate((x for x in range(3) if x != q), 1))
    assert ann.search(df.limit(0), df.limit(0)).collect() == [] and ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_neighbours_recall_where_probing_is_selective(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(13_000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got) and len(got) == 130


def test_neighbours_among_many_copies(spark):
    rng = random.Random(4)
    ids = list(range(1000))
    rng.shuffle(ids)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in ids] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1000, 1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.search(df, df.where("vec_id = 500"), 10).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(i + 1, i, 0.0) for i in range(10)]


@pytest.mark.parametrize("make", [lambda x, r: x * 1e22, lambda x, r: x * np.exp(3 * r.normal(size=(len(x), 1))), lambda x, r: np.concatenate([x, x[:5] * 1e25])], ids=["huge", "uneven", "outliers"])
def test_nearest_neighbours_of_large_and_uneven_vectors(spark, make):
    rng = np.random.default_rng(4)
    x = make(rng.normal(size=(4000, 32)), rng)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 100):
        score = ((x - x[q]) ** 2).sum(1)
        score[q] = np.inf
        hits += len(got[q] & set(np.argsort(score, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 10 * len(range(0, len(x), 100))


def test_packing_loses_nothing_and_keeps_apart(docs):
    settings = packing.Settings(capacity=100, shard=8)
    got = packing.pack(docs, settings).collect()
    words = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert sum(r["n_tokens"] for r in got) == words and len({(r["doc_id"], r["cluster"], r["copy"], r["piece"], r["source"]) for r in got}) == len(got)
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for rows in bins.values():
        assert sum(r["n_tokens"] for r in rows) <= 100 and len({r["slot"] for r in rows}) == len(rows)
        assert len({r["cluster"] for r in rows}) == len(rows)
        sources = [r["source"] for r in rows if r["source"]]
        assert len(set(sources)) == len(sources)
    assert packing.pack(docs.limit(0)).collect() == []


def test_bins_take_the_tightest_that_fits():
    rng = random.Random(2)
    bins, plain = packing.Bins(50, 70, 70), []
    for _ in range(400):
        n, s, c = rng.randrange(0, 49), rng.randrange(-1, 70), rng.randrange(-1, 70)
        found = bins.place(n, s, c)
        fits = [left for left, ss, cs in plain if 0 < left >= n and s not in ss and c not in cs]
        if fits:
            assert plain[found][0] == min(fits)
        else:
            assert found == len(plain)
            plain.append([50, set(), set()])
        plain[found][0] -= n
        plain[found][1] |= {s} - {-1}
        plain[found][2] |= {c} - {-1}


def test_weights_meet_their_limits(spark):
    tokens = {"a": 9000, "b": 600, "c": 300, None: 100}
    df = spark.createDataFrame([(k, v) for k, v in tokens.items()] + [("none", 0)], "source string, tokens long")

    def weights(**kw):
        rows = mixing.source_weights(df, mixing.Settings(**kw)).collect()
        assert math.isclose(sum(r["weight"] for r in rows), 1) and len(rows) == 4
        return {r["source"]: r["weight"] for r in rows}, rows[0]["exponent"]

    w, e = weights(repeats=3.0)
    assert math.isclose(max(x * 10_000 / tokens[s] for s, x in w.items()), 3.0, rel_tol=1e-6) and 0 < e < 1
    w, e = weights(repeats=None, entropy=0.8)
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 0.8 * math.log(4), rel_tol=1e-6)
    assert weights(repeats=None)[1] == 1.0 and weights(repeats=100.0)[1] == 0.0 and weights(repeats=0.5)[1] == 1.0


def test_mixture_is_near_its_targets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice("aaaaaaabc"), 3) for i in range(1500)] + [(5000, None, "a", 3), (5001, " ", "d", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    settings = mixing.Settings(blocks=64)
    mixed = mixing.mix_sources(df, settings)
    assert mixed.columns == ["doc_id", "text", "source", "n_tokens", "weight", "epoch", "block", "position"]
    got = mixed.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7), settings).collect()))
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["n_tokens"] for r in own) - own[0]["weight"] * total) < 0.06 * total
        assert max(r["epoch"] for r in own) <= 3
    assert mixing.mix_sources(df.limit(0)).collect() == []


def digests(text):
    return {p.strip(" ") for p in (text or "").split("\n") if p.strip(" ")}


def test_likeness_is_that_of_the_paragraph_sets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        x = {f"p{rng.randrange(10**9)}" for _ in range(rng.choice((0, 1, 3, 10, 60, 400)))}
        y = {p for p in x if rng.random() < rng.choice((0.0, 0.5, 0.95, 1.0))} | {f"q{j}" for j in range(rng.choice((0, 1, 5)))}
        rows.append((i, sorted(x), sorted(y)))
    df = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    hashed = table(df.select("i", *(F.transform(c, lambda p: F.xxhash64(p)).alias(n) for c, n in (("a", "x"), ("b", "y")))))
    got = {r["i"]: r["likeness"] for r in fingerprints.sketch_likeness(hashed, ["i"]).collect()}
    for i, x, y in rows:
        assert math.isclose(got[i], len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0)


def test_short_lines_of_sentences_are_likened_by_sentence(spark):
    text = "".join(f"This is sentence {i:02}. " for i in range(8)).strip()
    other = "".join(f"Another one is {i:04}. " for i in range(8)).strip()
    got = {r["doc_id"]: r["near_edited"] for r in fingerprints.fingerprint_versions(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()}
    assert len(text) < 400 and got[1] >= 0.5 and got[2] >= 0.5


def plain_units(text):
    import re

    return {p.strip(" ") for line in re.split(r"\n+", text) for p in re.split(r"(?<=[.!?])[ ]+", line) if p.strip(" ")}


def test_near_versions_against_plain_sets(spark):
    """near_edited and near_next of documents of one to 300 sentences, from the sets of sentences themselves."""
    rng = random.Random(17)
    pool = [f"Sentence number {i} says {rng.randrange(10**6)}{rng.choice('.!?')}" for i in range(400)]
    rows = []
    for i in range(60):
        own = rng.sample(pool, rng.choice((1, 3, 12, 60, 300)))
        rows.append((i * 3, "".join(x + rng.choice((" ", "\n", "  ", "\n\n")) for x in own)))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for n, (i, text) in enumerate(rows):
        after, k = rows[(n + 1) % len(rows)][1], len(text) // 4
        for other, name in ((text[: len(text) - k] + after[:k], "near_edited"), (after, "near_next")):
            x, y = plain_units(text), plain_units(other)
            assert math.isclose(got[i][name], len(x & y) / len(x | y)), (i, name)


def test_sketches_that_do_not_peel_are_dealt_out_again(spark, monkeypatch):
    """With one round of peeling most parts stay mixed; they go on until none is."""
    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    rounds = []
    dealt = fingerprints._dealt
    monkeypatch.setattr(fingerprints, "_dealt", lambda hard, key, n: rounds.append(n) or dealt(hard, key, n))
    rng = random.Random(5)
    rows = [(i, rng.sample(range(10**12), n), rng.sample(range(10**12), m)) for i, (n, m) in enumerate(((300, 300), (1000, 0), (0, 40), (0, 0)))]
    rows.append((9, rows[0][1], rows[0][1][:150] + rows[0][2][:150]))
    df = table(spark.createDataFrame(rows, "i long, x array<bigint>, y array<bigint>"))
    got = {r["i"]: r["likeness"] for r in fingerprints.sketch_likeness(df, ["i"]).collect()}
    assert all(math.isclose(got[i], len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0) for i, x, y in rows)
    assert len(rounds) > 1


def test_fingerprints_of_versions(docs, empty):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in docs.distinct().collect()))
    got = fingerprints.fingerprint_versions(docs).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    for n, (i, text) in enumerate(rows):
        if i == 45 or sum(x == i for x, _ in rows) > 1 or sum(x == rows[(n + 1) % len(rows)][0] for x, _ in rows) > 1:
            continue
        after, k = rows[(n + 1) % len(rows)][1], len(text) // 4
        r = by[(None if i < 0 else i, len(text))]
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        assert texts.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.fingerprint_versions(empty).collect() == []
