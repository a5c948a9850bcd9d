"""Near-duplicate vectors, integer clustering and Merkle manifests against brute force."""

import hashlib
import math
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinispan.llm import delta_lloyd, embedding_join, merkle, queries


def plain_links(rows, least=0.9):
    """(n_links, component_id) by place in rows, every pair tried."""

    def good(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    at = [k for k, (i, v) in enumerate(rows) if good(i, v)]
    near = {k: set() for k in range(len(rows))}
    for k in at:
        for m in at:
            if k < m and len(rows[k][1]) == len(rows[m][1]):
                x, y = np.array(rows[k][1]), np.array(rows[m][1])
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= least:
                    near[k].add(m)
                    near[m].add(k)
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[k] = (len(near[k]), min((rows[m][0] for m in seen if rows[m][0] is not None), default=None))
    return [(rows[k][0], *out[k], rows[k][0] == out[k][1]) for k in range(len(rows))]


def awkward_vectors(n=160, length=20, seed=3):
    rng = np.random.default_rng(seed)
    x = list(rng.normal(size=(n, length)))
    hub = rng.normal(size=length)
    x += [hub + rng.normal(size=length) * s for s in np.linspace(0.02, 0.5, 60)]  # a dense group whose members are not all alike
    x += [x[0], x[0], x[0] * 3, -x[0], x[1] * 1e-30, x[1] * 1e30]
    for cosine in (0.899, 0.8999999, 0.9000001, 0.901):
        u = x[2] / np.linalg.norm(x[2])
        w = rng.normal(size=length)
        w -= (w @ u) * u
        x.append(cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [0.0] * length), (503, [math.nan] + [1.0] * (length - 1)), (504, [math.inf] + [1.0] * (length - 1)), (505, [None] + [1.0] * (length - 1)), (None, rows[0][1]), (0, rows[0][1]), (7, rows[60][1]), (506, [1.0]), (507, [2.0]), (508, [-1.0]), (509, [1.0, 1.0])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, component long, links long, node string"


@pytest.mark.parametrize("settings", [embedding_join.Settings(), embedding_join.Settings(width=5, leaf=16, part=24), embedding_join.Settings(width=3, leaf=40, part=1000, depth=2)])
def test_near_duplicate_vectors(spark, settings):
    rows = awkward_vectors()
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA)
    got = [tuple(r) for r in embedding_join.near_duplicate_vectors(df, settings).collect()]
    assert sorted(got, key=repr) == sorted(plain_links(rows), key=repr)
    assert embedding_join.near_duplicate_vectors(df.limit(0), settings).collect() == []


def test_near_duplicates_of_floats(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 64)) * 0.3]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding_join.near_duplicate_vectors(df, embedding_join.Settings(leaf=50, part=30)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_links(rows))
    assert sum(not r["kept"] for r in got) > 30


def test_clustered_vectors_are_joined_cell_by_cell(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 24))
    x = [c + rng.normal(size=24) * rng.choice([0.02, 0.1]) for c in centres for _ in range(40)]
    rows = [(i, [float(v) for v in w]) for i, w in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    settings = embedding_join.Settings(similarity=0.985, width=6, leaf=20, part=32)

    def leaves(cell):
        return 1 if cell.axis < 0 else leaves(cell.below) + leaves(cell.above)

    model = embedding_join.fit(df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), F.lit(24).alias("length")), settings)
    assert min(leaves(c) for c in model.cells[24]) > 2
    assert sorted(tuple(r) for r in embedding_join.near_duplicate_vectors(df, settings).collect()) == sorted(plain_links(rows, 0.985))


def plain_lloyd(rows, s):
    kept = [(i, [math.floor(x * s.scale) for x in v]) for i, v in rows if v is not None and len(v) == s.length and all(x is not None and math.isfinite(x) and abs(x) <= delta_lloyd.GREATEST for x in v)]
    first = sorted((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[: s.k]
    centroids = [q for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(s.rounds):
        owner = [n for _, n in assign()]
        for n in set(owner):
            own = [q for (_, q), m in zip(kept, owner, strict=True) if m == n]
            centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign() if centroids else []
    inertia = {n: sum(d for d, m in last if m == n) for _, n in last}
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)]


def test_clusters_as_lloyd_finds_them(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.6) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0] * 5), (1002, [math.nan] * 6), (1003, [None] + [0.0] * 5), (1004, [math.inf] * 6), (1005, [1e30] * 6), (None, [0.5] * 6), (3, rows[3][1]), (3, rows[9][1]), (1006, [float(delta_lloyd.GREATEST)] * 6), (1007, [-0.001] * 6)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, q string").repartition(5)
    for s in (delta_lloyd.Settings(k=9, rounds=6, length=6), delta_lloyd.Settings(k=5, rounds=40, length=6), delta_lloyd.Settings(k=1000, rounds=2, length=6), delta_lloyd.Settings(k=3, rounds=0, length=6)):
        assert sorted(map(repr, (tuple(r) for r in delta_lloyd.cluster(df, s).collect()))) == sorted(map(repr, plain_lloyd(rows, s)))
    assert delta_lloyd.cluster(df.limit(0)).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(v)]) for i, v in enumerate([0, 2, 1, 1, 1, 4, 3, 3, 0, 2])]
    s = delta_lloyd.Settings(k=4, rounds=3, length=1, scale=1)
    got = delta_lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), s).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_lloyd(rows, s))


def test_only_changed_centroids_are_compared(spark, sf, monkeypatch):
    """What a round compares: distances per vector, from the transfers of the real table."""
    compared = []
    real = delta_lloyd._distances
    monkeypatch.setattr(delta_lloyd, "_distances", lambda q, c: compared.append(len(q) * len(c)) or real(q, c))
    rng = np.random.default_rng(1)
    q = np.concatenate([rng.integers(0, 50, (500, 4)), rng.integers(1000, 1050, (500, 4))])
    centroids = q[[0, 1, 500, 501]]

    class Held:
        value = (centroids, np.array([False, False, False, True]))

    import pyarrow as pa

    d = real(q, centroids)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(list(q), pa.list_(pa.int32())), pa.nulls(1000, pa.int32()), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], names=["vec_id", "q", "was", "cluster", "distance"])
    (out,) = delta_lloyd._assign(Held)(iter([batch]))
    assert out.column("cluster").to_pylist() == d.argmin(1).tolist()
    assert sum(compared) == 1000


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(docs, arity):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of docs (doc_id, source, lang, n_chars, text)."""

    def leaf(d, more=0):
        return sha("".join(field(v) for v in (d[0], d[1], d[2], None if d[3] is None else d[3] + more, d[4])))

    def tree(level):
        """The root, and of each leaf its siblings (before, after) level by level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                run = i // arity * arity
                paths[k].append((level[run:i], level[i + 1 : run + arity]))
            level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
            at = [i // arity for i in at]
        return level[0], paths

    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0], leaf(d), d))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])) for g in langs}
    roots = {g: tree([x[2] for x in own[g]]) for g in langs}
    root, upper = tree([roots[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, upper, strict=True):
        for (_, _, recorded, d), path in zip(own[g], roots[g][1], strict=True):
            touched = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            found = leaf(d, 1) if touched else recorded
            for before, after in path + up:
                found = sha("".join([*before, found, *after]))
            out.append((d[0], recorded, roots[g][0], root, sha("".join(x for b, a in path + up for x in [*b, *a])), found, found == root))
    return out


def manifest_of(df, settings=merkle.Settings()):
    leaves = [merkle.leaf(*(F.col(c) if c != "n" else n for c in ("doc_id", "source", "lang", "n", "text"))) for n in (F.col("n_chars"), F.col("n_chars") + 1)]
    return merkle.manifest(df, leaves[0], F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaves[1]).otherwise(leaves[0]), settings=settings)


@pytest.mark.parametrize("settings", [merkle.Settings(), merkle.Settings(rows=7, fan=2), merkle.Settings(arity=3, rows=11, fan=3), merkle.Settings(arity=5, rows=1, fan=4)])
def test_manifest(spark, settings):
    rng = random.Random(8)
    langs = ["en", "fr", None, "é", "z", ""]
    docs = [(i, rng.choice(["a", None]), "en" if i % 3 == 0 else rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "text\n中", "x" * 100_000])) for i in range(90)]
    docs += [docs[0]] * 4 + [(docs[0][0], "other", docs[0][2], 1, "t"), (None, None, None, None, None), (None, "s", "en", 5, "t"), (900, "s", "alone", 5, "t")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int")
    got = [tuple(r) for r in manifest_of(df, settings).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(docs, settings.arity), key=repr)
    assert manifest_of(df.limit(0), settings).collect() == []
    one = manifest_of(df.where("doc_id = 900"), settings).collect()
    assert [tuple(r) for r in one] == plain_manifest([docs[-1]], settings.arity)


def test_fragments_add_up_in_any_order():
    """The monoid's law: however fragments are grouped, the root is the same."""
    rng = random.Random(2)
    leaves = {(t, 0, i): sha(f"{t}/{i}") for t, n in enumerate((13, 1, 30)) for i in range(n)}

    def forest(nodes):
        f = merkle.Forest(2, 3)
        f.leaves |= {0: 13, 1: 1, 2: 30}
        f.open = dict(nodes)
        f.settle()
        return f.open

    whole = forest(leaves)
    assert len(whole) == 1
    for _ in range(20):
        keys = list(leaves)
        rng.shuffle(keys)
        parts = [forest({k: leaves[k] for k in keys[i::5]}) for i in range(5)]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop()
            parts.append(forest(a | b))
        assert parts[0] == whole


def test_queries_over_whole_tables(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in e]
    assert sorted(tuple(r) for r in queries.op11_embedding_near_dedup(spark, sf).collect()) == sorted(plain_links(rows))
    assert sorted(tuple(r) for r in queries.op12_delta_lloyd(spark, sf).collect()) == sorted(plain_lloyd(rows, replace(delta_lloyd.Settings(), k=40)))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_merkle_manifest(spark, sf).collect()) == sorted(plain_manifest(docs, 2))
