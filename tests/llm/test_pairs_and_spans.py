"""The n-gram join, substring removal and line dedup against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from clinispan.llm import line_dedup, ngram_join, substring_dedup
from clinispan.llm.components import connected_components

#: Limits so low that small fixtures reach the head's parts, long prefixes, crowded tokens and several blocks.
LOW = ngram_join.Settings(head=200, shortest=2, longest=4, cost=1, heavy=4, flush=500, crowd=3, block=16, block_tokens=1500)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_ngram_join_finds_every_component(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    edges = [(a, b) for a, x in known for b, y in known if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = components({i for i, _ in known}, edges)
    sets = [x for _, x in known]
    n_links = {(i, len(x)): sum(1 for y in sets if x and y and 100 * len(x & y) >= 75 * len(x | y)) - bool(x) for i, x in known}
    for settings in (ngram_join.Settings(), LOW):
        got = ngram_join.near_duplicate_classes(docs, settings=settings).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i is None, i or 0, len(shingles(t))) for i, t in rows)
        assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)
        assert all(r["n_links"] == (n_links[(r["doc_id"], r["n_shingles"])] if r["doc_id"] is not None else 0) for r in got)
    assert len(set(want.values())) < len(want) - 8


def variants(rng, base, n, changes):
    """n texts of base's words, of which so many are replaced, as often by one of three words as by one of their own."""
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.sample(range(len(base)), rng.choice(changes)):
            w[j] = f"alt{rng.randrange(3)}" if rng.random() < 0.5 else f"own{i}x{j}"
        out.append(" ".join(w))
    return out


def test_ngram_join_of_crowded_groups(spark):
    """Groups of near copies that do not all link, and a passage that short texts share, with the limits so low that each way is taken."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(24)]
    texts = variants(rng, base, 150, (1, 2, 4, 6, 8, 10)) + variants(rng, base[:70], 60, (1, 3, 5))
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 16))]) for _ in range(80)] + [" ".join(passage)] * 7
    texts += [" ".join(f"z{rng.randrange(300)}" for _ in range(40)) for _ in range(60)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len(x & y) >= 75 * len(x | y)]
    want = components(range(len(texts)), links)
    degree = [0] * len(texts)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(set(want.values())) < len(texts) - 50 and len(links) > 1000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for settings in (ngram_join.Settings(), LOW):
        got = {r["doc_id"]: r for r in ngram_join.near_duplicate_classes(df, settings=settings).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert [got[i]["n_links"] for i in range(len(texts))] == degree
    assert {r["doc_id"] for r in ngram_join.keep_one(df, settings=LOW).collect()} == set(want.values())


def test_linking_equals_set_arithmetic():
    rng = random.Random(12)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 60))], dtype=np.int64)) for _ in range(40)]
    got = ngram_join.linking(sets[:25], sets[15:], ngram_join.Rule())
    for i, x in enumerate(sets[:25]):
        for j, y in enumerate(sets[15:]):
            x1, y1 = set(x.tolist()), set(y.tolist())
            assert got[i, j] == (bool(x1 & y1) and 100 * len(x1 & y1) >= 75 * len(x1 | y1))


def test_keep_one_keeps_columns_and_unlinked_rows(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 10 not in ids and 11 not in ids and ids.count(43) == 2 and 40 in ids and None in ids and 44 not in ids


def test_ngram_join_columns(empty):
    assert ngram_join.near_duplicate_classes(empty).columns == ["doc_id", "n_shingles", "component_id", "n_links"]


def test_ngram_join_of_nothing(empty):
    assert ngram_join.near_duplicate_classes(empty).collect() == [] and ngram_join.keep_one(empty).collect() == []


def test_substring_removal_equals_brute_force(docs):
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    low = {}
    for i, w in rows:
        for s in range(len(w) - 19):
            if i is not None:
                low[tuple(w[s : s + 20])] = min(i, low.get(tuple(w[s : s + 20]), i))
    want = []
    for i, w in rows:
        gone = {j for s in range(len(w) - 19) if i is not None and low[tuple(w[s : s + 20])] < i for j in range(s, s + 20)}
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(str(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in substring_dedup.remove_repeats(docs, k=20).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 500


def test_substring_removal_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_lines_keep_the_first_of_each_kind(spark):
    line = "the quick brown fox jumps over the lazy dog while seven wizards brew tea in copper kettles"
    near = line.replace("copper", "silver")
    far = "an entirely different sentence about rivers, bridges and the weather of the northern coast"
    rows = [(1, f"{line}\n\n  {far}"), (2, f"{near}\nshort\n{far}  "), (3, "short\nonly here, really nowhere else at all"), (4, None), (5, ""), (6, line), (None, line), (6, line)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, pos string, line int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())
    want = [("1", f"{line}\n\n  {far}", 2, 0), ("2", "short", 3, 2), ("3", "only here, really nowhere else at all", 2, 1), ("4", None, 0, 0), ("5", "", 0, 0), ("6", "", 1, 1), ("6", "", 1, 1), ("None", line, 1, 0)]
    assert got == sorted(want, key=lambda r: (r[0], str(r[1])))


def chars(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def linked(lines):
    """The component of each line by brute force."""
    known = [(i, chars(t)) for i, t in enumerate(lines)]
    edges = [(a, b) for a, x in known for b, y in known[a + 1 :] if len(x & y) and len(x & y) >= 0.75 * len(x | y)]
    return components(range(len(lines)), edges)


def star(rng, n):
    """A line of 40 words and n - 1 copies with 3 words replaced, all of 0.75 or more to it."""
    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))

    base = [word() for _ in range(40)]
    out = [" ".join(base)]
    while len(out) < n:
        w = list(base)
        for j in rng.sample(range(40), 3):
            w[j] = word()
        x, y = chars(out[0]), chars(" ".join(w))
        if len(x & y) >= 0.75 * len(x | y):
            out.append(" ".join(w))
    return out


def test_lines_that_resemble_only_their_original(spark):
    rng = random.Random(6)
    groups = [star(rng, n) for n in (2, 10, 10, 10, 100, 300)]
    lines = [(i, t) for i, t in enumerate(t for g in groups for t in g)]
    rng.shuffle(lines)
    out = line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string"))
    assert sum(r["n_removed"] for r in out.collect()) == len(lines) - len(groups)


def test_short_and_unspaced_lines(spark):
    rng = random.Random(7)
    lines = ["abcdefgh", "abcdefghi", "abcd", "abce", "abcde", "abcdef"]
    for n in [*range(9, 60), 200]:
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        lines += [word, "#" + word, word[: n // 2] + "é" + word[n // 2 :]]
    want = linked(lines)
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect() if r["n_removed"] == 0} == set(want.values())


LOW_LINES = line_dedup.Settings(crowd=4, block=16)


def test_crowded_lines_against_brute_force(spark):
    """Lines of one family at all distances from each other, with and without a common passage, by every way of comparing."""
    rng = random.Random(9)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))

    lines = set()
    for size, most in ((40, 7), (25, 4), (14, 3), (8, 2)):
        base = [word() for _ in range(size)]
        for _ in range(60):
            w = list(base)
            for j in rng.sample(range(size), rng.randrange(most + 1)):
                w[j] = word()
            lines.add(" ".join(w))
    common = [word() for _ in range(12)]
    lines |= {" ".join(common + [word() for _ in range(8)]) for _ in range(100)}
    lines = sorted(lines)
    rng.shuffle(lines)
    want = linked(lines)
    assert 100 < len(set(want.values())) < len(lines) - 50
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    for settings in (line_dedup.Settings(), LOW_LINES):
        left = {r["doc_id"] for r in line_dedup.dedup_lines(df, settings).collect() if r["n_removed"] == 0}
        assert left >= set(want.values()) and len(left - set(want.values())) <= 1


def test_shingles_of_crowded_lines_are_moved_only_for_alike_ones(spark, monkeypatch):
    """Of lines with one passage in common, which meet in crowded bands, those alike to another alone go on; tables go once they have been read."""
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]

    common = words(8)
    lines = [" ".join(common + words(16)) for _ in range(120)]
    near = [" ".join([*x.split()[:-1], "other"]) for x in lines[:10]]
    placed, kept = [], line_dedup._Join.keep
    at_once = []

    def keep(self, df):
        out = kept(self, df)
        at_once.append(len(self.made))
        if out.columns[:4] == ["l1", "low", "high", "side"]:
            placed.append(out.count())
        return out

    monkeypatch.setattr(line_dedup._Join, "keep", keep)
    rows = spark.createDataFrame([(x,) for x in lines + near], "line string").selectExpr("xxhash64(line) as l1", "line")
    found = line_dedup.similar_lines(rows, LOW_LINES)
    assert found.count() == 2 * len(near)
    met, left, right = placed
    assert met > 100 and left + right < met / 2
    assert max(at_once) < 20


def respaced_pairs(rng, n):
    """Pairs of Jaccard 0.75 or more whose numbers of words differ: short words put in, in one place or spread, and spaces put in or taken out, in lines of words of 1 to 40 letters."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", []
    while len(out) < n:
        size = rng.choice((1, 2, 3, 5, 8, 12, 20, 40))
        words = ["".join(rng.choice(letters) for _ in range(max(1, size + rng.randrange(-1, 2)))) for _ in range(rng.randrange(1, 1 + 600 // (size + 1)))]
        line, way = " ".join(words), rng.randrange(4)
        more = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 2 + len(line) // 12))]
        at = rng.randrange(len(words) + 1)
        if way == 0:
            other = " ".join([*words[:at], *more, *words[at:]])
        elif way == 1:
            other = list(words)
            for w in more:
                other.insert(rng.randrange(len(other) + 1), w)
            other = " ".join(other)
        else:
            other = list(line)
            for _ in range(rng.randrange(1, 2 + len(line) // 30)):
                k = rng.randrange(len(other))
                other[k] = "" if other[k] == " " else other[k] + " "
            other = " ".join("".join(other).split())
        x, y = chars(line), chars(other)
        if line != other and x and y and len(x & y) >= 0.75 * len(x | y):
            out.append((line, other))
    return out


def test_lines_whose_numbers_of_words_differ(spark):
    """Twelve long words, and the same with six of one letter put in; then pairs of all sorts, of which at most one in a hundred is lost."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20))
    base = [[word() for _ in range(12)] for _ in range(40)]
    pairs = [(" ".join(w), " ".join([*w[:6], *rng.sample("abcdefghijk", 6), *w[6:]])) for w in base]
    for made, least in ((pairs, 1.0), (respaced_pairs(rng, 1500), 0.99)):
        lines = [t for p in made for t in p]
        hashes = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string").selectExpr("i", "line", "xxhash64(line) as l1")
        of = {r["l1"]: r["component"] for r in line_dedup.similar_lines(hashes.select("l1", "line").dropDuplicates(["l1"])).collect()}
        at = {r["i"]: of.get(r["l1"], r["l1"]) for r in hashes.select("i", "l1").collect()}
        joined = sum(at[2 * k] == at[2 * k + 1] for k in range(len(made)))
        assert joined >= least * len(made), (joined, [made[k] for k in range(len(made)) if at[2 * k] != at[2 * k + 1]][:3])


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 60)] + [(3, 3), (None, 4), (140, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_bands_are_counted_in_slices(spark, monkeypatch):
    """What is shuffled to find the bands that several lines have is a slice of all bands at a time, and each band is in one slice."""
    rng = random.Random(12)
    lines = [_words(rng, 30) for _ in range(40)]
    lines += [line[:-3] + "end" for line in lines[:20]]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "l1 long, line string")
    seen, tables = [], line_dedup.tables

    def sliced(parts):
        parts = list(parts)
        seen.append([{r["band"] for r in part.select("band").distinct().collect()} for part in parts])
        return tables(parts)

    monkeypatch.setattr(line_dedup, "tables", sliced)
    found = {r["l1"]: r["component"] for r in line_dedup.similar_lines(rows, line_dedup.Settings(slice=64)).collect()}
    assert found == {i: i % 40 for i in (*range(20), *range(40, 60))}
    (slices,) = seen
    assert len(slices) == line_dedup.Settings().slices and all(slices) and len(set().union(*slices)) == sum(map(len, slices))
    assert line_dedup.similar_lines(rows.limit(0)).collect() == []


def test_long_lines_are_told_by_their_beginning(spark):
    """Whether a line has more shingles than one of middle length is mostly seen from its beginning; what begins with few is looked at whole."""
    rng, most = random.Random(13), 85
    texts = ["ab" * 300, "ab" * 100 + _words(rng, 60), _words(rng, 60), _words(rng, 16), _words(rng, 3), "x" * 170, "x" * 171, "élève " * 40 + _words(rng, 8), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    got = df.select("i", line_dedup._enough_shingles(F.col("line"), line_dedup.Settings()).alias("some"), F.array_distinct(line_dedup._shingles(F.col("line"), 5)).alias("every")).collect()
    for r in got:
        some, every = set(r["some"]), set(r["every"])
        assert some <= every and (some == every or len(some) > most) and len(some) <= max(170, len(every))
    assert any(len(r["some"]) < len(r["every"]) for r in got)
