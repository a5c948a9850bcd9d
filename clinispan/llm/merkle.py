"""A Merkle manifest of a dataset: subtrees by group, a root over the groups, and a proof for each row.

The forest of partly hashed trees is a monoid: a fragment is a set of nodes keyed by tree, level and index, and two fragments add up to their union, in
which every run of siblings that is complete becomes its parent. How many leaves each tree has is known, so the last run of a level is known
to be complete with fewer. Partitions are ranges of the sorted leaves, so a fragment has a few nodes for each level. Fragments are
added up in rounds, as a tree reduction over tables, since each round's fragments are read again on the way down, where every node
gets the path to the root that its parent has. No task holds more than one partition's leaves or a round's share of fragments.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispan.llm.scratch import drop, small, table

_NODE = "part long, tree long, leaves long, level int, at long, digest string"
_NODE_ARROW = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])
_PATH = "part long, tree long, level int, at long, path array<struct<before:string,after:string>>"
_PATH_ARROW = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])
#: The tree over the roots of the groups.
_TOP = -1
#: Bits of a row's place that number it within its partition.
_ROW_BITS = 33


@dataclass(frozen=True)
class Settings:
    """arity: siblings of a run; rows: leaves of a partition, about; fan: fragments that a task of a round adds up."""

    arity: int = 2
    rows: int = 1 << 16
    fan: int = 16


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it goes into a leaf: '-' for null, else its length in UTF-8 bytes, ':' and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


Key = tuple[int, int, int]


class Forest:
    """A fragment: nodes by (tree, level, index), leaves by tree, and how each parent came about."""

    def __init__(self, arity: int, trees: int):
        self.arity, self.trees = arity, trees
        self.open: dict[Key, str] = {}
        self.leaves: dict[int, int] = {_TOP: trees}
        #: Of each parent that was made: its children, in order. A tree's root has the node that it is in the top tree.
        self.children: dict[Key, list[tuple[Key, str]]] = {}

    def width(self, tree: int, level: int) -> int:
        n = self.leaves[tree]
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def height(self, tree: int) -> int:
        level = 0
        while self.width(tree, level) > 1:
            level += 1
        return level

    def settle(self) -> None:
        """Make every parent whose children are all there, level by level, groups' trees first."""
        for top in (False, True):
            level = 0
            todo = defaultdict(list)
            for key in self.open:
                if (key[0] == _TOP) == top:
                    todo[key[1]].append(key)
            while todo:
                if keys := todo.pop(level, None):
                    todo[level + 1] += self._raise(sorted(keys))
                    if not todo[level + 1]:
                        del todo[level + 1]
                level += 1

    def _raise(self, keys: list[Key]) -> list[Key]:
        """The parents of complete runs among keys, which are of one level and in order."""
        made, i, widths = [], 0, {}
        while i < len(keys):
            tree, level, at = keys[i]
            if tree not in widths:
                widths[tree] = self.width(tree, level)
            width = widths[tree]
            if width == 1:
                if tree != _TOP:
                    up = (_TOP, 0, tree)
                    self.open[up] = self.open.pop(keys[i])
                    self.children[up] = [(keys[i], self.open[up])]
                i += 1
                continue
            run = at // self.arity
            size = min(self.arity, width - run * self.arity)
            j = i
            while j < len(keys) and keys[j][0] == tree and keys[j][2] // self.arity == run:
                j += 1
            if j - i == size:
                up = (tree, level + 1, run)
                self.children[up] = [(k, self.open.pop(k)) for k in keys[i:j]]
                self.open[up] = sha256("".join(d for _, d in self.children[up]))
                made.append(up)
            i = j
        return made

    def paths(self, given: dict[Key, tuple]) -> dict[Key, tuple]:
        """The path of every node, from those of the open ones: (before, after, path of the parent), () for the root."""
        out, todo = dict(given), list(given)
        while todo:
            up = todo.pop()
            below = self.children.get(up, [])
            for i, (key, _) in enumerate(below):
                same = key[0] != up[0]
                out[key] = out[up] if same else ("".join(d for _, d in below[:i]), "".join(d for _, d in below[i + 1 :]), out[up])
                todo.append(key)
        return out


def _steps(path: tuple) -> list[tuple[str, str]]:
    out = []
    while path:
        out.append(path[:2])
        path = path[2]
    return out


def _linked(steps: list[dict]) -> tuple:
    path: tuple = ()
    for s in reversed(steps):
        path = (s["before"], s["after"], path)
    return path


def _forest_of_nodes(nodes: pa.Table, arity: int, trees: int) -> Forest:
    forest = Forest(arity, trees)
    for tree, leaves, level, at, digest in zip(*(nodes.column(n).to_pylist() for n in ("tree", "leaves", "level", "at", "digest")), strict=True):
        forest.leaves[tree] = leaves
        forest.open[(tree, level, at)] = digest
    forest.settle()
    return forest


def _fragment(forest: Forest, part: int) -> pa.Table:
    rows = [(part, t, forest.leaves[t], level, at, digest) for (t, level, at), digest in forest.open.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW) if rows else _NODE_ARROW.empty_table()


def _forest_of_leaves(rows: pa.Table, spans: pa.Table, arity: int) -> tuple[Forest, pa.Table, list[Key]]:
    """The forest of a partition's leaves; its rows in order, and the key of each."""
    rows = rows.take(pc.sort_indices(rows.column("place")))
    at = {r["group"]: r for r in spans.to_pylist()}
    forest = Forest(arity, next(iter(at.values()))["trees"])
    keys, seen = [], {g: r["start"] for g, r in at.items()}
    for group in rows.column("group").to_pylist():
        keys.append((at[group]["tree"], 0, seen[group]))
        seen[group] += 1
    forest.leaves |= {r["tree"]: r["leaves"] for r in at.values()}
    forest.open = dict(zip(keys, rows.column("leaf").to_pylist(), strict=True))
    forest.settle()
    return forest, rows, keys


def _up_from_leaves(arity: int):
    def run(key: tuple, rows: pa.Table, spans: pa.Table) -> pa.Table:
        return _fragment(_forest_of_leaves(rows, spans, arity)[0], key[0].as_py())

    return run


def _up(arity: int, trees: int):
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        return _fragment(_forest_of_nodes(nodes, arity, trees), key[0].as_py())

    return run


def _given(paths: pa.Table) -> dict[Key, tuple]:
    return {(r["tree"], r["level"], r["at"]): _linked(r["path"]) for r in paths.to_pylist()}


def _down(arity: int, trees: int):
    """Paths of the fragments' nodes, from those of the nodes that they add up to."""

    def run(nodes: pa.Table, paths: pa.Table) -> pa.Table:
        if not len(nodes):
            return _PATH_ARROW.empty_table()
        every = _forest_of_nodes(nodes, arity, trees).paths(_given(paths))
        keys = list(zip(*(nodes.column(n).to_pylist() for n in ("tree", "level", "at")), strict=True))
        told = pa.array([[dict(zip(("before", "after"), s, strict=True)) for s in _steps(every[k])] for k in keys], _PATH_ARROW.field("path").type)
        return pa.Table.from_arrays([nodes.column("part"), nodes.column("tree"), nodes.column("level"), nodes.column("at"), told], schema=_PATH_ARROW)

    return run


def _fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        digest = sha256(before + digest + after)
    return digest


def _down_to_leaves(arity: int, root: str):
    """The rows of a partition with subroot, root, proof_sha256, folded_root and verified."""

    def run(rows: pa.Table, both: pa.Table) -> pa.Table:
        spans, paths = both.filter(pc.is_valid(both.column("start"))), both.filter(pc.is_null(both.column("start")))
        forest, rows, keys = _forest_of_leaves(rows, spans, arity)
        every = forest.paths(_given(paths))
        subroots, proofs, folded, of_row = {}, [], [], []
        for key, own, found in zip(keys, rows.column("leaf").to_pylist(), rows.column("altered").to_pylist(), strict=True):
            steps = _steps(every[key])
            if key[0] not in subroots:
                subroots[key[0]] = _fold(own, steps[: forest.height(key[0])])
            of_row.append(subroots[key[0]])
            proofs.append(sha256("".join(before + after for before, after in steps)))
            folded.append(_fold(found, steps))
        made = {"subroot": of_row, "root": [root] * len(keys), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
        return pa.table({"key": rows.column("key"), "leaf": rows.column("leaf"), **made})

    return run


def _sorted_leaves(docs: DataFrame, key: str, group: str, original: Column, altered: Column, settings: Settings) -> DataFrame:
    """A row per row of docs: key, group, leaf, altered, part (a range of group, key, leaf) and place (order of the rows)."""
    # Rows with one key and leaf are told apart by where they were read, so that no range grows with them.
    leaves = table(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), original.alias("leaf"), altered.alias("altered")).withColumn("salt", F.monotonically_increasing_id()))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // settings.rows))
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.col("leaf"), F.col("salt")]
    placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    out = table(placed.select("key", "group", "leaf", "altered", "place", F.shiftright("place", _ROW_BITS).alias("part")))
    drop(leaves)
    return out


def _spans(leaves: DataFrame) -> DataFrame:
    """A row per part and group: tree (the group's number), start (how many of its leaves come before), leaves (of the group), trees (of all)."""
    counts = table(leaves.groupBy("part", "group").agg(F.count("*").alias("n")))
    before = F.coalesce(F.expr("sum(n) over (partition by group order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    placed = table(counts.select("part", "group", before.alias("start"), F.expr("sum(n) over (partition by group)").alias("leaves")))
    drop(counts)
    # Groups are numbered by the parts that they begin in: a number for each part is what one task adds up.
    begun = placed.groupBy("part").agg(F.count_if(F.col("start") == 0).alias("begun"))
    offset = begun.select("part", F.expr("sum(begun) over (order by part) - begun").alias("offset"), F.expr("sum(begun) over ()").alias("trees"))
    rank = F.expr("row_number() over (partition by part order by group nulls first)")
    # The first group of a part may have begun before it; then the numbers of the part are one less.
    late = F.expr("max(case when start > 0 then 1 else 0 end) over (partition by part)")
    numbered = placed.withColumns({"rank": rank, "late": late}).join(small(offset), "part")
    out = table(numbered.select("part", "group", "start", "leaves", (F.col("offset") + F.col("rank") - F.col("late") - 1).alias("tree"), "trees"))
    drop(placed)
    return out


def manifest(docs: DataFrame, original: Column, altered: Column, key: str = "doc_id", group: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """A row per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    original and altered are columns of docs: the leaf as recorded, and the leaf as it is found, from which folded_root is worked out with
    the recorded siblings. Leaves of one group ascend by key (null first; equal keys by leaf; equal leaves as they come) and make a tree: while a level has several nodes, every arity
    consecutive ones, the last ones fewer or even one, become the SHA-256 of their hexadecimal digests. The groups' roots, in the order of the groups (null
    first, bytewise), make one likewise. proof_sha256 hashes the siblings on the way to the root. Repeated rows are leaves each. No rows give none.
    """
    spark, arity = docs.sparkSession, settings.arity
    leaves = _sorted_leaves(docs, key, group, original, altered, settings)
    schema = f"key {dict(leaves.dtypes)['key']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    spans = _spans(leaves)
    some = spans.select("trees").first()
    if some is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    trees = some["trees"]
    levels = [table(leaves.select("part", "group", "leaf", "place").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_up_from_leaves(arity), _NODE))]
    parts = spans.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        parts = -(-parts // settings.fan)
        to = levels[-1].withColumn("part", F.floor(F.col("part") / settings.fan))
        levels.append(table(to.groupBy("part").applyInArrow(_up(arity, trees), _NODE)))
    (root,) = levels[-1].collect()
    paths = spark.createDataFrame([(0, _TOP, root["level"], root["at"], [])], _PATH)
    for nodes in reversed(levels[:-1]):
        to = nodes.withColumn("to", F.floor(F.col("part") / settings.fan))
        used, paths = paths, table(to.groupBy("to").cogroup(paths.groupBy("part")).applyInArrow(_down(arity, trees), _PATH))
        drop(used)
    for nodes in levels:
        drop(nodes)
    both = spans.unionByName(paths, allowMissingColumns=True)
    found = leaves.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(_down_to_leaves(arity, root["digest"]), schema)
    return found.withColumnRenamed("key", key)
