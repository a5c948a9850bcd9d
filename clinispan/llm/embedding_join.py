"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine t or more have a squared distance of at most 2 - 2t. They are rotated and split into blocks of few components; each block gets a share of that
budget in proportion to its components, so of a similar pair at least one block is within its share. For each block the vectors are joined by
range: cells of a k-d tree hold the vectors at home in them and those within the block's distance, and a cell too full for a task is
joined part against part. A pair within the share of several blocks counts in the first; it is verified by its exact cosine where it is found, so that only
numbers of links and the edges of a spanning forest leave a task, never a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispan.llm.components import connected_components
from clinispan.llm.scratch import drop, join_counted, small, table

#: Steps of a unit in rotated components. In whole numbers every task finds the same distances, in whatever order it adds.
_STEPS = 1 << 14
#: Lengths of vectors, the most frequent ones, that are rotated and whose cells are fitted; longer vectors and others have one cell, in parts.
_LENGTHS, _LONGEST = 8, 1024
_PACK = "length int, block int, leaf int, n int, nodes binary, copies binary, home binary, rotated binary, vectors binary"
_FOUND = "node long, links long, other long"
_FOUND_ARROW = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
#: Pairs that are compared at once.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """similarity: least cosine; width: components of a block, about; sample: vectors that cells are fitted on, at most; leaf: vectors at home in
    a cell, about; depth: halvings of a block's space, at most; part: vectors of a cell that a task takes on either side, about; seed: of the rotation."""

    similarity: float = 0.9
    width: int = 16
    sample: int = 20_000
    leaf: int = 8_192
    depth: int = 12
    part: int = 16_384
    seed: int = 23


@lru_cache(maxsize=64)
def _blocks(length: int, settings: Settings) -> list[tuple[slice, int]]:
    """The blocks of vectors of a length, and the greatest squared distance in each, in steps, rounding included."""
    ends = np.linspace(0, length, max(1, round(length / settings.width)) + 1).astype(int)
    budget = max(0.0, 2 - 2 * settings.similarity)
    return [(slice(a, b), int((np.sqrt(budget * (b - a) / length) * _STEPS + np.sqrt(b - a) + 0.01) ** 2)) for a, b in zip(ends, ends[1:], strict=False)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rotated(x: np.ndarray, rotation: np.ndarray | None) -> np.ndarray:
    u = _unit(x)
    return np.rint((u if rotation is None else u @ rotation) * _STEPS).astype(np.int16)


@dataclass(frozen=True)
class Cell:
    """A leaf of a k-d tree (number), or a halving: below split on axis, or not."""

    number: int = 0
    axis: int = -1
    split: int = 0
    below: Cell | None = None
    above: Cell | None = None


#: Share of a cell's work that halving it must leave at most to be worth the copies. Vectors that fill their space evenly keep one cell.
_WORTH = 0.8


def _split(axis: int, split: int, x: np.ndarray, bound: int, at: np.ndarray, home: np.ndarray, gap: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each half of a cell: the rows of x that are in it or within the bound of it, which are in it, and their gaps to it by axis."""
    off, out = x[at, axis].astype(np.int64) - split, []
    for inside in (off < 0, off >= 0):
        there = gap.copy()
        there[~inside, axis] = np.maximum(there[~inside, axis], np.abs(off[~inside]))
        some = (there * there).sum(1) <= bound
        out.append((at[some], (home & inside)[some], there[some]))
    return out


def _start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.arange(len(x)), np.ones(len(x), bool), np.zeros(x.shape, np.int64)


def _halved(x: np.ndarray, bound: int, depth: int, first: int, at: np.ndarray, home: np.ndarray, gap: np.ndarray) -> tuple[Cell, float]:
    """A cell, halved where that leaves less to compare, and what is left: vectors at home with all that are in reach, of two at home one with the other."""
    own = x[at[home]]
    whole = float(len(own)) * len(at) - len(own) ** 2 / 2
    if not depth or len(own) < 8:
        return Cell(first), whole
    axis = int(own.var(0).argmax())
    split = int(np.median(own[:, axis]))
    halves = _split(axis, split, x, bound, at, home, gap)
    (below, less), (above, more) = (_halved(x, bound, depth - 1, first + i * (1 << (depth - 1)), *half) for i, half in enumerate(halves))
    return (Cell(first, axis, split, below, above), less + more) if less + more <= _WORTH * whole else (Cell(first), whole)


def _reached(cell: Cell, x: np.ndarray, bound: int, at: np.ndarray, home: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The leaves, the rows of x that are in each or within the bound of it, and which of them are in it."""
    if not len(at):
        return
    if cell.axis < 0:
        yield cell.number, at, home
        return
    for side, half in zip((cell.below, cell.above), _split(cell.axis, cell.split, x, bound, at, home, gap), strict=True):
        yield from _reached(side, x, bound, *half)


@dataclass(frozen=True)
class Model:
    """By length of vectors: the rotation, and the cells of each block."""

    rotations: dict[int, np.ndarray]
    cells: dict[int, list[Cell]]


def fit(classes: DataFrame, settings: Settings) -> Model:
    """Rotations and cells for the most frequent lengths, on at most settings.sample vectors picked by the hash of their numbers."""
    lengths = {r["length"]: r["count"] for r in classes.where(F.col("length") <= _LONGEST).groupBy("length").count().orderBy(F.desc("count"), "length").limit(_LENGTHS).collect()}
    share = min(1.0, settings.sample / max(sum(lengths.values()), 1))
    picked = classes.where(F.col("length").isin(*lengths)).where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("length", "vector").limit(settings.sample).toArrow()
    rotations, cells = {}, {}
    for length, n in lengths.items():
        rotations[length] = np.linalg.qr(np.random.default_rng(settings.seed).normal(size=(length, length)))[0]
        own = picked.filter(pc.equal(picked.column("length"), length)).column("vector").combine_chunks()
        x = _rotated(np.asarray(own.flatten()).reshape(len(own), length), rotations[length]) if len(own) else np.zeros((0, length), np.int16)
        depth = min(settings.depth, int(np.ceil(np.log2(max(1, n / settings.leaf)))))
        cells[length] = [_halved(x[:, block], bound, depth, 0, *_start(x[:, block]))[0] for block, bound in _blocks(length, settings)]
    return Model(rotations, cells)


def _deal(held, settings: Settings, kind: type):
    """For each block and cell, the vectors in it and near it, packed."""
    size = max(1, settings.part // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            for length in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                nodes, copies = (np.asarray(own.column(c)) for c in ("node", "copies"))
                x = np.asarray(own.column("vector").flatten()).reshape(len(own), length).astype(kind)
                q = _rotated(x, model.rotations.get(length))
                for j, (block, bound) in enumerate(_blocks(int(length), settings)):
                    cell = model.cells[length][j] if length in model.cells else Cell()
                    for leaf, at, home in _reached(cell, q[:, block], bound, *_start(q[:, block])):
                        for i in range(0, len(at), size):
                            some, in_it = at[i : i + size], home[i : i + size]
                            packed = [c.tobytes() for c in (nodes[some], copies[some], in_it, q[some], x[some])]
                            row = [pa.array([v], t) for v, t in zip((length, j, leaf, len(some)), (pa.int32(),) * 4, strict=True)] + [pa.array([p], pa.binary()) for p in packed]
                            yield pa.RecordBatch.from_arrays(row, names=["length", "block", "leaf", "n", "nodes", "copies", "home", "rotated", "vectors"])

    return run


class _Side:
    """Vectors of a part of a cell, those at home first."""

    def __init__(self, packs: pa.Table, length: int, kind: type):
        def read(name: str, t: type) -> np.ndarray:
            return np.frombuffer(b"".join(packs.column(name).to_pylist()), t)

        home = read("home", bool)
        order = np.argsort(~home, kind="stable")
        self.n_home = int(home.sum())
        self.nodes, self.copies = read("nodes", np.int64)[order], read("copies", np.int64)[order].astype(np.float64)
        self.q = read("rotated", np.int16).reshape(-1, length)[order].astype(np.float64)
        self.unit = _unit(read("vectors", kind).reshape(-1, length)[order])
        self.links = np.zeros(len(order))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exactly."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def _pair_up(settings: Settings, kind: type):
    """Links between two parts of a cell (or in one): how many each vector at home has, and edges that connect what they connect."""
    least = settings.similarity

    def linked(x: _Side, y: _Side, rows: np.ndarray, cols: np.ndarray, mask: np.ndarray, block: int, blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of mask between rows and cols: the rows and cols that have a link, and which."""
        for k in (block, *range(block)):
            rows, cols, mask = _where(rows, cols, mask)
            if not len(rows):
                return rows, cols, mask
            part, bound = blocks[k]
            mask &= (_apart(x.q[rows, part], y.q[cols, part]) <= bound) == (k == block)
        if x is y:
            mask[rows[:, None] == cols] = False
        rows, cols, mask = _where(rows, cols, mask)
        cosine = x.unit[rows] @ y.unit[cols].T
        near = cosine >= least
        for i, j in np.argwhere(mask & (np.abs(cosine - least) < 1e-12)):
            near[i, j] = float((x.unit[rows[i]] * y.unit[cols[j]]).sum()) >= least
        return _where(rows, cols, mask & near)

    def run(key: tuple, packs: pa.Table) -> pa.Table:
        length, block, _, low, high = (k.as_py() for k in key)
        sides = [_Side(packs.filter(pc.equal(packs.column("part"), p)), length, kind) for p in ((low,) if low == high else (low, high))]
        x, y, blocks = sides[0], sides[-1], _blocks(length, settings)
        part, bound = blocks[block]
        # Squared distances as one product in single precision, which passes over few that are near and rounds none of these away.
        rough = [_outer(s.q[:, part].astype(np.float32), left) for s, left in ((x, True), (y, False))]
        limit = np.float32(bound * 1.001 + 1e-5 * 4 * _STEPS**2)
        nodes = np.unique(np.concatenate([x.nodes, y.nodes]))
        at = [np.searchsorted(nodes, s.nodes) for s in (x, y)]
        label, edges = nodes.copy(), []
        # Pairs of which neither is at home here count elsewhere.
        for start, stop, end in ((0, x.n_home, len(y.nodes)), (x.n_home, len(x.nodes) if x is not y else 0, y.n_home)):
            step = max(1, _CHUNK // max(1, end))
            for i in range(start, stop, step):
                to = min(i + step, stop)
                mask = rough[0][i:to] @ rough[1][:, :end] <= limit
                if not mask.any():
                    continue
                rows, some, links = linked(x, y, np.arange(i, to), np.arange(end), mask, block, blocks)
                if not len(rows):
                    continue
                x.links[rows] += links @ y.copies[some]
                if x is not y:
                    y.links[some] += x.copies[rows] @ links
                edges += _spread(label, at[0][rows], at[1][some], links)
        far = np.flatnonzero(label != nodes)
        edges += [np.stack([nodes[far], label[far]], axis=1)]
        pairs = np.unique(np.concatenate(edges), axis=0)
        counts = [(s.nodes[: s.n_home], s.links[: s.n_home].astype(np.int64)) for s in sides]
        node, n = (np.concatenate(c) for c in zip(*((c[0][c[1] > 0], c[1][c[1] > 0]) for c in counts), strict=True))
        columns = (pa.concat_arrays([pa.array(node), pa.array(pairs[:, 0])]), pa.concat_arrays([pa.array(n), pa.nulls(len(pairs), pa.int64())]), pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(pairs[:, 1])]))
        return pa.Table.from_arrays(list(columns), schema=_FOUND_ARROW)

    return run


def _outer(x: np.ndarray, left: bool) -> np.ndarray:
    """Rows and columns whose product is the squared distance: (|x|^2, 1, -2x) and (1, |y|^2, y)."""
    size, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
    return np.concatenate([size, one, -2 * x], axis=1) if left else np.ascontiguousarray(np.concatenate([one, size, x], axis=1).T)


def _where(rows: np.ndarray, cols: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and cols that have any, and the mask of these."""
    r, c = mask.any(1), mask.any(0)
    return rows[r], cols[c], mask[np.ix_(r, c)]


def _spread(label: np.ndarray, rows: np.ndarray, cols: np.ndarray, links: np.ndarray) -> list[np.ndarray]:
    """Give linked rows and cols the least label among them; the pairs of labels that this makes one."""
    both = np.concatenate([rows, cols])
    before, far = label[both], np.iinfo(np.int64).max
    while True:
        was = label[both]
        np.minimum.at(label, cols, np.where(links, label[rows][:, None], far).min(0))
        np.minimum.at(label, rows, np.where(links, label[cols], far).min(1))
        if (label[both] == was).all():
            break
    changed = before != label[both]
    return [np.unique(np.stack([before[changed], label[both][changed]], axis=1), axis=0)] if changed.any() else []


def near_duplicate_vectors(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors.

    n_links counts the other rows of cosine settings.similarity or more, in double precision; component_id is the smallest id reachable by links. A
    row links with nothing, and is kept, if its id is null (component_id is then null too), or its vector is null, empty, zero or holds null or
    non-finite components; vectors of different lengths have no cosine. Equal vectors link, repeated rows and ids too, as a row
    each; they are compared with others once. No rows give no rows. All links are found: blocks and cells only choose where pairs meet.
    The work within a group of near copies grows with the square of its distinct vectors, in tasks of fixed size, but nothing that leaves them does.
    """
    kind, typed = (np.float32, "array<float>") if dict(vectors.dtypes)[vector_col] == "array<float>" else (np.float64, "array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(typed).alias("vector"))
    good = F.expr("coalesce(vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0), false)")
    given = given.withColumn("good", good)
    hashed = given.where("good").select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"))
    classes = table(hashed.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")).withColumns({"node": F.monotonically_increasing_id(), "length": F.size("vector")}))
    held = vectors.sparkSession.sparkContext.broadcast(fit(classes, settings))
    packs = table(classes.select("node", "copies", "length", "vector").mapInArrow(_deal(held, settings, kind), _PACK))
    cell = ["length", "block", "leaf"]
    parts = packs.groupBy(*cell).agg(F.ceil(F.sum("n") / settings.part).cast("int").alias("parts"))
    placed = packs.join(small(table(parts)), cell).withColumn("part", F.pmod(F.xxhash64("nodes"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    placed = placed.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    found = table(placed.groupBy(*cell, "low", "high").applyInArrow(_pair_up(settings, kind), _FOUND))
    drop(packs)
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("other is not null"), "node", "other")
    every = classes.select("node", "h1", "h2", "vec_id", "copies").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    every = table(every)
    drop(found)
    lowest = table(every.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")))
    told = table(join_counted(every, lowest, "component", "n").select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    for df in (classes, every, lowest):
        drop(df)
    out = join_counted(hashed.drop("vector"), told, ["h1", "h2"], "copies").select("vec_id", "n_links", "component_id")
    alone = given.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
