"""Cells of a sketch against plain sums, and what making them costs."""

import random

from clinispan.llm import fingerprints


def below(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from below(children.apply(i))


def test_cells_take_digests_in_one_pass_each(spark):
    """Each digest is in one cell of every third; a difference is that of the sketches; a cell is one fold, without a filter before it."""
    rng = random.Random(4)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)], [rng.getrandbits(64) - (1 << 63) for _ in range(m)]) for n, m in ((0, 0), (1, 0), (9, 14), (40, 3))]
    df = spark.createDataFrame([(x, y + x[:2]) for x, y in rows], "x array<bigint>, y array<bigint>")
    for cells, bits, first in ((fingerprints.CELLS, 3, 8), (fingerprints.LARGE, 5, 30)):
        made = df.selectExpr("x", "y", f"{fingerprints.sketch('x', cells)} as s", f"{fingerprints.difference('x', 'y', cells)} as d")
        for r in made.collect():
            part = cells // 3
            for name, sides in (("s", ((r["x"], 1),)), ("d", ((r["x"], 1), (r["y"], -1)))):
                n, k = [0] * cells, [0] * cells
                for digests, sign in sides:
                    for d in digests:
                        for i in range(3):
                            at = i * part + ((d % (1 << 64)) >> (bits * i + first)) % part
                            n[at], k[at] = n[at] + sign, k[at] ^ d
                assert [c["n"] for c in r[name]] == n and [c["k"] for c in r[name]] == k
    expressions = df.selectExpr(fingerprints.sketch("x"))._jdf.queryExecution().optimizedPlan().expressions()
    names = [n.getClass().getSimpleName() for i in range(expressions.size()) for n in below(expressions.apply(i))]
    assert "ArrayFilter" not in names and names.count("ArrayAggregate") == fingerprints.CELLS + 1
