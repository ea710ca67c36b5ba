"""Cells of few features: leaves of a k-d tree, and boxes that leave blocks out."""

import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import neighbours as N


def _rows(spark, x):
    return spark.createDataFrame([(i, i % 2, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, y int, fold int, x array<double>")


def test_boxes_leave_out_most_blocks_of_rows_without_structure(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 256)
    x = np.random.default_rng(5).normal(size=(6000, 4))
    dealt, cells = N.cells_of(_rows(spark, x))
    placed = {r.row_id: r.b for r in dealt.select("row_id", "b").collect()}
    own = np.array([placed[i] for i in range(len(x))])
    asked = near = 0
    for i in range(0, len(x), 40):
        d = N.squares(x[i : i + 1], x)[0]
        d[i] = np.inf
        bound = np.sqrt(np.sort(d)[4])
        low, high = cells.reach(x[i : i + 1])
        true = np.sqrt(np.delete(d, i))
        block = np.delete(own, i)
        assert (low[0, block] <= true).all() and (high[0, block] >= true).all()
        asked, near = asked + int((low[0] <= bound).sum()), near + 1
    assert asked / near < len(cells.table) / 4


def test_tree_with_equal_values_and_crowds():
    x = np.repeat([[0.0, 0.0], [0.0, 1.0], [5.0, 1.0]], [500, 3, 20], axis=0)
    tree = N.Tree(x, 16)
    leaf = tree.leaf(x)
    assert len(np.unique(leaf)) == 3 == len({(int(a), *r) for a, r in zip(leaf, x.tolist(), strict=True)})
    assert len(N.Tree(np.zeros((40, 2)), 8).middles) == 1 and N.Tree(np.zeros((0, 2)), 8).leaf(np.ones((2, 2))).tolist() == [0, 0]


def test_boxed_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 128)
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(500, 3)).round(1), np.zeros((150, 3)), rng.normal(size=(50, 3)) * 1e6))
    found = {}
    for r in N.nearest(_rows(spark, x), 4, True).collect():
        found.setdefault(r.row_id, {})[r["rank"]] = r.other
    for i in range(len(x)):
        d = N.squares(x[i : i + 1], x)[0]
        others = np.flatnonzero(np.arange(len(x)) % 3 != i % 3)
        want = others[np.lexsort((others, d[others]))][:4].tolist()
        assert [found[i][j] for j in (1, 2, 3, 4)] == want
    spots = _rows(spark, x).select("row_id", F.array(((F.col("row_id") + 7) % len(x)).alias("o")).alias("others"))
    for r in N.ranks_of(_rows(spark, x).select("row_id", "x"), spots).collect():
        d = N.squares(x[r.row_id : r.row_id + 1], x)[0]
        before = (d < d[r.other]) | ((d == d[r.other]) & (np.arange(len(x)) < r.other))
        before[r.row_id] = False
        assert r["rank"] == before.sum() + 1
