"""Neighbours and ranks from cells against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.operators import neighbours as N


def clouds(n=900, d=3, seed=0):
    """Clusters far apart, a crowd of equal rows, a grid of ties and some outliers."""
    rng = np.random.default_rng(seed)
    x = np.concatenate((rng.normal(size=(n // 3, d)) + 30 * rng.integers(0, 6, (n // 3, 1)), np.tile([5.0] * d, (n // 3, 1)), rng.integers(0, 4, (n // 3 - 5, d)).astype(float), 500 * rng.normal(size=(5, d))))
    return x[rng.permutation(len(x))]


def brute(x, k, fold=None):
    d = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d += (x[:, i : i + 1] - x[None, :, i]) ** 2
    np.fill_diagonal(d, np.inf)
    if fold is not None:
        d[fold[:, None] == fold] = np.inf
    order = np.argsort(d, 1, kind="stable")  # ties by id
    return [[int(j) for j in row[:k] if np.isfinite(d[i, j])] for i, row in enumerate(order)]


def table(spark, x, fold):
    return spark.createDataFrame([(i, i % 4, int(fold[i]), r.tolist()) for i, r in enumerate(x)], "row_id long, y int, fold int, x array<double>").repartition(3)


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, {})[r.rank] = (r.other, r.y)
    return out


@pytest.mark.parametrize(("block", "asks"), [(2048, 8192), (40, 30)])
def test_nearest(spark, monkeypatch, block, asks):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ASKS", asks)
    x = clouds()
    fold = np.arange(len(x)) % 5
    rows = table(spark, x, fold)
    for apart in (False, True):
        want = brute(x, 5, fold if apart else None)
        found = listed(N.nearest(rows, 5, apart))
        assert all([found[i][r + 1] for r in range(5)] == [(j, j % 4) for j in want[i]] for i in range(len(x)))


def test_few_rows(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    rows = table(spark, x, np.array([0, 0, 1]))
    assert listed(N.nearest(rows, 5, False)) == {0: {1: (1, 1), 2: (2, 2)}, 1: {1: (0, 0), 2: (2, 2)}, 2: {1: (1, 1), 2: (0, 0)}}
    assert listed(N.nearest(rows, 5, True)) == {0: {1: (2, 2)}, 1: {1: (2, 2)}, 2: {1: (1, 1), 2: (0, 0)}}
    assert N.nearest(rows.where("row_id = 0"), 3, False).count() == 0


def test_rows_go_to_few_blocks(spark, monkeypatch):
    """Copies a row: far below the number of blocks, which is what comparing all with all would send."""
    monkeypatch.setattr(N, "BLOCK", 30)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1800, 2)) + 40 * rng.integers(0, 30, (1800, 1))
    sent, real = [], N.asked_blocks

    def counting(*a):
        out = real(*a)
        sent.append((out.count(), len(a[1].table)))
        return out

    monkeypatch.setattr(N, "asked_blocks", counting)
    N.nearest(table(spark, x, np.zeros(1800)), 5, False).count()
    (copies, blocks) = sent[0]
    assert blocks >= 60 and copies / 1800 < blocks / 8


@pytest.mark.parametrize("block", [2048, 40])
def test_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    x = clouds(600)
    points = table(spark, x, np.zeros(len(x))).select("row_id", "x")
    rng = np.random.default_rng(1)
    spots = [(i, [int(j) for j in rng.choice(len(x), 4, replace=False) if j != i]) for i in range(0, len(x), 3)]
    order = brute(x, len(x))
    want = {(i, j): order[i].index(j) + 1 for i, to in spots for j in to}
    got = {(r.row_id, r.other): r["rank"] for r in N.ranks_of(points, spark.createDataFrame(spots, "row_id long, others array<long>")).collect()}
    assert got == want


def test_bounds_hold():
    x = clouds(300)
    pivots = x[:7]
    near = ((x[:, None] - pivots) ** 2).sum(2)
    at, r = near.argmin(1), np.sqrt(near.min(1))
    table = np.array([(p, 0, r[at == p].min(), r[at == p].max(), (at == p).sum()) for p in np.unique(at)])
    low, high = N.Cells(pivots, table).reach(x)
    true = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for c, row in enumerate(table):
        mine = true[:, at == row[0]]
        assert (low[:, c] <= mine.min(1)).all() and (high[:, c] >= mine.max(1)).all()


def test_numbers_of_any_type(spark):
    rows = spark.range(4).select(F.col("id").cast("int").alias("row_id"), F.lit(1).alias("y"), F.lit(0).alias("fold"), F.array(F.col("id").cast("double")).alias("x"))
    assert {(r.row_id, r.other) for r in N.nearest(rows, 1, False).collect()} == {(0, 1), (1, 0), (2, 1), (3, 2)}


def test_estimated_distances_find_what_sums_find(spark, monkeypatch):
    """Many features: rows found by a product, with ties, far from the origin, and a row without a number."""
    monkeypatch.setattr(N, "BLOCK", 100)
    x = clouds(600, 12) + 1e6
    fold = np.arange(len(x)) % 5
    odd = np.concatenate((x, np.full((1, 12), np.nan)))
    held = pa.table({"row_id": np.arange(601), "y": np.zeros(601, np.int32), "fold": np.zeros(601, np.int32), "x": odd.tolist()})
    near = N._compared(odd, np.arange(601), np.ones(601), held, 5, True).to_pylist()
    assert near[600] == [] and all(len(r) == 5 and r[0]["other"] < 600 for r in near[:600])
    found = listed(N.nearest(table(spark, x, fold), 5, True))
    assert all([found[i][r + 1][0] for r in range(5)] == j for i, j in enumerate(brute(x, 5, fold)))
    d, error = N.estimates(x, x)
    assert 0 < error < 1e-2 and np.abs(d - N.squares(x, x)).max() <= error
    assert N.estimates(np.array([[np.nan]]), np.array([[1.0]]))[1] == 0


def test_feature_sets_of_larger_tables_are_searched_apart(spark, monkeypatch):
    """Both ways give the same accuracies; the second sends no row to all blocks."""
    from sieveline.operators import evaluate as E

    x = clouds(600, 4)
    rows = table(spark, x, np.arange(len(x)) % 3)
    order, sizes = [2, 0, 3, 1], [1, 2, 4]
    want = E.prefix_accuracies(rows, order, sizes), E.prefix_recalls(rows, order, sizes), E.swap_accuracies(rows, [1, 3], [0, 2])
    monkeypatch.setattr(E, "FEW_ROWS", 100)
    monkeypatch.setattr(E, "_blocks", None)
    assert (E.prefix_accuracies(rows, order, sizes), E.prefix_recalls(rows, order, sizes), E.swap_accuracies(rows, [1, 3], [0, 2])) == want


def test_rows_without_structure_go_to_few_parts(spark, monkeypatch):
    """Nearly every block may hold a near row, but blocks travel by parts: copies don't grow with the number of blocks."""
    monkeypatch.setattr(N, "BLOCK", 20)
    x = np.random.default_rng(7).normal(size=(1200, 8))
    sent, real = [], N.asked_blocks

    def counting(*a):
        out = real(*a)
        sent.append((out.count(), len(a[1].table)))
        return out

    monkeypatch.setattr(N, "asked_blocks", counting)
    N.nearest(table(spark, x, np.zeros(1200)), 5, False).count()
    assert sent[0][1] >= 60 and sent[0][0] / 1200 <= 10
