"""Continuous labels: information against brute force, the lasso against its conditions, selection."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.operators import baselines, causal, continuous, prepare, stats
from sieveline.plans import Config, Selector


def brute_radii(x, y, k):
    sx, sy = x.std() or 1.0, y.std() or 1.0
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx * sy, dy * sx)
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, 1, kind="stable")[:, k - 1]
    i = np.arange(len(x))
    by_x = dx[i, at] * sy >= dy[i, at] * sx
    return np.where(by_x, dx[i, at], d[i, at] / sy), np.where(by_x, d[i, at] / sx, dy[i, at])


def shapes(n, seed=0):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.ones(n), np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n)), rng.standard_cauchy(n)]


@pytest.mark.parametrize("n", [2, 3, 5, 300, 1500])
def test_radii(n):
    rng = np.random.default_rng(1)
    for x in shapes(n):
        y = 2 * x + rng.normal(size=n)
        for label in (y, np.round(y)):
            for a, b in zip(continuous.pair_radii(x, label, min(3, n - 1)), brute_radii(x, label, min(3, n - 1)), strict=True):
                assert np.array_equal(a, b)


def test_information_of_gaussians():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    assert abs(continuous.pair_information(x, x + rng.normal(size=20_000)) - 0.5 * np.log(2)) < 0.02
    assert continuous.pair_information(x, rng.normal(size=20_000)) < 0.02
    assert continuous.pair_information(x[:1], x[:1]) == 0.0


@pytest.fixture(scope="module")
def numbers(spark):
    n = 900
    columns = shapes(n, 3)
    rng = np.random.default_rng(5)
    y = columns[0] + 0.5 * columns[1] + 0.1 * rng.normal(size=n)
    rows = [(i, *[None if (i + j) % 50 == 0 else float(c[i]) for j, c in enumerate(columns)], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, label double").repartition(3)
    return FeatureFrame(df, ("a", "b", "c", "d", "e"), "label", "id", discrete=False)


def test_spread_information(numbers):
    """Cells of bands and rectangles, whatever their size, give what arrays give."""
    direct = {r.f: r.score for r in causal.mutual_information(numbers).collect()}
    for size in (4, 60):
        spread = {r.f: r.score for r in continuous.continuous_information(numbers, direct=0, size=size).collect()}
        assert spread.keys() == direct.keys() and all(abs(spread[f] - direct[f]) < 1e-9 for f in direct)
    assert max(direct, key=direct.get) == 0 and direct[2] < 1e-9
    empty = numbers.with_df(numbers.df.where("false"))
    assert {r.score for r in causal.mutual_information(empty).collect()} == {0.0}
    with pytest.raises(ValueError):
        causal.mutual_information(numbers, weights=numbers.df)


def test_rows_are_sent_to_few_cells(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(4000, 2)))]
    cells = spark.createDataFrame(rows, "f int, id long, x double, y double")
    radii = {r.id: (r.rx, r.ry) for r in continuous.spread_radii(cells, 3, 64).collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    want = brute_radii(x, y, 3)
    near = np.array([radii[i] for i in range(4000)])
    assert np.allclose(near[:, 0], want[0], rtol=1e-12) and np.allclose(near[:, 1], want[1], rtol=1e-12)


def test_lasso_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[:, 1] = x[:, 0] + 0.3 * x[:, 1]
    x[:, 7] = 1.0
    y = 3 * x[:, 0] - 2 * x[:, 3] + 0.1 * rng.normal(size=300)
    g = K.Gram.of(x, y)
    for penalty in (0.01, 0.5, 100.0):
        w = continuous.lasso(g, penalty)
        pull = (g.cross[:-1, -1] - g.cross[:-1, :-1] @ w) / g.n  # optimal: the penalty's slope where w isn't 0, at most it elsewhere
        assert np.allclose(pull[w != 0], penalty * np.sign(w[w != 0]), atol=1e-7) and (np.abs(pull) <= penalty + 1e-7).all()
    assert not w.any() and continuous.lasso(g)[7] == 0.0
    one = K.Gram.of(x[:, :1], y)
    assert np.isclose(continuous.lasso(one, 0.5)[0], (one.cross[0, 1] / 300 - 0.5) / (one.cross[0, 0] / 300), atol=1e-9)


def test_selection_and_baselines(numbers):
    filled = prepare.impute(numbers)
    model = Selector(Config(n_representatives=2, n_bootstrap=4)).fit(numbers)
    assert 0 in model.selected_features_ and not model.transform(numbers).discrete
    assert model.transform(numbers).df.schema["y"].dataType.simpleString() == "double"
    assert 0 in baselines.build_baseline("LASSO", 2).fit(numbers).selected_features_
    assert np.argmax(causal.forest_relevance(filled, trees=10)) == 0
    kept, at = prepare.prefilter(numbers, 3)
    spread = [v[0] for v in filled.df.select(*[F.var_pop(c) for c in filled.features]).toPandas().T.values]
    assert at == sorted(np.argsort(spread)[-3:].tolist()) and kept.features == tuple(numbers.features[i] for i in at)


def test_variance_where_there_is_no_f(numbers):
    one = replace(numbers.with_df(numbers.df.withColumn("label", F.lit(0))), discrete=True)
    assert prepare.prefilter(one, 2)[1] == prepare.prefilter(numbers, 2)[1]


def test_wide_tables(numbers, monkeypatch):
    want = stats.gram(numbers).correlations()
    monkeypatch.setattr(stats, "WIDE", 2)
    assert np.allclose(stats.gram(numbers).correlations(), want)


def test_frequent_values_do_not_fill_a_region():
    """Rows of few or equal values are dealt evenly, and reach few rows of other regions."""
    rng = np.random.default_rng(4)
    n = 20_000
    ids = np.arange(n)
    for x, y in ((rng.integers(0, 3, n).astype(float), rng.normal(size=n)), (np.ones(n), np.ones(n)), (np.ones(n), rng.normal(size=n))):
        slabs, rows = continuous._splits(x, y, 20)
        plane = continuous._Plane(n, 1.0, 1.0, 0, slabs, rows, (continuous._Ranges.of(x, 20), continuous._Ranges.of(y, 20)))
        sizes = np.bincount(plane.region(x, y, ids))
        assert sizes.max() < 4 * n / 20
    assert (continuous._Ranges.of(np.ones(100), 20).of_values(np.array([0.0, 1.0, 2.0])) == [0, 1, 2]).all()


def test_spread_information_of_copies(spark):
    """Equal points, numbers of few values and far outliers: the same as arrays give."""
    rng = np.random.default_rng(6)
    a = np.repeat(rng.normal(size=150), 8)
    columns = [a, rng.integers(0, 4, 1200) * 0.5, np.where(rng.random(1200) < 0.01, 1e6, rng.normal(size=1200))]
    y = np.repeat(rng.normal(size=300), 4)
    df = spark.createDataFrame([(i, *(float(c[i]) for c in columns), float(y[i])) for i in range(1200)], "id long, a double, b double, c double, label double")
    frame = FeatureFrame(df, ("a", "b", "c"), "label", "id", discrete=False)
    direct = {r.f: r.score for r in continuous.continuous_information(frame).collect()}
    spread = {r.f: r.score for r in continuous.continuous_information(frame, direct=0, size=40).collect()}
    assert all(abs(spread[f] - direct[f]) < 1e-9 for f in direct)
