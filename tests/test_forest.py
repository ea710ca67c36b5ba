"""Forests of resamples against trees grown row by row."""

import numpy as np
import pytest

from sieveline.frame import FeatureFrame
from sieveline.operators import forest as R, stats
from sieveline.plans import Config, Selector, soft


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack((rng.normal(size=400), rng.integers(0, 3, 400), rng.normal(size=400), rng.normal(size=400)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 1)).astype(int) + (x[:, 0] > 1.2)
    df = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x, strict=True))], "row_id long, y int, a double, b double, c double, d double").repartition(3)
    return FeatureFrame(df, tuple("abcd")), x, y


def grown(x, y, w, tree, shape, edges, many, classes):
    """Gains by feature of one tree, grown by trying every cut of every node."""
    out, binned = np.zeros(x.shape[1]), R._binned(x, edges)

    def impurity(at):
        n = w[at].sum()
        if not n:
            return 0.0
        if classes:
            return n * (1 - sum((w[at][y[at] == c].sum() / n) ** 2 for c in range(classes)))
        mean = (w[at] * y[at]).sum() / n
        return (w[at] * (y[at] - mean) ** 2).sum()

    def go(at, node, depth):
        if depth == shape.depth or w[at].sum() < shape.least:
            return
        options = []
        for j, f in enumerate(R.candidates(tree, node, x.shape[1], many, shape.seed)):
            for cut in range(shape.bins - 1):
                left = at[binned[at, f] <= cut]
                right = at[binned[at, f] > cut]
                if w[left].sum() and w[right].sum():
                    options.append((-round(impurity(at) - impurity(left) - impurity(right), 9), j, cut, f, left, right))
        if options and -min(o[:3] for o in options)[0] > 1e-9:
            gain, _, _, f, left, right = min(options, key=lambda o: o[:3])
            out[f] -= gain
            go(left, 2 * node, depth + 1)
            go(right, 2 * node + 1, depth + 1)

    go(np.flatnonzero(w > 0), 1, 0)
    return out


@pytest.mark.parametrize(("discrete", "memory"), [(True, 48 << 20), (False, 48 << 20), (True, 4000)])
def test_importances(data, monkeypatch, discrete, memory):
    monkeypatch.setattr(R, "MEMORY", memory)
    frame, x, y = data
    frame = FeatureFrame(frame.df, frame.features, discrete=discrete)
    shape = R.Shape(trees=3, depth=3, bins=8, seed=5)
    found = R.forest_importances(frame, 2, 42, shape)
    ids = np.arange(400)
    edges = [np.unique(np.quantile(c, np.arange(1, 8) / 8, method="lower")) for c in x.T]
    for b in (-1, 0, 1):
        shares = []
        for t in range(3):
            w = stats.poisson_weights(ids, (1 << 20) + t, 5) * (stats.poisson_weights(ids, b, 42) if b >= 0 else 1)
            gains = grown(x, y.astype(float), w, t, shape, edges, 3, 3 if discrete else 0)
            shares.append(gains / gains.sum())
        mean = np.mean(shares, 0)
        assert np.allclose(found[b], mean / mean.max(), atol=1e-6)
    assert set(found) == {-1, 0, 1} and found[-1][0] > 2 * found[-1][2]


def test_edges():
    x = np.array([[0.0], [0.0], [1.0], [2.0]])
    assert R._binned(x, [np.array([0.0, 1.0])]).ravel().tolist() == [0, 0, 1, 2]
    h = np.zeros((1, 1, 3, 2))
    h[0, 0, 0, 0] = h[0, 0, 2, 1] = 4
    gain, which, cut = R.best_splits(h, 2, 2.0)
    assert (gain[0], which[0], cut[0]) == (4.0, 0, 0)
    assert R.best_splits(h * 0, 2, 2.0)[0].tolist() == [0.0]


def test_selection_with_refits(data):
    frame = data[0]
    model = Selector(soft(2, 4, 3), refit_rows=True).fit(frame)
    assert model.selected_features_ == [0, 1] and len(model.selections_) == 8
    plain = Selector(Config(n_representatives=2, n_bootstrap=2, rf_relevance=True, prototype_by="greedy", improved_greedy=True), refit_rows=True).fit(frame)
    assert plain.selected_features_ == [0, 1]


def test_empty(data):
    frame = data[0]
    assert not R.forest_importances(frame.with_df(frame.df.where("false")), 1)[0].any()
