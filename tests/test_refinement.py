"""Swaps, linkage, review and the encoder against plain versions."""

import numpy as np
import pytest

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.operators import evaluate, stats, sums
from sieveline.operators.baselines import build_baseline
from sieveline.operators.encoder import Autoencoder, gradients, initial, row_noise
from sieveline.plans.experiments import held_out
from sieveline.plans.selector import wrapper_refine


@pytest.fixture(scope="module")
def ring(spark):
    """Two classes, one inside the other, in features 0 and 3; others are noise, 2 is a rounded copy of 0."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 6))
    y = (x[:, 0] ** 2 + x[:, 3] ** 2 > 1.4).astype(int)
    x[:, 2] = np.round(x[:, 0])
    df = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x, strict=True))], "row_id long, y int, " + ", ".join(f"x{i} double" for i in range(6))).repartition(3)
    return FeatureFrame(df, tuple(f"x{i}" for i in range(6)))


@pytest.mark.parametrize("block", [2048, 70])
def test_swaps_are_the_accuracies_of_subsets(ring, monkeypatch, block):
    monkeypatch.setattr(evaluate, "BLOCK", block)
    found = evaluate.swap_accuracies(evaluate.folded(ring, 3), [4, 1], [0, 2, 3, 5])
    assert found.keys() == {0, 2, 3, 5}
    for f, a in found.items():
        assert abs(a - evaluate.knn_accuracy(ring.take([4, 1, f]), folds=3)) < 1e-12
    alone = evaluate.swap_accuracies(evaluate.folded(ring, 3), [], [2])
    assert abs(alone[2] - evaluate.knn_accuracy(ring.take([2]), folds=3)) < 1e-12


def test_refinement_finds_the_ring(ring):
    assert wrapper_refine(ring, [1, 4], list(range(6)), 3) == [0, 3]
    assert wrapper_refine(ring, [0, 3], list(range(6))) == [0, 3]
    assert wrapper_refine(ring, [5], [5]) == [5] and wrapper_refine(ring, [], [1]) == []


def every_pair(d):
    """Merges by looking at all pairs each time."""
    clusters, out = [(i,) for i in range(len(d))], []
    while len(clusters) > 1:
        height, a, b = min((float(np.mean(d[np.ix_(a, b)])), a, b) for i, a in enumerate(clusters) for b in clusters[i + 1 :])
        out.append((a, b, height))
        clusters = sorted([c for c in clusters if c not in (a, b)] + [tuple(sorted(a + b))])
    return out


def test_linkage():
    rng = np.random.default_rng(3)
    for p in (1, 2, 3, 25):
        x = rng.random((p, p))
        d = x + x.T
        np.fill_diagonal(d, 0)
        merges = K.average_linkage(d)
        for m, (a, b, h) in zip(merges, every_pair(d), strict=True):
            assert (m.left, m.right) == (a, b) and abs(m.distance - h) < 1e-9
    even = np.ones((5, 5)) - np.eye(5)
    assert [(m.left, m.right) for m in K.average_linkage(even)] == [((0,), (1,)), ((0, 1), (2,)), ((0, 1, 2), (3,)), ((0, 1, 2, 3), (4,))]
    points = np.sort(rng.random(3000))
    merges = K.average_linkage(np.abs(points[:, None] - points))
    assert len(merges) == 2999 and sorted(merges[-1].left + merges[-1].right) == list(range(3000))


def test_reviews():
    merges = [K.Merge(0, (2,), (3,), 0.1), K.Merge(1, (1,), (2, 3), 0.13), K.Merge(2, (0,), (4,), 0.9), K.Merge(3, (0, 4), (1, 2, 3), 1.1)]
    relevance, blanket = np.array([0.0, 0.2, 0.4, 0.8, 1.0]), np.array([0, 1, 1, 0, 0.5])
    found = K.ambiguous(merges, relevance, blanket, 0.05)
    assert [(r.step, r.conflicting) for r in found] == [(0, True), (2, True), (3, False)]
    assert [round(r.causal_gap, 6) for r in found] == [0.4, 1.0, round(abs(0.5 - 1.4 / 3), 6)]
    assert [round(r.distance_gap, 6) for r in found] == [0.03, 0.2, 0.0] and found[0].next_distance == 0.13
    assert K.ambiguous([], relevance, blanket) == []
    assert [r.step for r in K.ambiguous(merges, relevance, blanket * 0, 0.05)] == [0, 3]


def test_gradients_are_slopes():
    rng = np.random.default_rng(4)
    w, x, noise = initial(4, 5, 2, 0), rng.normal(size=(7, 4)), rng.normal(size=(7, 2))
    loss, g = gradients(w, x, noise, 0.3)
    for layer, slope in zip(w, g, strict=True):
        at = tuple(rng.integers(0, s) for s in layer.shape)
        kept, step = layer[at], 1e-6
        layer[at] = kept + step
        more, _ = gradients(w, x, noise, 0.3)
        layer[at] = kept
        assert abs((more - loss) / step - slope[at]) < 1e-3 * max(1, abs(slope[at]))


def test_noise():
    a = row_noise(np.arange(20_000), 3, 1, 0)
    assert np.allclose(a.mean(0), 0, atol=0.03) and np.allclose(a.std(0), 1, atol=0.03) and abs(np.corrcoef(a.T)[0, 1]) < 0.03
    assert np.array_equal(a[5:9], row_noise(np.arange(5, 9), 3, 1, 0)) and not np.allclose(a[:9], row_noise(np.arange(9), 3, 2, 0))


def test_encoder(spark):
    """A curve in three dimensions beside one wide dimension of noise: the encoder's choice isn't that of principal components."""
    rng = np.random.default_rng(6)
    t = rng.uniform(-2, 2, 300)
    x = np.column_stack((t, t**2, np.sin(3 * t), *rng.normal(size=(2, 300))))
    x[:, 4] = x[:, 3] + 0.05 * x[:, 4]
    frame = FeatureFrame(spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(x)], "row_id long, y int, a double, b double, c double, d double, e double").repartition(2), tuple("abcde"))
    one, two = build_baseline("VAE", 2).fit(frame), build_baseline("VAE", 2).fit(frame.with_df(frame.df.repartition(5)))
    assert one.model.losses[-1] < 0.7 * one.model.losses[0] and len(one.model.losses) == 150
    assert one.selected_features_ == two.selected_features_ and np.allclose(one.model.losses, two.model.losses, rtol=1e-6)
    out = one.transform(frame)
    assert out.features == ("latent_0", "latent_1")
    z = one.scaler.transform(frame).df.orderBy("row_id").toPandas()[list("abcde")].to_numpy()
    w = one.model.weights
    assert np.allclose(np.maximum(z @ w[0] + w[1], 0) @ w[2] + w[3], out.df.orderBy("row_id").toPandas()[list(out.features)].to_numpy())
    slope = np.abs(((z @ w[0] + w[1] > 0) * w[2].sum(1)) @ w[0].T).mean(0)
    assert np.allclose(one.model.saliency(one.scaler.transform(frame)), slope)
    nothing = Autoencoder(2, 3).fit(frame.with_df(frame.df.where("false")))
    assert nothing.losses == []


def test_sums_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sums, "SPREAD", 3)
    rows = [(b, part, np.full(4, float(part + b)).tobytes()) for b in (-1, 0, 2) for part in range(20)]
    parts = spark.createDataFrame([(b, p, bytearray(s)) for b, p, s in rows], sums.SPEC)
    for tasks in (None, 20):
        assert {b: t.tolist() for b, t in sums.summed(parts, tasks).items()} == {b: [190.0 + 20 * b] * 4 for b in (-1, 0, 2)}


def test_moments_in_groups(ring):
    many = ring.with_df(ring.df.repartition(40))
    assert np.allclose(stats.gram(ring).cross, stats.gram(many).cross)


@pytest.mark.parametrize("block", [2048, 70])
def test_prefixes_are_the_accuracies_of_subsets(ring, monkeypatch, block):
    monkeypatch.setattr(evaluate, "BLOCK", block)
    order = [3, 5, 0, 2]
    found = evaluate.prefix_accuracies(evaluate.folded(ring), order, [1, 3, 4])
    assert found.keys() == {1, 3, 4}
    for k, a in found.items():
        assert abs(a - evaluate.knn_accuracy(ring.take(order[:k]))) < 1e-12


def test_held_out_rows(ring):
    """Recalls of rows of fold 1 by hand."""
    rows = ring.df.toPandas().sort_values("row_id")
    x, y, test = rows[list(ring.features)].to_numpy(), rows["y"].to_numpy(), rows["row_id"].to_numpy() % 4 == 0
    parts = [ring.with_df(ring.df.where(c)) for c in ("row_id % 4 <> 0", "row_id % 4 = 0")]
    found = held_out(*parts, [0, 3, 1], [2, 3], ("knn",))
    for k in (2, 3):
        f = [0, 3, 1][:k]
        near = np.argsort(((x[test][:, None, f] - x[~test][None][:, :, f]) ** 2).sum(2), 1, kind="stable")[:, :5]
        guess = (y[~test][near].mean(1) > 0.5).astype(int)
        assert abs(found[k] - np.mean([(guess[y[test] == c] == c).mean() for c in (0, 1)])) < 1e-12
    both = held_out(*parts, [0, 3, 1], [2, 3], ("knn", "logreg"))
    assert all(both[k] >= found[k] for k in found)
