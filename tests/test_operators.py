"""Operators on small hand-made tables, and properties of whole selections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.operators import baselines, causal, consensus, evaluate, prepare, report, stats, structure
from sieveline.operators.ranking import running_count
from sieveline.plans import Config, Selector, soft, strict
from sieveline.plans import experiments as X
from sieveline.sources import results as R
from sieveline.sources.synthetic import make_madelon_like, make_structural, make_synthetic
from sieveline.sources.tables import CATALOGUE, Catalogue, Entry, first_that_loads, load_csv


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 5)) + np.outer(y, [1.5, 0.0, 0.7, 0.0, 0.0])
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=120) * 0.1
    x[:, 4] = 7.0
    rows = [(i, *[None if (i + f) % 11 == 0 and f < 4 else float(v) for f, v in enumerate(r)], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return FeatureFrame(spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, e double, y int"), tuple("abcde"), name="table")


def matrix(frame):
    rows = sorted(frame.wide().collect(), key=lambda r: r["row_id"])
    return np.array([[np.nan if r[c] is None else r[c] for c in frame.features] for r in rows]), np.array([r["y"] for r in rows])


def test_impute_and_scale(table):
    x, _ = matrix(table)
    middle = np.nanmedian(x, 0)
    assert prepare.medians(table) == pytest.approx(middle)
    assert prepare.medians(table, direct=10, few=7) == pytest.approx(middle)
    filled = np.where(np.isnan(x), middle, x)
    z, _ = matrix(prepare.Standardiser().fit_transform(table))
    spread = filled.std(0)
    assert z == pytest.approx((filled - filled.mean(0)) / np.where(spread > 0, spread, 1))
    with pytest.raises(RuntimeError):
        prepare.Standardiser().transform(table)


def test_empty_column_and_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan"), 0), (2, None, 1.0, 1)], "row_id long, a double, b double, y int")
    frame = FeatureFrame(df, ("a", "b"))
    assert [tuple(r)[2:] for r in prepare.impute(frame).df.orderBy("row_id").collect()] == [(0.0, 1.0), (0.0, 1.0)]


def test_caps_and_sample(table):
    x, y = matrix(prepare.impute(table))
    kept = prepare.variance_cap(prepare.impute(table), 2).features
    assert kept == tuple("abcde"[i] for i in sorted(np.argsort(-x.var(0))[:2]))
    s = prepare.stratified_sample(table, 50).wide().groupBy("y").count().collect()
    assert sum(r["count"] for r in s) == 50
    assert all(abs(r["count"] - 50 * (y == r["y"]).mean()) <= 1 for r in s)
    assert prepare.stratified_sample(table, 500) is table
    assert prepare.common_schema(table, 3, 40).df.count() == 40


def test_encoding(spark):
    df = spark.createDataFrame([(3, "b", "z"), (1, "c", "x"), (2, None, "x"), (4, "c", "y")], "row_id long, v string, y string")
    coded = prepare.codes_by_first_appearance(df, "v", "row_id", "k").orderBy("row_id").collect()
    assert [r["k"] for r in coded] == [0.0, -1.0, 1.0, 0.0]
    assert [r["k"] for r in prepare.label_codes(df, "y", "k").orderBy("row_id").collect()] == [0, 0, 2, 1]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n,m,colour,label\n1,1.5,?,red,b\n2,2.5,4,blue,a\n3,,5,red,b\n")
    f = load_csv(spark, str(tmp_path / "t.csv"), ids=("absent",), row_id="id")
    assert f.features == ("n", "m", "colour")
    assert [tuple(r) for r in f.wide().orderBy("row_id").collect()] == [(1, 1, 1.5, 4.5, 0.0), (2, 0, 2.5, 4.0, 1.0), (3, 1, 2.0, 5.0, 0.0)]
    g = load_csv(spark, str(tmp_path / "t.csv"), ids=("id",), question_mark="codes")
    assert g.features == ("n", "m", "colour") and sorted(r["m"] for r in g.wide().collect()) == [-1.0, 0.0, 1.0]


def test_catalogue(spark):
    def broken(spark, root):
        raise ValueError("no")

    c = Catalogue([Entry("a", lambda s, d: make_synthetic(s, 30), 2), Entry("b", broken, 2, offline=False)])
    assert c.available_offline() == ["a"] and c.load(spark, "a", "", 4, 20).df.count() == 20
    with pytest.raises(KeyError):
        c.load(spark, "c", "")
    with pytest.raises(RuntimeError):
        c.load(spark, "b", "")
    with pytest.raises(RuntimeError):
        first_that_loads([lambda: broken(None, None)], "x")
    assert "orders" in CATALOGUE.available_offline()


def test_anova(table):
    x, y = matrix(table)
    got = {r["f"]: r["score"] for r in prepare.anova_f(table).collect()}
    for f in range(4):
        v, c = x[~np.isnan(x[:, f]), f], y[~np.isnan(x[:, f])]
        between = sum((c == k).sum() * (v[c == k].mean() - v.mean()) ** 2 for k in range(3)) / 2
        within = sum(((v[c == k] - v[c == k].mean()) ** 2).sum() for k in range(3)) / (len(v) - 3)
        assert got[f] == pytest.approx(between / within)
    assert got[4] == 0
    assert prepare.prefilter(table, 2)[1] == sorted(sorted(range(5), key=lambda f: -got[f])[:2])


def test_wide_tables_go_by_arrays(table, monkeypatch):
    from sieveline.operators import moments

    want = prepare.medians(table), prepare.scale_stats(table), {r["f"]: r["score"] for r in prepare.anova_f(table).collect()}, prepare.variance_cap(table, 2).features, stats.gram(prepare.impute(table)).cross
    for m in (moments, prepare, stats):
        monkeypatch.setattr(m, "WIDE", 2)
    assert prepare.medians(table) == pytest.approx(want[0])
    assert np.array(prepare.scale_stats(table)) == pytest.approx(np.array(want[1]))
    assert {r["f"]: r["score"] for r in prepare.anova_f(table).collect()} == pytest.approx(want[2])
    assert prepare.variance_cap(table, 2).features == want[3]
    assert stats.gram(prepare.impute(table)).cross == pytest.approx(want[4], abs=1e-8)


def test_grams(table):
    x, y = matrix(prepare.impute(table))
    want = K.Gram.of(x, y)
    ready = prepare.impute(table)
    found = stats.grams(ready, 3, 7)
    assert found[-1].n == want.n and found[-1].mean == pytest.approx(want.mean) and found[-1].cross == pytest.approx(want.cross, abs=1e-8)
    for b in range(3):
        w = stats.poisson_weights(np.arange(120), b, 7).astype(int)
        again = K.Gram.of(np.repeat(x, w, 0), np.repeat(y, w))
        assert found[b].n == again.n and found[b].cross == pytest.approx(again.cross, abs=1e-8)
    w = consensus.md5_resample(ready, 2)
    bags = stats.grams(ready, weights=w)
    counts = np.zeros(120, int)
    for r in w.where("b = 1").collect():
        counts[r["row_id"]] = r["w"]
    assert bags[1].cross == pytest.approx(K.Gram.of(np.repeat(x, counts, 0), np.repeat(y, counts)).cross, abs=1e-8)
    assert {(r["f_i"], r["f_j"]): r["abs_corr"] for r in stats.correlation_pairs(ready).collect()} == pytest.approx({(i, j): want.correlations()[i, j] for i in range(5) for j in range(i + 1, 5)})
    weights = stats.poisson_weights(np.arange(200_000), 0, 1)
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.03)


def test_partial_correlation():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] + x[:, 1]
    y = x[:, 0] + x[:, 2] + rng.normal(size=200)
    g = K.Gram.of(x, y)

    def residual(v, z):
        a = np.column_stack((np.ones(len(v)), z))
        return v - a @ np.linalg.lstsq(a, v, rcond=None)[0]

    for i, given in ((2, [0, 1]), (0, [1, 2]), (0, [2])):
        want = np.corrcoef(residual(x[:, i], x[:, given]), residual(y, x[:, given]))[0, 1]
        assert K.partial_correlation(g, i, given) == pytest.approx(want, abs=1e-10)
    assert K.partial_correlation(g, 3, [0, 1]) == 0  # collinear
    assert K.fisher_z(0.5, 5, 2) == 1.0 and K.fisher_z(0.9, 1000, 0) == 0.0
    assert 0 in K.markov_blanket(g) and 2 in K.markov_blanket(g)


def test_saturated_ties_go_to_the_lowest():
    rng = np.random.default_rng(2)
    y = rng.normal(size=5000)
    x = np.column_stack((y + rng.normal(size=5000), y + rng.normal(size=5000) * 0.1))
    assert K.fisher_z(K.partial_correlation(K.Gram.of(x, y), 0), 5000, 0) == 0.0
    assert K.markov_blanket(K.Gram.of(x, y), most_given=0)[0] == 0


def test_information():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 150)
    x = rng.normal(size=150) + 2 * y
    x[:20] = np.round(x[:20])

    def brute(x, y, k=3):
        psi = lambda n: sum(1 / i for i in range(1, n))
        m, ks, nc = [], [], []
        for i in range(len(x)):
            same = sorted(abs(x[i] - x[j]) for j in range(len(x)) if j != i and y[j] == y[i])
            r = same[min(k, len(same)) - 1]
            m.append(sum(abs(x[i] - v) < r or v == x[i] for v in x))
            ks.append(min(k, len(same)))
            nc.append(len(same) + 1)
        return max(0, psi(len(x)) + np.mean([psi(v) for v in ks]) - np.mean([psi(v) for v in nc]) - np.mean([psi(v) for v in m]))

    assert causal.neighbour_information(x, y) == pytest.approx(brute(x, y))
    assert causal.neighbour_information(np.ones(5), np.arange(5)) == 0


def test_information_of_many_rows(spark, table):
    want = {r["f"]: r["score"] for r in causal.mutual_information(table).collect()}
    assert {r["f"]: r["score"] for r in causal.mutual_information(table, direct=0).collect()} == pytest.approx(want)
    t = spark.createDataFrame([(i, i % 3, float(i * 7 % 10)) for i in range(50)], "i int, g int, x double")
    got = {r["i"]: r["at"] for r in running_count(t, ["g"], ["x", "i"], "at").collect()}
    rows = sorted((i % 3, float(i * 7 % 10), i) for i in range(50))
    assert got == {i: sum(a == g and (b, j) < (x, i) for a, b, j in rows) for g, x, i in rows}


def test_scores(spark):
    s = spark.createDataFrame([(0, 10.0), (1, 30.0), (2, 20.0)], "f int, score double")
    assert [r["score"] for r in causal.rank_normalise(s).orderBy("f").collect()] == [0, 1, 0.5]
    assert K.rank_normalise(np.array([10, 30, 20])).tolist() == [0, 1, 0.5] and K.rank_normalise(np.array([3.0])).tolist() == [0]
    assert K.hybrid_distance(np.eye(3), np.array([0, 0.5, 1]), 0.0)[0].tolist() == [0, 0.5, 1]
    top = prepare.restrict_candidates(s.where("f = 2").select("f"), s, 2)
    assert sorted(r["f"] for r in top.collect()) == [0, 1, 2]
    assert [r["chosen"] for r in prepare.support_mask(3, s.where("f = 1").select("f")).orderBy("f").collect()] == [False, True, False]


def test_linkage_and_cut():
    d = np.array([[0, 1, 5, 6], [1, 0, 5.5, 6], [5, 5.5, 0, 2], [6, 6, 2, 0.0]])
    m = K.average_linkage(d)
    assert [(x.left, x.right, x.distance) for x in m] == [((0,), (1,), 1.0), ((2,), (3,), 2.0), ((0, 1), (2, 3), 5.625)]
    assert K.cut(m, 4, 2).tolist() == [0, 0, 1, 1] and K.cut(m, 4, 9).tolist() == [0, 1, 2, 3] and K.cut([], 1, 1).tolist() == [0]
    assert K.representatives([0, 0, 1, 1], np.array([1, 1, 0, 2])) == [0, 3]


def test_greedy():
    corr = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    rel = np.array([1, 0.9, 0.5])
    assert K.greedy(rel, corr, 2) == [0, 2] and K.greedy(rel, corr, 9, 0.0) == [0, 1, 2] and K.greedy(rel[:0], corr[:0, :0], 2) == []
    assert K.greedy(rel, corr, 2, 0.5, gamma=0.3, labels=[0, 0, 1]) == [0, 2]


def test_review(spark):
    merges = [K.Merge(0, (0,), (1,), 0.1), K.Merge(1, (2,), (3,), 0.5), K.Merge(2, (0, 1), (2, 3), 1.0)]
    rel, mb = np.array([0.9, 0.1, 0.5, 0.5]), np.array([1, 0, 0, 0])
    reviews = K.ambiguous(merges, rel, mb)
    assert [(r.step, r.conflicting) for r in reviews] == [(0, True), (2, True)] and reviews[-1].distance_gap == 0
    s = K.judge(reviews)
    assert s.share == 1.0 and K.judge([]).share == 0.0 and K.judge(reviews, lambda r: r.step == 0).vetoed.tolist() == [False, True]
    d = K.apply_vetoes(1 - np.eye(4), s.pairs[:1])
    assert d[0, 1] == d[1, 0] == 11 and d[0, 2] == 1
    scores = spark.createDataFrame([(i, float(r), float(m)) for i, (r, m) in enumerate(zip(rel, mb, strict=True))], "f int, relevance double, mb double")
    found = structure.ambiguous_merges(structure.merge_table(spark, merges), scores).orderBy("step").collect()
    assert [r["step"] for r in found] == [r.step for r in reviews]
    assert [r["distance_gap"] for r in found] == pytest.approx([r.distance_gap for r in reviews])
    assert [r["causal_gap"] for r in found] == pytest.approx([r.causal_gap for r in reviews])


def test_agreement(spark):
    assert K.jaccard([1, 2, 3], [2, 3, 4]) == 0.5 and K.jaccard([], []) == 1
    assert K.stability_index([]) == 0 and K.stability_index([[1]]) == 1
    runs = [[1, 2], [1, 3], [2, 1]]
    assert K.vote(runs, 0.5, 2) == [1, 2] and K.vote(runs, 0.9) == [1] and K.vote(runs, 0.9, 3) == [1, 2, 3]
    assert K.kuncheva([1, 2], [1, 3], 10) == pytest.approx(0.375) and K.kuncheva([], [1], 4) == 1
    assert K.cluster_vote([[0, 1], [2, 9]], {0: 0, 1: 0, 2: 0}, {0: 1}, 0.5, 2) == [1, 9]
    assert K.cluster_vote([[0], [1, 3], [4]], {0: 0, 1: 0, 3: 1}, {0: 1}, 0.5) == [1] and K.cluster_vote([], {}, {}, 0.5) == []
    t = consensus.selections_table(spark, runs)
    assert consensus.stability(t).first()[0] == pytest.approx(K.stability_index(runs))
    assert sorted(r["f"] for r in consensus.consensus(t, 0.5, 2).collect()) == [1, 2]
    assert consensus.stability(t.where("false")).first()[0] == 0 and consensus.stability(t.limit(1)).first()[0] == 1
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "f int")
    assert tuple(consensus.plausibility(f(0, 1, 9), f(0, 1, 2, 3, 4)).first()) == pytest.approx((2 / 3, 0.4))
    assert tuple(consensus.plausibility(f(1), f(1).where("false")).first()) == (None, None)
    labels = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)], "b int, f int, cluster int")
    assert [tuple(r) for r in consensus.co_association(labels, 2).collect()] == [(0, 1, 0.5)]



def test_wilcoxon_of_equal_differences():
    """Exact where differences are equal, also if these round otherwise in binary."""
    assert K.wilcoxon([0.001, 0.0, 0.0, 0.012, 0.501333333333 + 0.001], [0, 0.006, 0.003333333333, 0, 0.501333333333]) == 1
    assert K.wilcoxon([1, 1, 3, 4, 5], [0, 2, 0, 0, 0]) == pytest.approx(2 * 2 / 32)
    assert K.wilcoxon([1, 2, 3, 4, 5], [1, 1, 1, 1, 1]) == pytest.approx(2 / 16)


def test_friedman_and_wilcoxon(spark):
    x = np.array([[0.9, 0.8, 0.8, 0.7], [0.6, 0.7, 0.5, 0.4], [0.9, 0.9, 0.9, 0.1], [0.5, 0.4, 0.3, 0.2]])
    stat, p = K.friedman(x)
    rows = [(f"d{i}", f"m{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    got = report.friedman(spark.createDataFrame(rows, "dataset string, method string, accuracy double"), "accuracy").first()
    assert got["statistic"] == pytest.approx(stat) and got["dof"] == 3 and 0 < p < 1
    assert K.friedman(np.array([[1, 2, 3.0]] * 5))[0] == pytest.approx(10.0)
    assert K.wilcoxon([1, 2, 3, 4, 5], [0.5, 1, 1.2, 1.1, 0]) == pytest.approx(0.0625) and K.wilcoxon([1], [1]) == 1
    assert K.chi2_tail(16.119, 7) == pytest.approx(0.02405, abs=1e-4) and K.chi2_tail(4, 2) == pytest.approx(math.exp(-2))


def brute_near(x, k, fold=None):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    if fold is not None:
        d[fold[:, None] == fold[None]] = np.inf
    return np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]


def test_neighbours(table, monkeypatch):
    z = prepare.Standardiser().fit_transform(table)
    x, y = matrix(z)
    for size in (2048, 17):
        monkeypatch.setattr(evaluate, "BLOCK", size)
        pred = {r["row_id"]: r for r in evaluate.fold_predictions(z).collect()}
        fold = np.array([pred[i]["fold"] for i in range(120)])
        near = brute_near(x, 5, fold)
        want = [min(range(3), key=lambda c: (-(y[near[i]] == c).sum(), c)) for i in range(120)]
        assert [pred[i]["predicted"] for i in range(120)] == want
        few = brute_near(x[:, [0, 2]], 5)
        rank = np.argsort(brute_near(x, 119), 1)
        full = brute_near(x, 119)
        penalty = sum(max(0, int(np.flatnonzero(full[i] == j)[0]) + 1 - 5) for i in range(120) for j in few[i])
        assert evaluate.trustworthiness(z, [0, 2]).first()[0] == pytest.approx(1 - 2 * penalty / (120 * 5 * (240 - 16)))
        assert rank.shape == (120, 119)
    acc = np.mean([np.mean([want[i] == y[i] for i in np.flatnonzero(fold == f)]) for f in np.unique(fold)])
    assert evaluate.knn_accuracy(z) == pytest.approx(acc)


def test_choice_of_k(spark):
    per = spark.createDataFrame([(1, 0.7, 0.01, 0.9, 0.0), (2, 0.9, 0.05, 0.8, 0.3), (3, 0.88, 0.02, 0.7, 0.2), (4, 0.89, 0.02, 0.1, 0.1)], "k int, mean_perf double, se_perf double, stability double, redundancy double")
    assert evaluate.choose_k(per).where("chosen").first()["k"] == 3
    assert evaluate.choose_k(per.withColumn("stability", F.lit(0.1))).where("chosen").first()["k"] == 2
    assert evaluate.k_grid(30, 1000)[-2:] == [20, 25]
    assert evaluate.k_grid(4, 1000) == [1, 2, 3] and evaluate.search_grid(2, 60)[-1] == 60
    curve = spark.createDataFrame([(2, 0.9), (3, 0.904), (4, 0.93)], "k int, accuracy double")
    assert evaluate.smallest_within(curve, 0.03).first()[0] == 2


def test_selection_of_structural_table(spark):
    frame = make_structural(spark)
    m = Selector(strict(6, frame.p)).fit(frame)
    assert set(range(5)) <= set(m.selected_features_) and len(m.relevance_) == frame.p and 0 <= m.stability_ <= 1
    assert m.transform(frame).features == tuple(frame.features[i] for i in m.selected_features_)
    assert sum(m.get_support()) == len(m.selected_features_) and len(m.trace) >= 5


@pytest.mark.parametrize("more", [{}, {"prototype_by": "greedy"}, {"prototype_by": "predictive"}, {"cluster_consensus": True}, {"consensus_clustering": True}, {"enable_hitl": True}, {"enable_stability": False}, {"n_bootstrap": 0}, {"improved_greedy": True, "prototype_by": "greedy", "group_diversity": 0.3, "mb_bootstrap": 3}, {"wrapper_refine": True, "n_bootstrap": 2}, {"prefilter_top": 3}, {"restrict_to_mb": True}])
def test_modes(table, more):
    m = Selector(Config(**{"n_representatives": 2, "n_bootstrap": 4, "conditional_relevance": True, **more})).fit(table)
    assert 1 <= len(m.selected_features_) <= 2 and 0 <= m.stability_ <= 1 and all(0 <= f < 5 for f in m.selected_features_)
    if more.get("n_bootstrap") == 0:
        assert m.stability_ == 0.0
    if "enable_stability" in more:
        assert m.stability_ == 1.0


def test_rows_scores_on_resamples(table):
    w = consensus.md5_resample(table, 2).cache()
    a = Selector(Config(n_representatives=2, n_bootstrap=2), refit_rows=True).fit(table, w)
    assert len(a.selections_) == 2 and len(a.selected_features_) == 2


def test_config():
    assert Config(beta=(1, 1, 2)).parts == (0.25, 0.25, 0.5) and Config().size(3) == 2 and Config(n_representatives=9).size(4) == 4
    for bad in ({"beta": (1, 1)}, {"beta": (0, 0, 0)}, {"lam": 2}, {"alpha": -1}, {"consensus_threshold": 1.5}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert soft(10, 700).prefilter_top == 80 and soft(10, 300).n_bootstrap == 3 and strict(5, 20).lam == 0.7


def test_callbacks(table):
    seen = []

    def step(entry):
        seen.append(entry["stage"])
        raise RuntimeError("ignored")

    m = Selector(Config(n_representatives=2, n_bootstrap=0, conditional_relevance=True), review=lambda r: False, step=step).fit(table)
    assert m.veto_rate_ == 1.0 and len(seen) == len(m.trace)


@pytest.mark.parametrize("name", list(baselines.BASELINES))
def test_baselines(table, name):
    m = baselines.build_baseline(name, 2).fit(prepare.impute(table))
    assert len(m.selected_features_) == 2 and m.transform(prepare.impute(table)).wide().count() == 120
    with pytest.raises(KeyError):
        baselines.build_baseline("none", 2)


def test_drivers(spark, table):
    frame = prepare.impute(table)
    row = X.evaluate_method("PCA", lambda s: baselines.build_baseline("PCA", 2, s), FeatureFrame(frame.df, frame.features, truth=(0,)), 2, 2)
    assert 0 <= row["accuracy"] <= 1 and 0 <= row["stability"] <= 1 and row["causal_recall"] in (0, 1)
    assert X.sensitivity([FeatureFrame(frame.df, frame.features, name="t")], 2, (0.5,), 2).count() == 1
    assert make_madelon_like(spark).p == 50 and make_synthetic(spark).wide().count() == 300
    got = make_synthetic(spark, 4000).wide().groupBy("y").agg(F.avg("x19"), F.stddev("x19")).collect()
    assert all(abs(r[1]) < 0.1 and abs(r[2] - 1) < 0.1 for r in got)


def test_reports(spark, tmp_path):
    rows = [(d, m, s, 5, a, 0.5, 0.9, t, None, None) for s in (0, 1) for d, m, a, t in (("x", "Proposed", 0.9, 2.0), ("x", "PCA", 0.8, 1.0), ("y", "Proposed", 0.7, 3.0), ("y", "PCA", 0.7, 1.0))]
    t = spark.createDataFrame(rows, R.RESULT_SCHEMA)
    assert {r["method"]: (r["accuracy"], r["runtime_s"]) for r in report.average_ranks(t, ["accuracy", "runtime_s"]).collect()} == {"Proposed": (1.25, 2.0), "PCA": (1.75, 1.0)}
    assert {r["method"] for r in report.pareto(report.means(t, ["accuracy", "runtime_s"]), "accuracy", "runtime_s").collect()} == {"Proposed", "PCA"}
    assert report.best_method(report.means(t, ["stability"]), ["stability"]).first()["method"] == "Proposed"
    R.write_results(t, str(tmp_path / "r"))
    assert R.read_results(spark, str(tmp_path / "r")).count() == 8
    tex = R.latex_table([{"method": "a_b", "accuracy": 0.5}, {"method": "c", "accuracy": 0.25}], [{"method": "c", "accuracy": 0.1}])
    assert r"a\_b & \textbf{0.500} \\" in tex and r"c & 0.250 $\pm$ 0.100 \\" in tex
    assert "| method |" in R.markdown_table([{"method": "a"}]) and '"lam": 0.5' in R.manifest(Config())
    assert "Friedman" in X.significance(t)


def test_entry_without_the_subpackage():
    import __spark_entry__ as e

    assert len(e.queries()) >= 100 and set(e.oracle_sql()) <= set(e.queries())
