"""Resamples with exact numbers of draws, tiles, runs that are taken up again, and the files of the drivers."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import sieveline
from sieveline.frame import FeatureFrame
from sieveline.operators import prepare, resample, stats
from sieveline.plans import Config, Selector, experiments as X, runs
from sieveline.sources.synthetic import make_structural, make_synthetic
from sieveline.sources.tables import CATALOGUE, Catalogue, Entry


@pytest.fixture(scope="module")
def frame(spark):
    return make_synthetic(spark, 300, 6, 3).stored()


def test_draws_are_exact(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 16)
    for n in (1, 15, 16, 17, 1000):
        draws, blocks = resample.Draws(n, 5), -(-n // 16)
        for b in range(3):
            counts = np.concatenate([draws.of_block(b, k) for k in range(blocks)])
            assert len(counts) == n and counts.sum() == n
            order = np.random.default_rng(b).permutation(n)
            assert np.array_equal(resample.Draws(n, 5).of_rows(b, order), counts[order])
    draws = resample.Draws(400, 1)
    many = np.array([draws.of_rows(b, np.arange(400)) for b in range(400)])
    assert abs((many == 0).mean() - (1 - 1 / 400) ** 400) < 0.01 and abs(many.var() - (1 - 1 / 400)) < 0.02
    assert abs(many.mean(0) - 1).max() < 0.25 and abs(np.corrcoef(many[:, 0], many[:, 399])[0, 1]) < 0.2


def test_exact_resample(spark, frame):
    first = {(r.b, r.row_id): r.w for r in resample.exact_resample(frame, 3).collect()}
    assert [sum(w for (k, _), w in first.items() if k == b) for b in range(3)] == [300] * 3
    found = stats.grams(frame, 3, exact=True)
    assert [found[b].n for b in (-1, 0, 1, 2)] == [300.0] * 4
    ids = np.array([r.row_id for r in frame.stored().df.select("row_id").collect()])
    assert set(ids.tolist()) >= {i for _, i in first}
    model = Selector(Config(n_representatives=2, n_bootstrap=4, conditional_relevance=True), exact=True).fit(frame)
    assert len(model.selections_) == 4


def test_tiles(frame):
    tiles = prepare.transpose_blocks(frame, 128).collect()
    assert {(t.f, t.block) for t in tiles} == {(f, b) for f in range(6) for b in range(3)} and max(len(t.xs) for t in tiles) == 128
    whole = {r.f: r.xs for r in prepare.transpose(frame).collect()}
    for f, xs in whole.items():
        assert [x for t in sorted((t for t in tiles if t.f == f), key=lambda t: t.block) for x in t.xs] == xs


def broken(spark, root):
    raise FileNotFoundError("no network")


def test_runs_go_on_where_they_stopped(spark, frame, tmp_path, monkeypatch):
    tables = Catalogue([Entry("one", lambda s, d: frame, 2), Entry("gone", broken, 2), Entry("two", lambda s, d: make_structural(s, 200), 2)])
    path, real, seen = str(tmp_path / "runs"), runs.evaluate_method, []

    def stops(name, *a):
        if len(seen) == 1:
            raise KeyboardInterrupt
        seen.append(name)
        return real(name, *a)

    ask = {"k": 2, "methods": ("PCA", "Random"), "resamples": 2, "catalogue": tables}
    monkeypatch.setattr(runs, "evaluate_method", stops)
    with pytest.raises(KeyboardInterrupt):
        runs.run_experiments(spark, ["one", "gone", "two"], "", path, **ask)
    monkeypatch.setattr(runs, "evaluate_method", real)
    before = {tuple(r) for r in runs.finished(spark, path).collect()}
    assert {r[:3] for r in before} == {("one", "PCA", 0)}
    said = []
    out = runs.run_experiments(spark, ["one", "gone", "two"], "", path, progress=lambda share, text: said.append(share), **ask)
    assert out.ran == [("one", "Random", 0), ("two", "PCA", 0), ("two", "Random", 0)] and out.loaded == ["one", "two"]
    assert [n for n, _ in out.skipped] == ["gone"] and "no network" in out.skipped[0][1] and said[-1] == 1.0 and said == sorted(said)
    rows = {tuple(r) for r in out.results.collect()}
    assert before <= rows and len(rows) == 4 and out.results.columns[:4] == ["dataset", "method", "seed", "k"]
    more = runs.run_experiments(spark, ["one"], "", path, **(ask | {"seeds": (0, 1), "methods": ("PCA",)}), progress=lambda *a: 1 / 0)
    assert more.ran == [("one", "PCA", 1)] and more.results.count() == 5
    again = next(r for r in rows if r[1] == "Random")
    runs.write_once(dict(zip(out.results.columns, again, strict=True)), spark, path)
    assert runs.finished(spark, path).count() == 5
    assert runs.missing(spark, path, ["one", "new"], ["PCA"], [0]) == [("new", "PCA", 0)]


def test_methods_of_a_run():
    assert runs.builder("Proposed", 3, 300, 4, True, True)(7).config == X.strict(3, 300, 4, 7, True)
    assert runs.builder("Proposed", 3, 10, 4)(7).config == X.soft(3, 10, 4, 7)
    assert runs.builder("PCA", 3, 10, 4)(7).k == 3


def test_report_goes_on(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setitem(CATALOGUE.entries, "tiny", Entry("tiny", lambda s, d: frame, 2))
    monkeypatch.setattr(runs, "select_k_nested", lambda f, repeats: (2, None))
    out = str(tmp_path / "report")
    first = X.full_report(spark, ["tiny"], "", out, 2, methods=("Random",)).collect()
    monkeypatch.setattr(runs, "evaluate_method", lambda *a: 1 / 0)
    assert X.full_report(spark, ["tiny"], "", out, 2, methods=("Random",)).collect() == first
    assert [(r.dataset, r.method, r.k) for r in first] == [("tiny", "Random", 2)]


def test_files_of_the_drivers(spark, frame, tmp_path):
    named = FeatureFrame(frame.df, frame.features, name="t")
    X.write_ablation([named], 2, str(tmp_path), 2)
    variants = spark.read.csv(str(tmp_path / "ablation"), header=True)
    assert [r.dataset for r in variants.collect()][0] == "t" and "w/o Causality" in variants.columns
    curve = spark.read.csv(str(tmp_path / "sensitivity"), header=True, inferSchema=True).collect()
    assert [r.alpha for r in curve] == [0.0, 0.25, 0.5, 0.75, 1.0] and all(round(r.accuracy, 3) == r.accuracy for r in curve)
    means = spark.createDataFrame([("A", 0.91234, 0.5, 1.0, 0.2), ("B", 0.5, 0.25, None, None)], "method string, accuracy double, stability double, causal_plausibility double, causal_recall double")
    text = X.write_plausibility(means, str(tmp_path), "Five drivers.")
    assert "| A | 0.912 | 0.500 | 1.000 | 0.200 |" in text and "Five drivers." in text
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "causal_plausibility_page")).collect()) == text
    assert spark.read.csv(str(tmp_path / "causal_plausibility"), header=True).count() == 2


def test_simulation_refits(frame):
    config = Config(n_representatives=2, n_bootstrap=3, conditional_relevance=True)
    shown = X.simulate(frame, config, 5)
    assert np.isclose(shown["frequency"].sum(), 2) and set(np.round(shown["frequency"] * 5, 9)) <= set(range(6))
    assert len(shown["model"].selections_) == 3 and len(shown["trace"]) >= 5 and shown["correlations"].shape == (6, 6)


def test_tables_below_a_root(spark, tmp_path):
    """Catalogue entries that need a file find one, as parquet or as CSV."""
    spark.createDataFrame([(0.5, 1, "a"), (1.5, 2, "b"), (2.5, 3, "a")], "x double, z int, cls string").write.parquet(str(tmp_path / "wine.parquet"))
    (tmp_path / "zoo.csv").write_text("legs,eggs,kind\n4,0,x\n?,1,y\n2,1,x\n")
    wine = CATALOGUE.load(spark, "wine", str(tmp_path))
    assert wine.features == ("x", "z") and sorted(r.y for r in wine.wide().collect()) == [0, 0, 1]
    zoo = CATALOGUE.load(spark, "zoo", str(tmp_path))
    assert zoo.features == ("legs", "eggs") and [r.legs for r in zoo.wide().orderBy("row_id").collect()] == [4.0, 3.0, 2.0]  # the gap takes the median
    with pytest.raises(RuntimeError):
        CATALOGUE.load(spark, "iris", str(tmp_path))


def test_exports():
    assert sieveline.Selector is Selector and sieveline.Config is Config and sieveline.FeatureFrame is FeatureFrame
    assert re.fullmatch(r"\d+\.\d+\.\d+", sieveline.__version__) and set(sieveline.__all__) > {"Selector", "Config"}
    with pytest.raises(AttributeError):
        sieveline.nothing  # noqa: B018


def test_keys_number_generated_rows(spark):
    ids = spark.createDataFrame([(5,), (900,), (7,)], "key long")
    made = make_synthetic(spark, ids=ids).wide()
    assert {r.row_id for r in made.collect()} == {5, 7, 900}
    whole = make_synthetic(spark, 901).wide().where(F.col("row_id").isin(5, 7, 900))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect()))
    assert make_structural(spark, ids=ids).wide().count() == 3


def test_codes_of_many_values(spark):
    """Ranges of values get the codes that one task gives."""
    rows = [(i, None if i % 13 == 0 else f"v{i * 37 % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v string").repartition(3)
    for code in (lambda most: prepare.codes_by_first_appearance(df, "v", "id", "c", most), lambda most: prepare.label_codes(df.where("v is not null"), "v", "c", most)):
        assert sorted(map(tuple, code(5).select("id", "c").collect())) == sorted(map(tuple, code(1000).select("id", "c").collect()))
    first = {}
    for i, v in rows:
        if v is not None:
            first.setdefault(v, len(first))
    assert {r.id: r.c for r in prepare.codes_by_first_appearance(df, "v", "id", "c", 5).collect()} == {i: -1 if v is None else first[v] for i, v in rows}
