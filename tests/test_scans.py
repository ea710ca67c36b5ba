"""How often tables are read: stored before several passes, shared by fits, and dealt to all cores."""

from pyspark.sql import functions as F

from sieveline.frame import FeatureFrame
from sieveline.plans import Config, Selector, experiments, selector
from sieveline.plans.queries import QUERIES
from sieveline.sources import synthetic

SF = "/root/testdata/sf0.001"


def reads(df, table):
    return any(f.endswith(f"/{table}.parquet") for f in df.inputFiles())


def test_samples_read_a_stored_table(spark):
    assert not reads(QUERIES["common_schema"](spark, SF), "lineitem")


def test_projections_read_a_stored_table(spark):
    for name in ("project_selected", "standardise_apply"):
        assert not reads(QUERIES[name](spark, SF), "lineitem")


def test_generated_rows_are_dealt_to_all_cores(spark):
    keys = spark.createDataFrame([(i,) for i in range(50)], "k long").coalesce(1)
    frame = synthetic.make_madelon_like(spark, ids=keys)
    assert frame.df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.row_id for r in frame.df.select("row_id").collect()} == set(range(50))


def test_fits_share_scans(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), *[((F.col("id") * k) % 17 + (F.col("id") % 2) * k).cast("double").alias(f"x{k}") for k in (1, 3, 5, 7)])
    frame = FeatureFrame(df, ("x1", "x3", "x5", "x7"), name="small")
    configs = [Config(n_representatives=2, n_bootstrap=3, alpha=a, conditional_relevance=c) for a in (0.0, 1.0) for c in (False, True)]
    alone = [Selector(c).fit(frame) for c in configs]
    calls = []
    for name in ("grams", "mutual_information"):
        real = getattr(selector, name)
        monkeypatch.setattr(selector, name, lambda *a, name=name, real=real, **k: calls.append(name) or real(*a, **k))
    shared: dict = {}
    together = [Selector(c).fit(frame, shared=shared) for c in configs]
    assert [(m.selected_features_, m.selections_, m.stability_) for m in alone] == [(m.selected_features_, m.selections_, m.stability_) for m in together]
    assert sorted(calls) == ["grams", "mutual_information"]
    calls.clear()
    scored = []
    real = experiments.evaluate.knn_accuracy
    monkeypatch.setattr(experiments.evaluate, "knn_accuracy", lambda f: scored.append(f.features) or real(f))
    assert experiments.sensitivity([frame], 2, n_bootstrap=3).count() == 5
    assert sorted(calls) == ["grams", "mutual_information"] and len(scored) == len(set(scored))


def test_encoder_reads_packed_rows(spark):
    import numpy as np

    from sieveline.operators import encoder

    rows = spark.range(30).select(F.col("id").alias("row_id"), F.array(F.col("id") * 0.5, F.col("id") * -1.0).alias("x"))
    blocks = encoder.packed(rows, 2).collect()
    assert len(blocks) < 30
    ids = np.concatenate([np.frombuffer(bytes(b.ids), np.int64) for b in blocks])
    x = np.concatenate([np.frombuffer(bytes(b.x)).reshape(-1, 2) for b in blocks])
    assert sorted(ids) == list(range(30)) and (x == np.column_stack((ids * 0.5, -ids))).all()


def test_medians_of_many_cells_dont_meet_in_one_task(spark, monkeypatch):
    from sieveline.operators import prepare

    df = spark.range(301).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), (F.col("id") * 8 % 301).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 10).cast("double").alias("b"), F.lit(2.5).alias("c"))
    frame = FeatureFrame(df, ("a", "b", "c"))
    want = prepare.medians(frame)
    assert prepare.medians(frame, few=20, cells=500) == want == [150.0, 4.5, 2.5]
    used = []
    real = prepare.F.median
    monkeypatch.setattr(prepare.F, "median", lambda *a: used.append(a) or real(*a))
    assert prepare.medians(frame, cells=500) == want
    assert not used
