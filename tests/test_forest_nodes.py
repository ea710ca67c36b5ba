"""Forests keep the rows' nodes, and give what they give without."""

from pyspark.sql import functions as F

from sieveline.frame import FeatureFrame
from sieveline.operators import causal


def test_nodes_are_kept_and_importances_are_the_same(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 2).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"), (F.col("id") % 17 * 2.0 + F.col("id") % 5).alias("y"))
    frame, kind, kept = FeatureFrame(rows, ("a", "b"), discrete=False), causal.RandomForestRegressor, []
    got = causal.forest_relevance(frame, trees=5, depth=4)
    monkeypatch.setattr(causal, "RandomForestRegressor", lambda **k: kept.append(k.pop("cacheNodeIds", False)) or kind(**k))
    assert causal.forest_relevance(frame, trees=5, depth=4).tolist() == got.tolist()
    assert kept == [True]
