"""Resamples, votes, agreement and co-association of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sieveline.frame import FeatureFrame

from .ranking import running_count


def md5_resample(frame: FeatureFrame, resamples: int) -> DataFrame:
    """(b, row_id, w): multiplicities of rows drawn with replacement; slot s of resample b draws the row whose rank by row_id is
    a hash of (b, s) modulo the number of rows. It shuffles a row for each slot; stats.poisson_weights shuffles none.
    """
    rows = running_count(frame.wide().select("row_id"), [], ["row_id"], "at")
    n = rows.count()
    spark = frame.df.sparkSession
    slots = spark.range(n).select(F.col("id").alias("slot")).crossJoin(spark.range(resamples).select(F.col("id").cast("int").alias("b")))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", "b", "slot")), 1, 8), 16, 10).cast("long")
    drawn = slots.select("b", F.pmod(h, F.lit(max(1, n))).alias("at")).groupBy("b", "at").agg(F.count(F.lit(1)).cast("int").alias("w"))
    return drawn.join(rows, "at").select("b", "row_id", "w")


def resampled(frame: FeatureFrame, weights: DataFrame, b: int) -> FeatureFrame:
    """Resample b as a table with a weight column `w`."""
    return frame.with_df(frame.df.join(weights.where(F.col("b") == b).select(F.col("row_id").alias(frame.row_id), "w"), frame.row_id))


def bootstrap_runs(frame: FeatureFrame, weights: DataFrame, resamples: int, select) -> list[list[int]]:
    """select(table with weights) for each resample."""
    return [sorted(select(resampled(frame, weights, b))) for b in range(resamples)]


def selections_table(spark: SparkSession, selections: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(b, list(s)) for b, s in enumerate(selections)], "b int, selected array<int>")


def jaccard_pairs(selections: DataFrame) -> DataFrame:
    """(b1, b2, jaccard) of every two selections; two empty ones agree."""
    other = selections.select(F.col("b").alias("b2"), F.col("selected").alias("s2"))
    both = selections.select(F.col("b").alias("b1"), "selected").join(other, F.col("b1") < F.col("b2"))
    all_ = F.size(F.array_union("selected", "s2"))
    return both.select("b1", "b2", F.when(all_ > 0, F.size(F.array_intersect("selected", "s2")) / all_).otherwise(1.0).alias("jaccard"))


def stability(selections: DataFrame) -> DataFrame:
    """(stability): mean agreement of pairs; 1 for one selection, 0 for none."""
    n = selections.agg(F.count(F.lit(1)).alias("n"))
    return jaccard_pairs(selections).agg(F.avg("jaccard").alias("mean")).crossJoin(n).select(F.coalesce("mean", F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("stability"))


def votes(selections: DataFrame) -> DataFrame:
    """(f, votes, share, rank): how many selections have f; ranked by votes, then f."""
    n = selections.agg(F.count(F.lit(1)).alias("n"))
    counts = selections.select("b", F.explode(F.array_distinct("selected")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.orderBy(F.desc("votes"), "f"))
    return counts.crossJoin(n).select("f", "votes", (F.col("votes") / F.col("n")).alias("share"), rank.alias("rank"))


def consensus(selections: DataFrame, tau: float, k: int | None = None) -> DataFrame:
    """(f): voted by at least tau of the selections; with k, the k of the most votes (which the former are the first of)."""
    v = votes(selections)
    return v.where(F.col("rank") <= k if k is not None else F.col("share") >= tau).select("f")


def cluster_consensus(selections: DataFrame, clusters: DataFrame, canonical: DataFrame, tau: float, k: int) -> DataFrame:
    """(f): vote on the clusters (f, cluster) of selected features, then take each one's canonical feature (cluster, f)."""
    named = selections.select("b", F.explode("selected").alias("f")).join(clusters, "f", "left")
    groups = named.groupBy("b").agg(F.collect_set(F.coalesce("cluster", -(F.col("f") + 1))).alias("selected"))
    top = consensus(groups, tau, k).select(F.col("f").alias("cluster"))
    rep = canonical.select("cluster", F.col("f").alias("rep"))
    return top.join(rep, "cluster", "left").select(F.coalesce("rep", -F.col("cluster") - 1).alias("f")).distinct()


def co_association(labels: DataFrame, resamples: int) -> DataFrame:
    """(f_i, f_j, together): share of the resamples whose labels (b, f, cluster) put both in one cluster."""
    other = labels.select("b", "cluster", F.col("f").alias("f_j"))
    pairs = labels.select("b", "cluster", F.col("f").alias("f_i")).join(other, ["b", "cluster"]).where("f_i < f_j")
    return pairs.groupBy("f_i", "f_j").agg((F.count(F.lit(1)) / resamples).alias("together"))


def kuncheva_pairs(selections: DataFrame, p: int) -> DataFrame:
    """(b1, b2, kuncheva) of every two selections among p features."""
    other = selections.select(F.col("b").alias("b2"), F.col("selected").alias("s2"))
    both = selections.select(F.col("b").alias("b1"), "selected").join(other, F.col("b1") < F.col("b2"))
    k = F.size("selected").cast("double")
    chance = k * k / p
    fine = (k > 0) & (k < p) & (F.abs(k - chance) >= 1e-12)
    return both.select("b1", "b2", F.when(fine, (F.size(F.array_intersect("selected", "s2")) - chance) / (k - chance)).otherwise(1.0).alias("kuncheva"))


def plausibility(selected: DataFrame, truth: DataFrame) -> DataFrame:
    """(plausibility, recall): share of the selected features (f) that are true, and of the true ones that are selected; NULL
    without truth, 0 for an empty selection."""
    hit = selected.join(truth, "f", "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    n = selected.agg(F.count(F.lit(1)).alias("n"))
    t = truth.agg(F.count(F.lit(1)).alias("t"))
    return hit.crossJoin(n).crossJoin(t).select(F.when(F.col("t") > 0, F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0)).alias("plausibility"), F.when(F.col("t") > 0, F.col("hit") / F.col("t")).alias("recall"))
