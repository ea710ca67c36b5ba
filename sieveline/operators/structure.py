"""Feature graphs, distances, representatives and merge review as tables of pairs and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sieveline.functions.kernels import Merge


def edges(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(f_i, f_j, weight) of correlations of at least threshold."""
    return pairs.where(F.col("abs_corr") >= threshold).select("f_i", "f_j", F.col("abs_corr").alias("weight"))


def weighted_degree(graph: DataFrame, p: int) -> DataFrame:
    """(f, score) of all p features: the sum of incident weights over the greatest sum; 0 for isolated ones."""
    ends = graph.select(F.col("f_i").alias("f"), "weight").unionByName(graph.select(F.col("f_j").alias("f"), "weight"))
    sums = graph.sparkSession.range(p).select(F.col("id").cast("int").alias("f")).join(ends.groupBy("f").agg(F.sum("weight").alias("s")), "f", "left")
    top = F.max("s").over(Window.partitionBy())
    return sums.select("f", F.coalesce(F.col("s") / F.when(top > 0, top), F.lit(0.0)).alias("score"))


def hybrid_pairs(pairs: DataFrame, relevance: DataFrame, alpha: float = 0.5, causal: bool = True) -> DataFrame:
    """(f_i, f_j, d_stat, d_causal, d_hybrid): 1 - |corr|, the relevance gap over the greatest one, and their mixture."""
    r = lambda f, name: relevance.select(F.col("f").alias(f), F.col("score").alias(name))
    gap = pairs.join(r("f_i", "r_i"), "f_i").join(r("f_j", "r_j"), "f_j").withColumn("gap", F.abs(F.col("r_i") - F.col("r_j")))
    top = F.max("gap").over(Window.partitionBy())
    d = gap.select("f_i", "f_j", (1 - F.col("abs_corr")).alias("d_stat"), F.when(top > 0, F.col("gap") / top).otherwise(F.col("gap")).alias("d_causal"))
    mixed = alpha * F.col("d_stat") + (1 - alpha) * F.col("d_causal") if causal else F.col("d_stat")
    return d.withColumn("d_hybrid", F.greatest(mixed, F.lit(0.0)))


def composite(centrality: DataFrame, relevance: DataFrame, predictive: DataFrame, beta: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    c, r, p = (d.select("f", F.col("score").alias(n)) for d, n in ((centrality, "c"), (relevance, "r"), (predictive, "p")))
    return c.join(r, "f").join(p, "f").select("f", (beta[0] * F.col("c") + beta[1] * F.col("r") + beta[2] * F.col("p")).alias("score"))


def representatives(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster, f): each cluster's feature of the greatest score, the lowest of equal ones."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "f"))
    return clusters.join(scores, "f").withColumn("rank", rank).where("rank = 1").select("cluster", "f")


def merge_table(spark: SparkSession, merges: list[Merge]) -> DataFrame:
    rows = [(m.step, list(m.left), list(m.right), m.distance) for m in merges]
    return spark.createDataFrame(rows, "step int, `left` array<int>, `right` array<int>, distance double")


def ambiguous_merges(merges: DataFrame, scores: DataFrame, tol: float = 0.05) -> DataFrame:
    """Merges (step, left, right, distance) near the next one's distance or of conflicting members; scores has (f, relevance, mb)."""
    by = Window.orderBy("step")
    all_ = Window.partitionBy()
    later = F.coalesce(F.lead("distance").over(by), F.col("distance"))
    span = F.max("distance").over(all_) - F.min("distance").over(all_)
    m = merges.withColumn("next_distance", later).withColumn("distance_gap", F.abs(F.col("distance") - F.col("next_distance")) / F.when(span > 0, span).otherwise(1.0))

    def side(name: str) -> DataFrame:
        members = merges.select("step", F.explode(name).alias("f")).join(scores, "f")
        return members.groupBy("step").agg(F.avg("relevance").alias(f"r_{name}"), F.max((F.col("mb") > 0).cast("int")).alias(f"mb_{name}"))

    both = m.join(side("left"), "step").join(side("right"), "step")
    both = both.withColumn("causal_gap", F.abs(F.col("r_left") - F.col("r_right"))).withColumn("conflicting", F.col("mb_left") != F.col("mb_right"))
    return both.where((F.col("distance_gap") <= tol) | F.col("conflicting")).select("step", "left", "right", "distance", "next_distance", "distance_gap", "causal_gap", "conflicting")


def rule_decisions(reviews: DataFrame, gap_threshold: float = 0.4) -> DataFrame:
    return reviews.withColumn("decision", ~(F.col("conflicting") | (F.col("causal_gap") >= gap_threshold)))


def veto_rate(decided: DataFrame) -> DataFrame:
    return decided.agg(F.coalesce(F.avg((~F.col("decision")).cast("double")), F.lit(0.0)).alias("veto_rate"))


def vetoed_pairs(decided: DataFrame) -> DataFrame:
    """(f_i, f_j), smaller first, of every pair across the two sides of a vetoed merge."""
    cells = decided.where(~F.col("decision")).select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b"))
    return cells.select(F.least("a", "b").alias("f_i"), F.greatest("a", "b").alias("f_j")).distinct()


def with_vetoes(distances: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distances (f_i, f_j, d) with vetoed pairs at 10 times the greatest, plus 1."""
    far = 10 * F.max("d").over(Window.partitionBy()) + 1
    marked = pairs.select("f_i", "f_j", F.lit(True).alias("vetoed"))
    return distances.withColumn("far", far).join(marked, ["f_i", "f_j"], "left").select("f_i", "f_j", F.when(F.col("vetoed"), F.col("far")).otherwise(F.col("d")).alias("d"))
