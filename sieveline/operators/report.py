"""Aggregations of result tables (dataset, method, seed, k and metrics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

METHODS = ("Proposed", "PCA", "VAE", "LASSO", "mRMR", "CausalDRIFT", "CAFE", "Random")
LOWER_BETTER = ("runtime_s",)


def method_order(spark: SparkSession, methods: Sequence[str] = METHODS) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(methods)], "method string, position int")


def nulls(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.withColumns({m: F.nanvl(m, F.lit(None).cast("double")) for m in metrics})


def means(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("method",)) -> DataFrame:
    """Means to 12 places, so that the order of adding doesn't part equal ones."""
    return nulls(df, metrics).groupBy(*keys).agg(*[F.round(F.avg(m), 12).alias(m) for m in metrics])


def deviations(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("method",)) -> DataFrame:
    return nulls(df, metrics).groupBy(*keys).agg(*[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(m) for m in metrics])


def mean_std_text(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per method, "mean" or "mean ± std" to three places; the deviation only if it is above 0."""
    agg = nulls(df, metrics).groupBy("method").agg(*[x for m in metrics for x in (F.avg(m).alias(f"m_{m}"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"s_{m}"))])
    show = lambda m: F.when(F.col(f"s_{m}") > 0, F.format_string("%.3f ± %.3f", f"m_{m}", f"s_{m}")).otherwise(F.format_string("%.3f", f"m_{m}"))
    return agg.select("method", *[show(m).alias(m) for m in metrics])


def average_ranks(df: DataFrame, metrics: Sequence[str], lower: Sequence[str] = LOWER_BETTER) -> DataFrame:
    """Per method, the mean over datasets of its rank among methods (1 is best; equal ones share the mean rank)."""
    per = means(df, metrics, ("dataset", "method"))

    def rank(m: str):
        order = F.asc_nulls_last(m) if m in lower else F.desc_nulls_last(m)
        first = F.rank().over(Window.partitionBy("dataset").orderBy(order))
        same = F.count(F.lit(1)).over(Window.partitionBy("dataset", m))
        return F.when(F.col(m).isNotNull(), first + (same - 1) / 2).alias(m)

    return per.select("dataset", "method", *[rank(m) for m in metrics]).groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics])


def pivot(df: DataFrame, metric: str, rows: str = "dataset", columns: str = "method", names: Sequence[str] | None = None) -> DataFrame:
    return nulls(df, [metric]).groupBy(rows).pivot(columns, list(names) if names else None).agg(F.round(F.avg(metric), 12))


def with_row_mean(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add `mean`: of the columns that aren't NULL."""
    present = F.array_compact(F.array(*names))
    return wide.withColumn("mean", F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(present) > 0, F.size(present)))


def pareto(df: DataFrame, a: str, b: str, lower: Sequence[str] = LOWER_BETTER) -> DataFrame:
    """(method, a, b) of the methods that no other equals or beats in both metrics and beats in one."""
    signed = lambda m: -F.col(m) if m in lower else F.col(m)
    mine = df.select("method", a, b, signed(a).alias("x"), signed(b).alias("y"))
    other = mine.select(F.col("method").alias("m2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    beaten = (F.col("m2") != F.col("method")) & (F.col("x2") >= F.col("x")) & (F.col("y2") >= F.col("y")) & ((F.col("x2") > F.col("x")) | (F.col("y2") > F.col("y")))
    return mine.join(other, beaten, "left_anti").select("method", a, b)


def best_marks(df: DataFrame, metrics: Sequence[str], lower: Sequence[str] = LOWER_BETTER) -> DataFrame:
    """For each metric, is the row's value the best of its column?"""
    all_ = Window.partitionBy()
    best = lambda m: F.min(m).over(all_) if m in lower else F.max(m).over(all_)
    return df.select("method", *[(F.col(m) == best(m)).alias(m) for m in metrics])


def best_in_row(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    top = F.greatest(*names)
    return wide.select(wide.columns[0], *[F.coalesce(F.col(c) == top, F.lit(False)).alias(c) for c in names])


def best_method(df: DataFrame, metrics: Sequence[str], lower: Sequence[str] = LOWER_BETTER, methods: Sequence[str] = METHODS) -> DataFrame:
    """(metric, method, value): the best mean of each metric; of equal ones the first in the order of methods."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) if m in lower else -F.col(m)).alias("cost")) for m in metrics])
    long = df.join(method_order(df.sparkSession, methods), "method").select("method", "position", F.explode(cells).alias("c")).select("method", "position", "c.*").where("value is not null")
    first = F.row_number().over(Window.partitionBy("metric").orderBy("cost", "position"))
    return long.withColumn("first", first).where("first = 1").select("metric", "method", "value")


def first_k(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(F.min("k").alias("k"))


def shape(df: DataFrame) -> DataFrame:
    """(n_datasets, n_methods, n_seeds, n_truth): distinct values, and rows that have a plausibility."""
    return nulls(df, ["causal_plausibility"]).agg(F.countDistinct("dataset").alias("n_datasets"), F.countDistinct("method").alias("n_methods"), F.countDistinct("seed").alias("n_seeds"), F.count("causal_plausibility").alias("n_truth"))


def in_order(df: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Rows of known methods with their position, in that order; methods without rows are NULL."""
    return method_order(df.sparkSession, methods).join(df, "method", "left").orderBy("position")


def with_mean_row(wide: DataFrame, key: str, names: Sequence[str], places: int = 3) -> DataFrame:
    """Rounded rows and one more, "Mean"."""
    row = wide.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("Mean").alias(key), *names)
    return wide.select(key, *names).unionByName(row).select(key, *[F.round(c, places).alias(c) for c in names])


def most_stable(df: DataFrame, among: Sequence[str]) -> DataFrame:
    """(method, stability): of the methods named, the one of the greatest mean stability."""
    m = means(df.where(F.col("method").isin(*among)), ["stability"])
    return m.join(method_order(df.sparkSession), "method").orderBy(F.desc_nulls_last("stability"), "position").limit(1).select("method", "stability")


def friedman(df: DataFrame, metric: str) -> DataFrame:
    """(statistic, dof): the tie-corrected Friedman statistic over datasets and methods."""
    per = means(df, [metric], ("dataset", "method"))
    first = F.rank().over(Window.partitionBy("dataset").orderBy(metric))
    same = F.count(F.lit(1)).over(Window.partitionBy("dataset", metric))
    ranks = per.select("dataset", "method", (first + (same - 1) / 2).alias("r"), (same * same - 1).alias("t"))
    sums = ranks.groupBy("method").agg(F.sum("r").alias("s"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    k, n = F.count(F.lit(1)), F.max("n")
    chi = (12 * F.sum(F.col("s") * F.col("s")) / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - F.sum("t") / (n * (k * k * k - k)))
    return sums.agg(chi.alias("statistic"), (k - 1).cast("int").alias("dof"))


def signed_ranks(df: DataFrame, metric: str, proposed: str = "Proposed") -> DataFrame:
    """(method, delta, plus, minus, n): per baseline the mean difference over datasets and the sums of signed ranks."""
    per = means(df, [metric], ("dataset", "method"))
    mine = per.where(F.col("method") == proposed).select("dataset", F.col(metric).alias("p"))
    d = per.where(F.col("method") != proposed).join(mine, "dataset").select("method", (F.col("p") - F.col(metric)).alias("d"))
    delta = d.groupBy("method").agg(F.avg("d").alias("delta"))
    size = F.round(F.abs("d"), 12)
    first = F.rank().over(Window.partitionBy("method").orderBy("size"))
    same = F.count(F.lit(1)).over(Window.partitionBy("method", "size"))
    ranks = d.withColumn("size", size).where("size > 0").withColumn("r", first + (same - 1) / 2)
    sums = ranks.groupBy("method").agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.count(F.lit(1)).alias("n"))
    return delta.join(sums, "method", "left").select("method", "delta", F.coalesce("plus", F.lit(0.0)).alias("plus"), F.coalesce("minus", F.lit(0.0)).alias("minus"), F.coalesce("n", F.lit(0)).alias("n"))
