"""Encoding, imputation, scaling, caps, sampling and screening of feature tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.frame import FeatureFrame

from .moments import WIDE, all_moments, anova, class_moments
from .ranking import running_count

_LEFT = "sieveline_value"


def marks_to_null(df: DataFrame, columns: list[str], mark: str = "?") -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != mark, F.col(c)) for c in columns})


def _numbered(values: DataFrame, order: list[str], most: int) -> DataFrame:
    """Distinct values with their place (from 0) as sieveline_code: one task ranks up to `most`, ranges of them more."""
    if values.limit(most + 1).count() > most:
        return running_count(values, [], order, "sieveline_code")
    return values.withColumn("sieveline_code", F.row_number().over(Window.orderBy(*order)) - 1)


def codes_by_first_appearance(df: DataFrame, column: str, row_id: str, out: str, most: int = 1_000_000) -> DataFrame:
    """Codes from 0 in the order in which values first occur; missing is -1.

    Distinct values are numbered; rows only meet them in a join.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(_LEFT)).agg(F.min(row_id).alias("at"))
    coded = _numbered(values, ["at", _LEFT], most).select(_LEFT, F.col("sieveline_code").cast("double").alias(out))
    return df.join(coded, df[column] == coded[_LEFT], "left").drop(_LEFT).withColumn(out, F.coalesce(out, F.lit(-1.0)))


def label_codes(df: DataFrame, column: str, out: str, most: int = 1_000_000) -> DataFrame:
    """Codes from 0 of the sorted distinct labels."""
    values = df.select(F.col(column).alias(_LEFT)).distinct()
    coded = _numbered(values, [_LEFT], most).select(_LEFT, F.col("sieveline_code").cast("int").alias(out))
    return df.join(coded, df[column] == coded[_LEFT]).drop(_LEFT)


def medians(frame: FeatureFrame, direct: int = 2_000_000, few: int = 10_000, cells: int = 1_000_000) -> list[float | None]:
    """Exact medians without missing values, all columns in each pass.

    Up to `direct` rows and `cells` values Spark's own exact median serves; one task ends up with all distinct values of all columns. Beyond,
    approximate quantiles give each column a bracket around its middle, which passes narrow until it holds `few` values or one
    value. Tables of many columns go by columns up to `direct` rows.
    """
    w, cols = frame.wide(), [F.col(f"`{c}`") for c in frame.features]
    if frame.p > WIDE and w.count() <= direct:
        found = {r["f"]: r["m"] for r in frame.long().where("x is not null").groupBy("f").agg(F.median("x").alias("m")).collect()}
        return [found.get(i) for i in range(frame.p)]
    sizes = list(w.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()) if cols else []
    if max(sizes, default=0) <= direct and sum(sizes) <= cells:
        return list(w.agg(*[F.median(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()) if cols else []
    out: list[float | None] = [None] * len(cols)
    # (lower, upper) bound of the bracket and the number of values below it
    brackets = {i: (float("-inf"), float("inf"), 0, n) for i, n in enumerate(sizes) if n}
    while brackets:
        inside = {i: F.when((cols[i] >= lo) & (cols[i] <= hi), cols[i]) for i, (lo, hi, _, _) in brackets.items()}
        small = [i for i, (lo, hi, _, n) in brackets.items() if n <= few or lo == hi]
        if small:
            lists = w.agg(*[(F.array_sort(F.collect_list(inside[i])) if brackets[i][3] <= few else F.array(F.lit(brackets[i][0]))).alias(f"v{i}") for i in small]).first()
            for i, values in zip(small, lists, strict=True):
                below, n = brackets.pop(i)[2], sizes[i]
                at = lambda r, v=values, b=below: v[min(r - b, len(v) - 1)]
                out[i] = (at((n - 1) // 2) + at(n // 2)) / 2
            continue
        ends = {}
        for i, (_, _, below, n) in brackets.items():
            middle = ((sizes[i] - 1) / 2 - below) / n
            ends[i] = F.percentile_approx(inside[i], [max(0.0, middle - 0.001), min(1.0, middle + 0.001)], 10_000).alias(f"q{i}")
        found = dict(zip(ends, w.agg(*ends.values()).first(), strict=True))
        counts = w.agg(*[x for i, (lo, hi) in found.items() for x in (F.count_if(cols[i] < lo).alias(f"b{i}"), F.count_if((cols[i] >= lo) & (cols[i] <= hi)).alias(f"i{i}"))]).first()
        for i, (lo, hi) in found.items():
            below, n = counts[f"b{i}"], counts[f"i{i}"]
            if below <= (sizes[i] - 1) // 2 and sizes[i] // 2 < below + n and n < brackets[i][3]:
                brackets[i] = (lo, hi, below, n)
            else:  # no narrower bracket is sure to hold the middle
                low, high, below, _ = brackets.pop(i)
                out[i] = w.select(inside[i].alias("x")).where("x is not null").agg(F.median("x")).first()[0] if low != high else low
    return out


def _each(frame: FeatureFrame, change) -> FeatureFrame:
    """Replace each feature by change(position, column); the row id and label stay."""
    x = [change(i, F.col(f"`{c}`")).alias(c) for i, c in enumerate(frame.features)]
    return replace(frame, df=frame.wide().select("row_id", "y", *x), row_id="row_id", label="y")


def impute(frame: FeatureFrame, values: list[float | None] | None = None) -> FeatureFrame:
    """Fill missing values with the median (0 for a column without values)."""
    values = medians(frame) if values is None else values
    return _each(frame, lambda i, c: F.coalesce(c, F.lit(values[i] if values[i] is not None else 0.0)))


def scale_stats(frame: FeatureFrame) -> list[tuple[float, float]]:
    """(mean, population standard deviation) of each feature, one pass."""
    if frame.p > WIDE:
        m = all_moments(frame)
        return [(float(a), float(b)) for a, b in zip(m.mean, np.sqrt(m.squares / np.maximum(m.n, 1)), strict=True)]
    stats = [f for c in frame.features for f in (F.avg(f"`{c}`"), F.stddev_pop(f"`{c}`"))]
    row = list(frame.wide().agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).first())
    return [(row[i] or 0.0, row[i + 1] or 0.0) for i in range(0, len(row), 2)]


class Standardiser:
    """Median imputation and z-scores by the population standard deviation; constant columns become 0."""

    def __init__(self, with_std: bool = True) -> None:
        self.with_std, self.medians, self.stats = with_std, None, None

    def fit(self, frame: FeatureFrame) -> Standardiser:
        self.medians = medians(frame)
        self.stats = scale_stats(impute(frame, self.medians))
        return self

    def transform(self, frame: FeatureFrame) -> FeatureFrame:
        if self.stats is None:
            raise RuntimeError("fit first")

        def z(i: int, c: Column) -> Column:
            mean, std = self.stats[i]
            score = (c - F.lit(mean)) / F.lit(std if self.with_std and std > 0 else 1.0)
            return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)

        return _each(impute(frame, self.medians), z)

    def fit_transform(self, frame: FeatureFrame) -> FeatureFrame:
        return self.fit(frame).transform(frame)


def variance_cap(frame: FeatureFrame, most: int = 120) -> FeatureFrame:
    """The `most` features of the greatest population variance, in their order (ties: the later one)."""
    if frame.p <= most:
        return frame
    if frame.p > WIDE:
        m = all_moments(frame)
        row = list(m.squares / np.maximum(m.n, 1))
    else:
        row = frame.wide().agg(*[F.var_pop(f"`{c}`").alias(f"v{i}") for i, c in enumerate(frame.features)]).first()
    return frame.take(sorted(sorted(range(frame.p), key=lambda i: (-(row[i] or 0.0), -i))[:most]))


def stratified_sample(frame: FeatureFrame, most: int, seed: int = 42) -> FeatureFrame:
    """`most` rows, each class in proportion (largest remainders first), those of the smallest seeded hashes.

    Cut-offs come from one pass per class over hash ranges, so that no class is one task's work.
    """
    counts = {r["y"]: r["n"] for r in frame.wide().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= most:
        return frame
    share = {y: most * n / total for y, n in counts.items()}
    quota = {y: int(s) for y, s in share.items()}
    for y in sorted(share, key=lambda y: (int(share[y]) - share[y], y))[: most - sum(quota.values())]:
        quota[y] += 1
    plan = frame.df.sparkSession.createDataFrame(sorted(quota.items()), "y int, quota int")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))
    keyed = frame.wide().select("row_id", "y", h.alias("h")).withColumn("bin", F.substring("h", 1, 3))
    bins = keyed.groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = bins.select("y", "bin", (F.sum("n").over(Window.partitionBy("y").orderBy("bin")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("y", "bin").orderBy("h", "row_id"))
    chosen = keyed.withColumn("rank", rank).join(before, ["y", "bin"]).join(plan, "y").where(F.col("before") + F.col("rank") <= F.col("quota"))
    keep = chosen.select(F.col("row_id").alias(_LEFT))
    return replace(frame, df=frame.df.join(keep, frame.df[frame.row_id] == keep[_LEFT], "left_semi"))


def common_schema(frame: FeatureFrame, max_features: int | None = 120, max_samples: int | None = 600, seed: int = 42) -> FeatureFrame:
    """Impute, cap features by variance, then sample rows; None leaves a cap out."""
    out = impute(frame)
    out = variance_cap(out, max_features) if max_features else out
    return stratified_sample(out, max_samples, seed) if max_samples else out


def transpose(frame: FeatureFrame) -> DataFrame:
    """(f, xs): each feature's values by row id. A feature is one row here, so this is for tables that fit one."""
    rows = F.collect_list(F.struct("row_id", "x"))
    return frame.long().groupBy("f").agg(F.transform(F.array_sort(rows), lambda r: r["x"]).alias("xs"))


def transpose_blocks(frame: FeatureFrame, rows: int = 4096) -> DataFrame:
    """(f, block, xs): the values of each feature by row id, `rows` of them in each block; block k holds rows k * rows and on.

    No row of the result, and no task, holds more than a block of a feature.
    """
    cells = running_count(frame.wide(), [], ["row_id"], "sieveline_at").withColumn("block", F.expr(f"sieveline_at div {rows}"))
    values = F.array(*[F.col(f"`{c}`") for c in frame.features])
    tile = F.array_sort(F.collect_list(F.struct("sieveline_at", "x")))
    long = cells.select("sieveline_at", "block", F.posexplode(values).alias("f", "x"))
    return long.groupBy("f", "block").agg(F.transform(tile, lambda r: r["x"]).alias("xs"))


def anova_f(frame: FeatureFrame) -> DataFrame:
    """(f, score): one-way F statistic against the label, from the classes' counts, sums and squares.

    Values are taken off the overall mean first, so that squares don't cancel. Undefined statistics are 0.
    """
    if frame.p > WIDE:
        scores = anova(class_moments(frame))
        return frame.df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "f int, score double")
    means = frame.wide().agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(frame.features)]).first()
    off = _each(frame, lambda i, c: c - F.lit(means[i] or 0.0))
    sums = [f for c in frame.features for f in (F.count(f"`{c}`"), F.sum(f"`{c}`"), F.sum(F.col(f"`{c}`") * F.col(f"`{c}`")))]
    wide = off.df.groupBy("y").agg(*[s.cast("double").alias(f"s{i}") for i, s in enumerate(sums)])
    cells = F.array(*[F.struct(F.col(f"s{3 * i}").alias("n"), F.col(f"s{3 * i + 1}").alias("s"), F.col(f"s{3 * i + 2}").alias("q")) for i in range(frame.p)])
    per = wide.select("y", F.posexplode(cells).alias("f", "m")).select("f", "m.*").where("n > 0")
    agg = per.groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    fine = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("q") - F.col("b") > 1e-12 * F.col("q"))
    return agg.select("f", F.when(fine, between / within).otherwise(0.0).alias("score"))


def top_features(scores: DataFrame, n: int, last_first: bool = True) -> DataFrame:
    """The n rows of the greatest score; equal ones in order of f, the last (or first) first."""
    return scores.orderBy(F.desc("score"), F.desc("f") if last_first else F.asc("f")).limit(n)


def prefilter(frame: FeatureFrame, n: int | None) -> tuple[FeatureFrame, list[int]]:
    """The n features of the greatest F (all if there are no more), in their order, and their positions.

    Where there is no F, the label having no classes, or one, or as many as rows, it is the greatest variance.
    """
    if not n or frame.p <= n:
        return frame, list(range(frame.p))
    if not frame.discrete or not 1 < frame.n_classes() < frame.df.count():
        kept = variance_cap(frame, n)
        return kept, [frame.features.index(c) for c in kept.features]
    keep = sorted(r["f"] for r in top_features(anova_f(frame), n).collect())
    return frame.take(keep), keep


def restrict_candidates(blanket: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(f): the blanket (f), filled up to k with the best scored others; all features if the blanket has fewer than two."""
    size = blanket.agg(F.count(F.lit(1)).alias("size"))
    others = scores.join(blanket, "f", "left_anti")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("f")))
    filled = others.withColumn("rank", rank).crossJoin(size).where((F.col("size") < 2) | (F.col("rank") <= k - F.col("size")))
    return blanket.select("f").unionByName(filled.select("f"))


def support_mask(p: int, selected: DataFrame) -> DataFrame:
    """(f, chosen) of all p features."""
    spark = selected.sparkSession
    hit = selected.select(F.col("f").alias(_LEFT))
    all_ = spark.range(p).select(F.col("id").cast("int").alias("f"))
    return all_.join(hit, F.col("f") == F.col(_LEFT), "left").select("f", F.col(_LEFT).isNotNull().alias("chosen"))
