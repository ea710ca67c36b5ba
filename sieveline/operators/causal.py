"""Relevance of features: mutual information, forests, ranks, and their blend with blanket membership."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.session import ship

from .continuous import continuous_information, counts_inside
from .ranking import running_count, stored
from .stats import grams


def _harmonic(n: np.ndarray) -> np.ndarray:
    """Digamma of whole numbers, but for Euler's constant, which cancels."""
    table = np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, max(2, int(n.max(initial=1)) + 1)))))
    return table[np.maximum(n.astype(int) - 1, 0)]


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate of the mutual information of a number and a class, at least 0.

    A row's radius reaches its k-th neighbour of the same class; rows of any class strictly inside it, or of equal value,
    are counted. Classes of one row are left out.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    radius, used, size, near = np.zeros(len(x)), np.zeros(len(x), bool), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        if len(at) < 2:
            continue
        v, kc = x[at], min(k, len(at) - 1)
        gaps = np.full((len(at), 2 * kc), np.inf)
        for s in range(1, kc + 1):
            gaps[s:, s - 1] = v[s:] - v[:-s]
            gaps[:-s, kc + s - 1] = v[s:] - v[:-s]
        radius[at] = np.partition(gaps, kc - 1, 1)[:, kc - 1]
        used[at], size[at], near[at] = True, len(at), kc
    if not used.any():
        return 0.0
    v = x[used]
    r, here = radius[used], x[used]
    inside = np.searchsorted(v, here + r, "left") - np.searchsorted(v, here - r, "right")
    same = np.searchsorted(v, here, "right") - np.searchsorted(v, here, "left")
    count = np.where(r > 0, inside, same)
    value = _harmonic(np.array([len(v)]))[0] + _harmonic(near[used]).mean() - _harmonic(size[used]).mean() - _harmonic(count).mean()
    return float(max(0.0, value))


def _digamma(n: Column) -> Column:
    """Digamma of a positive whole number, plus Euler's constant: a table, then the asymptotic series."""
    table = F.array(*[F.lit(float(v)) for v in np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, 30))))])
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) + float(np.euler_gamma)
    return F.when(n <= 30, F.get(table, (n - 1).cast("int"))).otherwise(series)


def _spread_information(cells: DataFrame, k: int) -> DataFrame:
    """neighbour_information for any number of rows, from cells (f, y, id, x): ranks, neighbours by rank, running counts."""
    sizes = cells.groupBy("f", "y").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    own = running_count(cells.join(sizes, ["f", "y"]), ["f", "y"], ["x", "id"], "rank")
    near = own.select("f", "y", "size", "id", "x", "rank", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("step"))
    met = near.groupBy("f", "y", (F.col("rank") + F.col("step")).alias("at")).agg(F.first(F.when(F.col("step") == 0, F.struct("id", "x", "size")), True).alias("me"), F.collect_list(F.when(F.col("step") != 0, F.col("x"))).alias("others"))
    gaps = F.array_sort(F.transform("others", lambda v: F.abs(v - F.col("me.x"))))
    used = F.least(F.lit(k), F.col("me.size") - 1).cast("int")
    rows = stored(met.where("me is not null").select("f", F.col("me.id").alias("id"), F.col("me.x").alias("x"), F.col("me.size").alias("size"), used.alias("k"), F.get(gaps, used - 1).alias("r")), "radii")
    inside = counts_inside(rows, "x", "r")
    each = rows.join(inside, ["f", "id"])
    n = F.count(F.lit(1))
    value = _digamma(n) + F.avg(_digamma(F.col("k"))) - F.avg(_digamma(F.col("size"))) - F.avg(_digamma(F.col("m")))
    return each.groupBy("f").agg(F.greatest(value, F.lit(0.0)).alias("score"))


def mutual_information(frame: FeatureFrame, k: int = 3, weights: DataFrame | None = None, direct: int = 2_000_000) -> DataFrame:
    """(f, score): information of each feature about the label; see continuous_information where that isn't discrete.

    Up to `direct` rows a feature's column is one group of numpy arrays; beyond, ranks and running counts over ranges of
    values give the same numbers, and no task depends on a feature's or a class's rows.
    """
    ship(frame.df.sparkSession)
    if not frame.discrete:
        if weights is not None:
            raise ValueError("resamples repeat rows, which have no distance from each other: take the scores of the whole table")
        return continuous_information(frame, k)
    cells = frame.long().where("x is not null").withColumn("id", F.col("row_id").cast("long"))
    if weights is not None:
        cells = cells.join(weights.select("row_id", "w"), "row_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).withColumn("id", F.col("id") * 4096 + F.col("copy"))
    cells = cells.select(F.col("f").cast("int").alias("f"), "y", "id", "x")
    if frame.df.count() > direct:
        found = _spread_information(cells, k)
        every = frame.df.sparkSession.range(frame.p).select(F.col("id").cast("int").alias("f"))
        return every.join(found, "f", "left").select("f", F.coalesce("score", F.lit(0.0)).alias("score"))

    def one(table: pa.Table) -> pa.Table:
        value = neighbour_information(table.column("x").to_numpy(), table.column("y").to_numpy(), k)
        return pa.table({"f": pa.array([table.column("f")[0].as_py()], pa.int32()), "score": [value]})

    return cells.select("f", "y", "x").groupBy("f").applyInArrow(one, "f int, score double")


def over_max(scores: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy())
    return scores.select("f", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")).alias("score"))


def forest_relevance(frame: FeatureFrame, trees: int = 100, depth: int = 8, seed: int = 0, weight: str | None = None) -> np.ndarray:
    """Importances of a random forest, of regression trees if the label isn't discrete, over their maximum.

    Rows keep their nodes from level to level, rather than go down every tree again; the trees are the same.
    """
    w = frame.wide() if weight is None else frame.df.select("y", *frame.features, weight)
    data = VectorAssembler(inputCols=list(frame.features), outputCol="sieveline_x").transform(w.fillna(0.0, list(frame.features)))
    kind = RandomForestClassifier if frame.discrete else RandomForestRegressor
    forest = kind(featuresCol="sieveline_x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
    if weight is not None:
        forest = forest.setWeightCol(weight)
    return K.over_max(forest.fit(data).featureImportances.toArray())


def rank_normalise(scores: DataFrame) -> DataFrame:
    """Ranks from 0 to 1 in order of (score, f)."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("score", "f")) - 1
    return scores.select("f", F.when(n > 1, rank / (n - 1)).otherwise(0.0).alias("score"))


def blend(blanket: DataFrame, predictive: DataFrame, lam: float, by_rank: bool = False) -> DataFrame:
    """(f, score): lam times membership and 1 - lam times the predictive score, by rank if wanted."""
    if by_rank:
        blanket, predictive = rank_normalise(blanket), rank_normalise(predictive)
    a = blanket.select("f", F.col("score").alias("a"))
    return a.join(predictive, "f").select("f", (lam * F.col("a") + (1 - lam) * F.col("score")).alias("score"))


def partial_correlations(frame: FeatureFrame, given: int) -> DataFrame:
    """(f, score): first-order partial correlation of every other feature with the label, in SQL from one aggregation."""
    cols = [F.col(f"`{c}`") for c in frame.features]
    means = frame.wide().agg(F.avg("y"), *[F.avg(c) for c in cols]).first()
    y, z = F.col("y") - F.lit(means[0]), cols[given] - F.lit(means[given + 1])
    x = [c - F.lit(means[i + 1]) for i, c in enumerate(cols)]
    others = [i for i in range(frame.p) if i != given]
    sums = frame.wide().agg(F.sum(y * y).alias("yy"), F.sum(z * z).alias("zz"), F.sum(y * z).alias("yz"), *[s.alias(n) for i in others for s, n in ((F.sum(x[i] * x[i]), f"xx{i}"), (F.sum(x[i] * y), f"xy{i}"), (F.sum(x[i] * z), f"xz{i}"))])

    def one(i: int):
        r = lambda a, b, c: F.col(a) / F.sqrt(F.col(b) * F.col(c))
        xy, xz, yz = r(f"xy{i}", f"xx{i}", "yy"), r(f"xz{i}", f"xx{i}", "zz"), r("yz", "yy", "zz")
        rest = F.sqrt((1 - xz * xz) * (1 - yz * yz))
        value = F.when(rest > 1e-12, (xy - xz * yz) / rest).otherwise(0.0)
        fine = (F.col(f"xx{i}") > 0) & (F.col("zz") > 0) & (F.col("yy") > 0)
        return F.struct(F.lit(i).alias("f"), F.when(fine, F.least(F.greatest(value, F.lit(-0.999999)), F.lit(0.999999))).otherwise(0.0).alias("score"))

    return sums.select(F.explode(F.array(*map(one, others))).alias("r")).select("r.*")


def blanket_confidence(frame: FeatureFrame, resamples: int = 6, alpha: float = 0.05, most_given: int = 3, seed: int = 0) -> np.ndarray:
    """Share of resamples in whose Markov blanket each feature is; all from one scan."""
    found = grams(frame, resamples, seed)
    hits = np.zeros(frame.p)
    for b in range(resamples):
        hits[K.markov_blanket(found[b], alpha, most_given)] += 1
    return hits / max(1, resamples)


def vector_frame(frame: FeatureFrame, values: np.ndarray) -> DataFrame:
    return frame.df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "f int, score double")
