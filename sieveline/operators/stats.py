"""Cross-products of all features and the label, for the data and for weighted resamples, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions.kernels import Gram
from sieveline.session import ship

from .moments import WIDE, all_moments, class_moments
from .resample import Draws, row_numbers
from .sums import SPEC, summed, totals



def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def poisson_weights(ids: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Poisson(1) multiplicities of rows in resample b, from a hash of id, b and seed: the same wherever a row is read."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((b * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
    return np.searchsorted(steps, u, "right").astype(float)


def grams(frame: FeatureFrame, resamples: int = 0, seed: int = 42, weights: DataFrame | None = None, exact: bool = False) -> dict[int, Gram]:
    """Gram of the data (b = -1) and of each resample b, from one scan.

    Resamples weigh rows by poisson_weights; or, if `exact`, by resample.Draws, so that each has as many draws as there are rows, for
    which the table is stored first; neither shuffles rows. Or by a table weights (b, row_id, w) joined to the rows.
    Missing values count as the mean. Columns are shifted by their means before products are summed. Sums have the size of
    p x p whatever the number of rows; the driver gets one for each b.
    """
    ship(frame.df.sparkSession)
    cols = [f"`{c}`" for c in frame.features]
    p = frame.p
    if p > WIDE and not frame.discrete:
        shift = np.append(all_moments(frame).mean, frame.wide().agg(F.avg("y")).first()[0] or 0.0)
    elif p > WIDE:
        classes = class_moments(frame)
        n = sum(m.n for m in classes.values())
        total = sum(m.n * m.mean for m in classes.values()) / np.maximum(n, 1)
        rows = {c: float(m.n.max(initial=0)) for c, m in classes.items()}
        shift = np.append(total, sum(c * k for c, k in rows.items()) / max(1.0, sum(rows.values())))
    else:
        means = frame.wide().agg(F.avg("y"), *[F.avg(c) for c in cols]).first()
        shift = np.array([*(m or 0.0 for m in means[1:]), means[0] or 0.0])
    filled = [F.coalesce(F.col(c) - F.lit(float(shift[i])), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)]
    data, draws = frame.wide(), None
    if exact and weights is None:
        data, n = row_numbers(frame)
        draws = Draws(n, seed)
    number = [F.col("sieveline_row" if draws else "row_id").alias("row_id")]
    data = data.select(*number, *filled, (F.col("y") - F.lit(float(shift[p]))).alias(f"x{p}"))
    size = 1 + (p + 1) + (p + 1) ** 2

    def sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.concatenate(([w.sum()], w @ z, (z.T @ (w[:, None] * z)).ravel()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((resamples + 1, size))
        for batch in batches:
            ids = _column(batch, "row_id")
            z = np.column_stack([_column(batch, f"x{i}") for i in range(p + 1)])
            total[0] += sums(z, np.ones(len(z)))
            for b in range(resamples):
                total[b + 1] += sums(z, poisson_weights(ids, b, seed) if draws is None else draws.of_rows(b, ids).astype(float))
        yield totals({b - 1: t for b, t in enumerate(total)}, TaskContext.get().partitionId())

    def scan_weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            b, w = _column(batch, "b"), _column(batch, "w").astype(float)
            z = np.column_stack([_column(batch, f"x{i}") for i in range(p + 1)])
            for k in np.unique(b):
                total[int(k)] = total.get(int(k), 0) + sums(z[b == k], w[b == k])
        yield totals(total, TaskContext.get().partitionId())

    if weights is None:
        parts = data.mapInArrow(scan, SPEC)
    else:
        parts = data.join(weights.select("b", "row_id", "w"), "row_id").mapInArrow(scan_weighted, SPEC)
    out = {}
    for b, t in summed(parts).items():
        if t[0] > 0:
            out[b] = Gram.from_sums(t[0], t[1 : p + 2], t[p + 2 :].reshape(p + 1, p + 1), shift)
    return out


def gram(frame: FeatureFrame) -> Gram:
    return grams(frame)[-1]


def correlation_pairs(frame: FeatureFrame) -> DataFrame:
    """(f_i, f_j, abs_corr) for f_i < f_j, from one aggregation of shifted products in SQL; for tables of a few dozen columns."""
    cols = [f"`{c}`" for c in frame.features]
    n = frame.p
    means = frame.wide().agg(*[F.avg(c) for c in cols]).first()
    x = [F.col(c) - F.lit(means[i] or 0.0) for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = frame.wide().agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs])
    cov = lambda i, j: F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")
    cells = []
    for i in range(n):
        for j in range(i + 1, n):
            scale = F.sqrt(F.greatest(cov(i, i), F.lit(0.0))) * F.sqrt(F.greatest(cov(j, j), F.lit(0.0)))
            cells.append(F.struct(F.lit(i).alias("f_i"), F.lit(j).alias("f_j"), F.when(scale > 0, F.least(F.abs(cov(i, j)) / scale, F.lit(1.0))).otherwise(0.0).alias("abs_corr")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def pairs_of(frame: FeatureFrame, matrix: np.ndarray, name: str = "abs_corr") -> DataFrame:
    """A symmetric matrix as (f_i, f_j, value) with f_i < f_j."""
    i, j = np.triu_indices(len(matrix), 1)
    rows = [(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j, strict=True)]
    return frame.df.sparkSession.createDataFrame(rows, f"f_i int, f_j int, {name} double")
