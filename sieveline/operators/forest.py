"""Forests for many resamples at once: histograms of binned features, one scan for each level of all trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K
from sieveline.session import ship

from .neighbours import matrix
from .stats import poisson_weights
from .sums import SPEC, summed_parts, totals

#: Rows that the bins' edges are taken from, by hash of their id; bytes of histograms that a task holds.
SAMPLE, MEMORY = 10_000, 48 << 20
_TREE_STREAM = 1 << 20


@dataclass(frozen=True)
class Shape:
    trees: int = 20
    depth: int = 8
    bins: int = 32
    seed: int = 0
    least: float = 2.0  # weight of a node that may be split


def bin_edges(rows: DataFrame, p: int, bins: int) -> list[np.ndarray]:
    """Ascending edges of each feature, at most bins - 1: quantiles of a bounded sample, the same whenever it is drawn."""
    chosen = rows.select("x", F.xxhash64("row_id").alias("h")).orderBy("h").limit(SAMPLE).select("x").collect()
    x = np.array([r["x"] for r in chosen], float).reshape(-1, p)
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) if len(c) else np.zeros(0) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]) if x.shape[1] else np.zeros(x.shape, int)


def candidates(tree: int, node: int, p: int, many: int, seed: int) -> np.ndarray:
    """The features that a node may be split by."""
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(p)[:many])


def _impurity(h: np.ndarray, classes: int) -> np.ndarray:
    """Weighted Gini impurity of class weights, or the squared deviation of (weight, sum, sum of squares), along the last axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            n = h.sum(-1)
            return np.where(n > 0, n - (h * h).sum(-1) / n, 0.0)
        return np.where(h[..., 0] > 0, h[..., 2] - h[..., 1] ** 2 / h[..., 0], 0.0)


def best_splits(h: np.ndarray, classes: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, candidate, bin, statistic): gain, candidate and last bin of the left side of each node's best split."""
    left = np.cumsum(h, 2)[:, :, :-1]
    whole = h.sum(2, keepdims=True)
    right = whole - left
    gain = _impurity(whole, classes) - _impurity(left, classes) - _impurity(right, classes)
    size = (lambda a: a.sum(-1)) if classes else (lambda a: a[..., 0])
    gain = np.where((size(left) > 0) & (size(right) > 1e-9) & (size(whole) >= least), gain, 0.0)
    flat = gain.reshape(len(h), -1)
    at = flat.argmax(1)
    top = flat[np.arange(len(h)), at]
    return np.where(top > 1e-9, top, 0.0), at // gain.shape[2], at % gain.shape[2]


def _weights(ids: np.ndarray, resample: int, tree: int, seed: int, sample_seed: int) -> np.ndarray:
    """A row's multiplicity for a tree of a resample: that of the resample, drawn again for the tree."""
    own = poisson_weights(ids, _TREE_STREAM + tree, seed)
    return own if resample < 0 else own * poisson_weights(ids, resample, sample_seed)


def forest_importances(frame: FeatureFrame, resamples: int = 0, sample_seed: int = 42, shape: Shape = Shape(), stored: bool = False) -> dict[int, np.ndarray]:
    """Importances over their maximum, of the whole table (-1) and of each resample that stats.grams draws with the same seed.

    Every level of the trees of all resamples takes one scan (or a few, so that a task's histograms stay within MEMORY): tasks
    send rows down the trees as they are and sum statistics of the label by node, candidate feature and bin; the groups that add these up
    choose the splits, so the driver gets one split a node. Missing values are 0. Trees see the root of the features at
    each node (a third of them for numbers), all of up to three; importances are mean shares of the decrease in impurity.
    """
    ship(frame.df.sparkSession)
    p, classes = frame.p, 0
    wide = frame.wide() if stored else frame.stored().wide()
    rows = wide.where("y is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("double").alias("y"), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in frame.features]).alias("x"))
    if frame.discrete:
        classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
    edges = bin_edges(rows, p, shape.bins)
    many = min(p, max(3, round(p**0.5) if frame.discrete else p // 3))
    names = [(b, t) for b in range(-1, resamples) for t in range(shape.trees)]
    size = 2 ** (shape.depth + 1)
    feature, last = np.full((len(names), size), -1, np.int32), np.zeros((len(names), size), np.int16)
    open_ = np.zeros((len(names), size), bool)
    open_[:, 1] = True
    found = np.zeros((len(names), p))
    stats = classes or 3

    for level in range(shape.depth):
        first = 2**level
        live = np.flatnonzero(open_[:, first : 2 * first].any(1))
        # Histograms are held for open nodes only.
        at = 0
        while at < len(live):
            group, held = [], 0
            while at < len(live):
                need = int(open_[live[at], first : 2 * first].sum()) * many * shape.bins * stats * 8
                if group and held + need > MEMORY:
                    break
                group.append(int(live[at]))
                held, at = held + need, at + 1
            for k, splits in _level(rows, names, group, level, (feature, last, open_), edges, many, classes, shape, sample_seed, p).items():
                for node, gain, f, cut in splits.reshape(-1, 4):
                    node = int(node)
                    open_[k, node] = False
                    if gain > 0:
                        found[k, int(f)] += gain
                        feature[k, node], last[k, node] = int(f), int(cut)
                        if level + 1 < shape.depth:
                            open_[k, 2 * node : 2 * node + 2] = True
        open_[:, first : 2 * first] = False
    shares = found / np.maximum(found.sum(1, keepdims=True), 1e-300)
    return {b: K.over_max(np.mean([shares[i] for i, n in enumerate(names) if n[0] == b], axis=0)) for b in range(-1, resamples)}


def _level(rows: DataFrame, names: list, group: list[int], level: int, grown: tuple, edges: list, many: int, classes: int, shape: Shape, sample_seed: int, p: int) -> dict[int, np.ndarray]:
    """(node, gain, feature, last bin of the left side) of the open nodes of a group of trees on one level, flat, by tree."""
    feature, last, open_ = (a[group] for a in grown)
    nodes = {k: np.flatnonzero(open_[i]) for i, k in enumerate(group)}
    allowed = {k: np.array([candidates(names[k][1], int(n), p, many, shape.seed) for n in nodes[k]]) for k in group}
    bins, stats = shape.bins, classes or 3

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(nodes[k]) * many * bins * stats) for k in group}
        for batch in batches:
            ids, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("row_id", "y"))
            binned = _binned(matrix(batch, "x"), edges)
            row = np.arange(len(ids))
            for i, k in enumerate(group):
                w = _weights(ids, *names[k], shape.seed, sample_seed)
                node = np.ones(len(ids), np.int64)
                for _ in range(level):
                    f = feature[i, node]
                    inner = f >= 0
                    node = np.where(inner, 2 * node + (binned[row, np.maximum(f, 0)] > last[i, node]), 0)
                here = np.flatnonzero((w > 0) & open_[i, node])
                if not len(here):
                    continue
                place, weight = np.searchsorted(nodes[k], node[here]), w[here]
                for j in range(many):
                    cell = (place * many + j) * bins + binned[here, allowed[k][place, j]]
                    if classes:
                        sums[k] += np.bincount(cell * stats + y[here].astype(np.int64), weight, len(sums[k]))
                    else:
                        for s, v in enumerate((weight, weight * y[here], weight * y[here] ** 2)):
                            sums[k] += np.bincount(cell * stats + s, v, len(sums[k]))
        yield totals(sums, TaskContext.get().partitionId())

    def split(k: int, total: np.ndarray) -> np.ndarray:
        h = total.reshape(len(nodes[k]), many, bins, stats)
        gain, which, cut = best_splits(h, classes, shape.least)
        return np.column_stack((nodes[k], gain, allowed[k][np.arange(len(nodes[k])), which], cut)).ravel()

    return summed_parts(rows.mapInArrow(scan, SPEC), split)

