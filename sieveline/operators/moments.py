"""Counts, means and squared deviations of many columns by class, from one scan of arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from sieveline.frame import FeatureFrame
from sieveline.session import ship

from .sums import SPREAD

#: Tables of more features go by arrays: one expression for each column and statistic would outgrow compiled code.
WIDE = 64
_SCHEMA = pa.schema([("y", pa.int32()), ("part", pa.int32()), ("parts", pa.binary())])
_SPEC = "y int, part int, parts binary"


@dataclass
class Moments:
    """Of each column: values present, their mean, and the sum of their squared deviations from it."""

    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        there = ~np.isnan(x)
        n = there.sum(0).astype(float)
        mean = np.where(there, x, 0).sum(0) / np.maximum(n, 1)
        return cls(n, mean, (np.where(there, x - mean, 0) ** 2).sum(0))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap, safe = other.mean - self.mean, np.maximum(n, 1)
        return Moments(n, self.mean + gap * other.n / safe, self.squares + other.squares + gap * gap * self.n * other.n / safe)

    def pack(self) -> bytes:
        return np.stack((self.n, self.mean, self.squares)).tobytes()

    @classmethod
    def unpack(cls, b: bytes) -> Moments:
        return cls(*np.frombuffer(bytes(b)).reshape(3, -1))


def class_moments(frame: FeatureFrame) -> dict[int, Moments]:
    """Moments of each class's rows (of all rows, as class 0, if the label isn't discrete); a task sends a row for each class it met."""
    ship(frame.df.sparkSession)
    p = frame.p

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            for c in np.unique(y):
                new = Moments.of(x[y == c])
                total[int(c)] = total[int(c)] + new if int(c) in total else new
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), pa.array([m.pack() for m in total.values()], pa.binary())], schema=_SCHEMA)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, y = None, 0
        for batch in batches:
            for c, b in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("y", "parts")), strict=True):
                new, y = Moments.unpack(b.as_py()), c.as_py()
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([0], pa.int32()), pa.array([total.pack()])], schema=_SCHEMA)

    label = F.col("y") if frame.discrete else F.lit(0).alias("y")
    cells = frame.wide().select(label, F.array(*[f"`{c}`" for c in frame.features]).alias("x"))
    first = cells.mapInArrow(scan, _SPEC).groupBy("y", F.pmod("part", F.lit(SPREAD)).alias("slice")).applyInArrow(add, _SPEC)
    found = first.groupBy("y").applyInArrow(add, _SPEC)
    return {r["y"]: Moments.unpack(r["parts"]) for r in found.collect()}


def all_moments(frame: FeatureFrame) -> Moments:
    total = Moments(*np.zeros((3, frame.p)))
    for m in class_moments(frame).values():
        total = total + m
    return total


def anova(classes: dict[int, Moments]) -> np.ndarray:
    """One-way F of each column; 0 where it is undefined."""
    ms = list(classes.values())
    n, k = sum(m.n for m in ms), sum((m.n > 0).astype(int) for m in ms)
    mean = sum(m.n * m.mean for m in ms) / np.maximum(n, 1)
    between, within = sum(m.n * (m.mean - mean) ** 2 for m in ms), sum(m.squares for m in ms)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / (k - 1)) / (within / (n - k))
    return np.where((k > 1) & (n > k) & (within > 1e-12 * (within + between)), f, 0.0)
