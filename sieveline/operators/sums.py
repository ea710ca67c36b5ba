"""Sums of arrays over all tasks, without one task or the driver getting what every task has sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPEC = "b int, part int, sums binary"
_SCHEMA = pa.schema([("b", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
#: Groups of the first step.
SPREAD = 256
#: Tasks whose parts the driver adds itself.
FEW = 32


def totals(found: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    """What one task sends: an array of doubles for each b."""
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([t.tobytes() for t in found.values()], pa.binary())], schema=_SCHEMA)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array after the other is added to the sum, so that a group's memory is two arrays and a batch."""
    total, b, part = None, 0, 0
    for batch in batches:
        names = {n: batch.schema.get_field_index(n) for n in ("b", "part", "sums")}
        for i in range(batch.num_rows):
            new = np.frombuffer(batch.column(names["sums"])[i].as_py())
            if total is None:
                total, b, part = new.copy(), batch.column(names["b"])[i].as_py(), batch.column(names["part"])[i].as_py()
            else:
                total += new
    if total is not None:
        yield totals({b: total}, part)


def summed(parts: DataFrame, tasks: int | None = None) -> dict[int, np.ndarray]:
    """The sum of each b of (b, part, sums): first in SPREAD groups of parts, then these; the driver gets one array for each b.

    The parts of a known number of tasks, FEW at most, go to the driver at once, which adds them in order.
    """
    if tasks is not None and tasks <= FEW:
        out: dict[int, np.ndarray] = {}
        for r in sorted(parts.collect(), key=lambda r: r["part"]):
            out[r["b"]] = out.get(r["b"], 0.0) + np.frombuffer(bytes(r["sums"]))
        return out
    first = parts.groupBy("b", F.pmod("part", F.lit(SPREAD)).alias("slice")).applyInArrow(_add, SPEC)
    return {r["b"]: np.frombuffer(bytes(r["sums"])) for r in first.groupBy("b").applyInArrow(_add, SPEC).collect()}


def summed_parts(parts: DataFrame, then: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """What `then` makes of the sum of each b, in the task that has it, so that the driver doesn't get the sums."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _add(batches):
            b = batch.column(0)[0].as_py()
            yield totals({b: np.asarray(then(b, np.frombuffer(batch.column(2)[0].as_py())), float)}, 0)

    first = parts.groupBy("b", F.pmod("part", F.lit(SPREAD)).alias("slice")).applyInArrow(_add, SPEC)
    return {r["b"]: np.frombuffer(bytes(r["sums"])) for r in first.groupBy("b").applyInArrow(last, SPEC).collect()}
