"""Exact bootstrap resamples without a shuffle of rows: draws split binomially over ranges of rows, down to blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.session import ship

#: Rows of one block, whose draws are dealt at once.
BLOCK = 4096
_FEW_FILES = 100_000


class Draws:
    """Multiplicities of n rows, numbered from 0, drawn n times with replacement, for any number of resamples.

    How many draws fall into the first half of a range of blocks is a binomial number of a generator seeded by resample and range,
    so whoever needs a block walks down to it from the whole and finds the same numbers; a block's draws are then one multinomial
    sample. The multiplicities of a resample add up to n exactly.
    """

    def __init__(self, n: int, seed: int = 42) -> None:
        self.n, self.seed = n, seed
        self._known: dict[tuple[int, int, int], int] = {}
        self._last: tuple[tuple[int, int], np.ndarray] | None = None

    def _rng(self, *key: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64(np.random.SeedSequence([self.seed, *key])))

    def in_block(self, b: int, block: int) -> int:
        """Draws of resample b that fall into a block."""
        lo, hi, draws = 0, -(-self.n // BLOCK), self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            key = b, lo, hi
            if key not in self._known:
                if len(self._known) > 100_000:
                    self._known.clear()
                rows, left = min(hi * BLOCK, self.n) - lo * BLOCK, (mid - lo) * BLOCK
                self._known[key] = int(self._rng(1, *key).binomial(draws, left / rows)) if draws else 0
            first = self._known[key]
            lo, hi, draws = (lo, mid, first) if block < mid else (mid, hi, draws - first)
        return draws

    def of_block(self, b: int, block: int) -> np.ndarray:
        if self._last is None or self._last[0] != (b, block):
            size = min(BLOCK, self.n - block * BLOCK)
            self._last = (b, block), self._rng(2, b, block).multinomial(self.in_block(b, block), np.full(size, 1 / size))
        return self._last[1]

    def of_rows(self, b: int, numbers: np.ndarray) -> np.ndarray:
        """Multiplicities in resample b of rows of the given numbers."""
        out = np.zeros(len(numbers), np.int64)
        blocks = numbers // BLOCK
        for block in np.unique(blocks):
            mine = blocks == block
            out[mine] = self.of_block(b, int(block))[numbers[mine] - block * BLOCK]
        return out


def row_numbers(frame: FeatureFrame) -> tuple[DataFrame, int]:
    """The table, stored, with a number from 0 for each row (`sieveline_row`), and the number of rows.

    Numbers go by file and place in the file, so no row moves, and a later read that splits the files otherwise finds the same.
    """
    df = frame.stored().df
    meta = df.metadataColumn("_metadata")
    counts = df.groupBy(meta["file_path"].alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect()
    starts = np.cumsum([0, *(r["n"] for r in counts)])
    table = df.sparkSession.createDataFrame([(r["path"], int(s)) for r, s in zip(counts, starts, strict=False)], "sieveline_path string, sieveline_start long")
    files = F.broadcast(table) if len(counts) <= _FEW_FILES else table
    numbered = df.withColumns({"sieveline_path": meta["file_path"], "sieveline_at": meta["row_index"]}).join(files, "sieveline_path")
    return numbered.withColumn("sieveline_row", F.col("sieveline_start") + F.col("sieveline_at")).drop("sieveline_path", "sieveline_at", "sieveline_start"), int(starts[-1])


def exact_resample(frame: FeatureFrame, resamples: int, seed: int = 42) -> DataFrame:
    """(b, row_id, w): how often each row is in each resample of as many draws as rows; rows that aren't are left out."""
    ship(frame.df.sparkSession)
    rows, n = row_numbers(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(n, seed)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("row_id"))
            numbers = batch.column(batch.schema.get_field_index("sieveline_row")).to_numpy(zero_copy_only=False)
            for b in range(resamples):
                w = draws.of_rows(b, numbers)
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b), pa.int32()), ids.take(pa.array(at)), pa.array(w[at], pa.int32())], ["b", "row_id", "w"])

    return rows.select("row_id", "sieveline_row").mapInArrow(run, f"b int, row_id {rows.schema['row_id'].dataType.simpleString()}, w int")
