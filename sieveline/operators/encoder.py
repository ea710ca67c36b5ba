"""The encoder baseline: a variational autoencoder trained by gradients that tasks sum and the driver applies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.session import ship

from .ranking import stored
from .sums import SPEC, summed, totals

Weights = list[np.ndarray]
_HASH = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def _uniform(x: np.ndarray) -> np.ndarray:
    for s, m in _HASH:
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def row_noise(ids: np.ndarray, width: int, step: int, seed: int) -> np.ndarray:
    """Normal numbers of each row, from a hash of its id, the column, the step and the seed: the same wherever a row is read."""
    at = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    at = at + np.uint64((step * 0x8CB92BA72F3D8DD7 + seed * 0xABC98388FB8FAC03) % 2**64)
    return np.sqrt(-2 * np.log(_uniform(at))) * np.cos(2 * np.pi * _uniform(at ^ np.uint64(0x5851F42D4C957F2D)))


def initial(width: int, hidden: int, latent: int, seed: int) -> Weights:
    """Matrix and bias of each layer: hidden, mean, log-variance, decoder's hidden, decoder's output."""
    rng, out = np.random.default_rng(seed), []
    for a, b in ((width, hidden), (hidden, latent), (hidden, latent), (latent, hidden), (hidden, width)):
        out += [rng.uniform(-(a**-0.5), a**-0.5, (a, b)), rng.uniform(-(a**-0.5), a**-0.5, b)]
    return out


def gradients(w: Weights, x: np.ndarray, noise: np.ndarray, divergence: float = 1e-3) -> tuple[float, Weights]:
    """Summed loss of the rows (mean squared error and `divergence` times the mean divergence from a normal) and its gradients."""
    h_w, h_b, m_w, m_b, v_w, v_b, d_w, d_b, o_w, o_b = w
    d, k = x.shape[1], m_w.shape[1]
    h = np.maximum(x @ h_w + h_b, 0)
    mean, log_var = h @ m_w + m_b, np.clip(h @ v_w + v_b, -30, 20)
    spread = np.exp(0.5 * log_var)
    z = mean + spread * noise
    back = np.maximum(z @ d_w + d_b, 0)
    error = back @ o_w + o_b - x
    loss = (error**2).sum() / d - 0.5 * divergence * (1 + log_var - mean**2 - np.exp(log_var)).sum() / k
    to_out = 2 * error / d
    to_back = (to_out @ o_w.T) * (back > 0)
    to_z = to_back @ d_w.T
    to_mean = to_z + divergence * mean / k
    to_var = to_z * noise * spread / 2 - divergence * (1 - np.exp(log_var)) / (2 * k)
    to_h = (to_mean @ m_w.T + to_var @ v_w.T) * (h > 0)
    pairs = ((x, to_h), (h, to_mean), (h, to_var), (z, to_back), (back, to_out))
    return float(loss), [g for a, b in pairs for g in (a.T @ b, b.sum(0))]


def _flat(parts: list) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [f.reshape(p.shape) for f, p in zip(np.split(flat, cuts), like, strict=True)]


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def packed(rows: DataFrame, p: int) -> DataFrame:
    """(ids, x) of rows (row_id, x): each batch of rows as bytes, stored, so that a scan reads arrays rather than rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(batch.schema.get_field_index("row_id")).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([_matrix(batch, p).tobytes()], pa.binary())], ["ids", "x"])

    return stored(rows.mapInArrow(pack, "ids binary, x binary"), "packed")


def _blocks(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("ids", "x")), strict=True):
            yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer()).reshape(-1, p)


class Autoencoder:
    """A one-layer encoder and decoder around `latent` normal variables.

    Every step is one scan of packed blocks of rows: tasks sum the gradients of their rows, which are added up in groups (see sums.summed), and the driver,
    which holds the weights only, takes an Adam step. Noise is hashed from row ids, so a rerun or a lost executor gives the
    same model up to the order of sums.
    """

    def __init__(self, latent: int, steps: int = 150, rate: float = 1e-2, seed: int = 42, hidden: int | None = None) -> None:
        self.latent, self.steps, self.rate, self.seed, self.hidden = latent, steps, rate, seed, hidden
        self.losses: list[float] = []

    def fit(self, z: FeatureFrame) -> Autoencoder:
        """z is standardised, without gaps, and should be a stored table."""
        spark, p, seed = z.df.sparkSession, z.p, self.seed
        ship(spark)
        self.features = z.features
        rows = z.wide().select(F.col("row_id").cast("long").alias("row_id"), F.array(*[f"`{c}`" for c in z.features]).alias("x"))
        rows = packed(rows, p)
        tasks = rows.rdd.getNumPartitions()
        w = initial(p, self.hidden or max(self.latent, min(64, p)), self.latent, seed)
        size = sum(a.size for a in w)
        first, second = np.zeros(size), np.zeros(size)
        for step in range(1, self.steps + 1):

            def scan(batches: Iterator[pa.RecordBatch], w=w, step=step) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size + 2)
                for ids, x in _blocks(batches, p):
                    noise = row_noise(ids, w[2].shape[1], step, seed)
                    loss, g = gradients(w, x, noise)
                    total += np.concatenate(([len(x), loss], _flat(g)))
                yield totals({0: total}, TaskContext.get().partitionId())

            found = summed(rows.mapInArrow(scan, SPEC), tasks)
            if 0 not in found or not found[0][0]:
                break
            n, loss, g = found[0][0], found[0][1], found[0][2:] / found[0][0]
            self.losses.append(loss / n)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = self.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w = _shaped(_flat(w) - move, w)
        self.weights = w
        return self

    def saliency(self, z: FeatureFrame) -> np.ndarray:
        """Mean size of the slope of the summed latent means in each feature."""
        w, p = self.weights, z.p
        out = w[2].sum(1)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p + 1)
            for batch in batches:
                x = _matrix(batch, p)
                total += np.concatenate(([len(x)], np.abs(((x @ w[0] + w[1] > 0) * out) @ w[0].T).sum(0)))
            yield totals({0: total}, TaskContext.get().partitionId())

        rows = z.wide().select(F.array(*[f"`{c}`" for c in z.features]).alias("x"))
        found = summed(rows.mapInArrow(scan, SPEC)).get(0, np.zeros(p + 1))
        return found[1:] / max(1.0, found[0])

    def transform(self, z: FeatureFrame) -> FeatureFrame:
        """The latent means, in SQL on arrays of weights."""
        h_w, h_b, m_w, m_b = self.weights[:4]
        x = F.array(*[F.col(f"`{c}`") for c in z.features])
        layer = lambda v, w, b: F.transform(F.array(*[F.struct(F.lit(float(c)).alias("b"), F.array(*map(F.lit, map(float, r))).alias("w")) for r, c in zip(w.T, b, strict=True)]), lambda u: u["b"] + F.aggregate(F.zip_with(v, u["w"], lambda a, e: a * e), F.lit(0.0), lambda s, e: s + e))
        hidden = F.transform(layer(x, h_w, h_b), lambda v: F.greatest(v, F.lit(0.0)))
        names = tuple(f"latent_{j}" for j in range(self.latent))
        d = z.wide().withColumn("sieveline_h", hidden).withColumn("sieveline_m", layer(F.col("sieveline_h"), m_w, m_b))
        return FeatureFrame(d.select("row_id", "y", *[F.get("sieveline_m", F.lit(j)).alias(c) for j, c in enumerate(names)]), names, discrete=z.discrete)

