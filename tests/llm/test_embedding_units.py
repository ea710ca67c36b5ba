import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import embedding_dedup


def test_rows_sent_follow_units_not_cells(spark, monkeypatch):
    """Vectors without structure visit nearly every cell, but are sent once to a unit of cells."""
    x = np.random.default_rng(2).normal(size=(6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, real = [], embedding_dedup.save

    def counts(*_):
        return lambda t: pa.table({"id": pa.array([0], pa.int64()), "n": pa.array([t.num_rows], pa.int64()), "root": pa.array([0], pa.int64())})

    def save(table, name, *more):
        out = real(table, name, *more)
        if name == "embedding-links":
            sent.append(sum(r["n"] for r in out.collect()))
        return out

    monkeypatch.setattr(embedding_dedup, "_compare", counts)
    monkeypatch.setattr(embedding_dedup, "save", save)
    embedding_dedup.near_embeddings(df, per_cell=40)
    assert sent[0] < 8 * len(x)


@pytest.mark.parametrize("single", [False, True])
def test_links_whatever_the_units(spark, monkeypatch, single):
    """Units of a few cells, units cut in blocks, and chunks of askers; numbers that four bytes hold, or not, or in part."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(100, 8)), 6, 0) + rng.normal(size=(600, 8)) * 0.12
    x[:300] = x[0] + rng.normal(size=(300, 8)) * 0.2  # a crowd, in one or two cells
    x[::2] = x[::2].astype(np.float32)
    x = x.astype(np.float32).astype(float) if single else x
    for name, value in (("LEAST", 40), ("STORED", 60), ("ASKED", 50), ("UNITS", 10)):
        monkeypatch.setattr(embedding_dedup, name, value)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_embeddings(df, per_cell=12).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near, root = u @ u.T >= 0.95, np.arange(len(x))
    while ((new := np.where(near, root, len(x)).min(1)) != root).any():
        root = new
    assert found == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}
