"""Words made to collide, index batches of different sizes, and rows that keep their numbers when splits change."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, jaccard, substring


def collide(family):
    """Two ASCII words of sixteen bytes with one hash under the known key 0."""
    base, start = np.uint64(common._BASES[family] | 1), np.uint64(int(common._STARTS[family]))
    first = common.mix(np.array([start ^ np.uint64(16)]))[0]
    half = lambda w: common.mix(np.array([(first ^ np.frombuffer(w, "<u8")[0])]) * base)[0]
    a, tail = b"abcdefgh", np.frombuffer(b"zyxwvuts", "<u8")[0]
    for letters in itertools.product(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", repeat=8):
        b = bytes(letters)
        other = (half(a) ^ half(b) ^ tail).tobytes()
        if all(0x21 <= x < 0x7F and not 65 <= x <= 90 for x in other):
            return (a + tail.tobytes()).decode(), (b + other).decode()
    raise AssertionError


def chunk(words, **kw):
    ((_, _, h, _),) = common.word_chunks(pa.array([" ".join(words)]), **kw)
    return h


@pytest.mark.parametrize("family", [0, 1])
def test_words_made_to_collide(spark, family):
    with np.errstate(over="ignore"):
        a, b = collide(family)
    h = chunk([a, b], families=2)
    assert a != b and h[family, 0] == h[family, 1]
    for key in (1, common.new_key()):
        h = chunk([a, b], families=2, key=key)
        assert (h[:, 0] != h[:, 1]).all()
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.ngram_jaccard(df, 4, 85).select("doc_id", "component_id").collect()} == {(1, 1), (2, 2)}
    words = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{a} {words}"), (2, f"{a} {words} gap {b} {words}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df)[0].collect()} == {1: 0, 2: 13}


def test_batches_of_any_size(spark):
    texts = [" ".join(f"w{(i * 7 + k) % 900}" for k in range(40)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    want = Counter(map(tuple, substring.substring_dedup(df)[0].collect()))
    for sizes in ((5, 7, 3), (12, 13, 1), (None, 4, None)):
        history, found = None, []
        for k, buckets in enumerate(sizes):
            batch, history = substring.substring_dedup(df.where(f"doc_id >= {80 * k} and doc_id < {80 * k + 80}"), 13, history, True, buckets)
            found += map(tuple, batch.collect())
        assert Counter(found) == want


def test_numbers_survive_other_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(6000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit(1).alias("row")).repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        docs, name = common.numbered(spark.read.parquet(path))
        first = {r.doc_id: r[name] for r in docs.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        again = {r.doc_id: r[name] for r in docs.select("*").collect()}
        fresh, _ = common.numbered(spark.read.parquet(path))
        third = {r.doc_id: r[name] for r in fresh.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert name == "row_" and first == again == third and len(set(first.values())) == 6000 and min(first.values()) >= 0
    made, name = common.numbered(spark.range(50).toDF("x"))
    assert made.select(name).distinct().count() == 50
    assert common.numbered(spark.read.parquet(path).where("false"))[0].count() == 0


def test_copies_after_other_splits(spark, tmp_path, monkeypatch):
    """Splits that change between the two scans of a stage change nothing."""
    import corpus_pipeline

    path = str(tmp_path / "docs")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2700).cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).repartition(4).write.option("parquet.block.size", 4096).parquet(path)
    before, real = spark.conf.get("spark.sql.files.maxPartitionBytes"), corpus_pipeline.exact_dedup

    def dedup(*a, **kw):
        out = real(*a, **kw)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "15000")
        return out

    monkeypatch.setattr(corpus_pipeline, "exact_dedup", dedup)
    try:
        kept = corpus_pipeline.copies(spark, spark.read.parquet(path), "").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.doc_id for r in kept) == list(range(2700))


def test_vectors_of_several_lengths(spark):
    from sieveline.llm.embedding_dedup import near_embeddings

    rng = np.random.default_rng(1)
    base = {k: rng.normal(size=(30, k)) for k in (1, 3, 8)}
    rows = [(100 * k + i, (base[k][i % 30] + 0.02 * rng.normal(size=k) * (i >= 30)).tolist()) for k in base for i in range(45)] + [(5, [1.0, 2.0, 3.0, 4.0]), (6, None), (7, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k in base:
        ids = [i for i, _ in rows if 100 * k <= i < 100 * k + 100]
        x = np.array([v for i, v in rows if i in set(ids)])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        link = u @ u.T >= 0.95
        assert [got[i][0] for i in ids] == (link.sum(1) - 1).tolist()
        reach = np.linalg.matrix_power(link.astype(float), 45) > 0
        assert [got[i][1] for i in ids] == [ids[int(np.flatnonzero(r)[0])] for r in reach]
    assert [got[i] for i in (5, 6, 7)] == [(0, 5), (0, 6), (0, 7)]


def test_levels_of_the_index(spark):
    """Runs are added and merged level by level; what is removed is what one batch removes."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 20)) for _ in range(30)]
    texts = [" ".join((f"a{i}", passages[i % 30], f"b{i}", passages[i * 7 % 30])) for i in range(140)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter(map(tuple, substring.substring_dedup(df)[0].collect()))
    history, found, shapes = None, [], []
    for k in range(7):
        batch, history = substring.substring_dedup(df.where(f"doc_id >= {20 * k} and doc_id < {20 * k + 20}"), 13, history, True, fanout=2)
        found += map(tuple, batch.collect())
        shapes.append(sorted(bytes(r[0])[8] for r in history.select("ids").distinct().collect()))
    assert Counter(found) == want
    assert shapes == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    assert len({bytes(r[0])[:8] for r in history.select("ids").collect()}) == 1
    whole = substring.substring_dedup(df, keep_index=True)[1]
    windows = lambda index: sum(len(common.unpack_sorted(r.hashes)) for r in index.collect())
    assert windows(history) == windows(whole)


def test_numbers_of_other_formats(spark, tmp_path):
    """Files that have no places for rows, as JSON, are written first."""
    path = str(tmp_path / "rows")
    spark.range(40).write.json(path)
    rows, name = common.numbered(spark.read.json(path))
    assert rows.select(name).distinct().count() == 40 and rows.count() == 40
