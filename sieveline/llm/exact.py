"""Exact dedup by content sort: sampled splitters, range partitions sorted by content, comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, save, text_bytes


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _upto(splitters: Column, key: Column) -> Column:
    """How many of the ascending groups of splitters' entries are up to key.

    Two levels: a whole group is skipped by its last entry, so a row costs twice the square root of their number.
    """
    lower = lambda s: s <= key
    whole = F.size(F.filter(splitters, lambda g: lower(F.element_at(g, -1))))
    return F.lit(0) + F.aggregate(F.slice(splitters, 1, whole), F.lit(0), lambda n, g: n + F.size(g)) + F.when(whole < F.size(splitters), F.size(F.filter(F.get(splitters, whole), lower))).otherwise(0)


def _entry(key: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(key)])


def _groups(keys: list[tuple]) -> Column:
    """Splitters as an array of arrays of structs."""
    size = max(1, round(len(keys) ** 0.5))
    return F.array(*[F.array(*map(_entry, keys[i : i + size])) for i in range(0, len(keys), size)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 16 << 20, prefix: int = 32, per_splitter: int = 64, most_slices: int = 4096) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical without white space; null counts as empty, so null, empty and blank texts are one
    group. Of a group the row with the most code points in its original text stays, ties going to the smallest id (a null
    id comes last); rows that repeat an id are all kept or all dropped with it. An id may be any sortable value, a struct too. Any other columns of docs are ignored.

    A bounded random sample (about twice `per_splitter` rows for each slice) gives the splitters, for four slices a partition and `most_slices` at
    most, as they are part of the plan; if that isn't enough, each slice is dealt further by the hash of the content. Rows are compared with them by the first `prefix` characters,
    then by a hash of the whole, then by a salt: a group of copies that fills several slices is spread over them. Each slice
    is sorted by content on disk, and each row is compared in full with the one before it. Groups that touch a splitter are
    then put together across slices from one row for each slice.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), normalised(F.col(text_col)).alias("content"))
    d = d.withColumn("salt", F.xxhash64("doc_id", "points"))
    partitions = max(2, -(-text_bytes(docs, text_col) // partition_bytes))
    n = max(2, min(4 * partitions, most_slices))
    finer = -(-4 * partitions // n)
    order = [F.substring("content", 1, prefix).alias("k0"), F.xxhash64("content").alias("k1"), F.col("salt").alias("k2")]
    # Any rows serve, as splitters decide about balance only: each is drawn with a chance that gives about 2 * n * per_splitter.
    rows = docs.count()
    sample = sorted(tuple(r) for r in d.where(F.rand(7) * rows < 2 * n * per_splitter).select(*order).limit(4 * n * per_splitter).collect()) if rows else []
    keys = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    full = F.struct(*order)
    if keys:
        whole = F.struct(*order[:2])
        # Splitters of a row's own content can only be the last up to it or the first beyond it.
        short = F.array(*[_entry(k[:2]) for k in keys])
        d = d.withColumn("part", _upto(_groups(keys), full))
        d = d.withColumn("edge", F.coalesce(F.get(short, F.col("part") - 1) == whole, F.lit(False)) | F.coalesce(F.get(short, "part") == whole, F.lit(False)))
    else:
        d = d.withColumn("part", F.lit(0)).withColumn("edge", F.lit(False))

    if finer > 1:
        d = d.withColumn("part", F.col("part") * finer + F.pmod(F.xxhash64(F.lit(3), "content"), F.lit(finer)).cast("int"))

    # The sort within a partition puts equal contents side by side, the row that stays first.
    sorted_ = Window.partitionBy("part").orderBy("content", F.desc("points"), F.asc_nulls_last("doc_id"))
    d = d.repartition(partitions, "part").withColumn("new", F.coalesce(F.lag("content").over(sorted_) != F.col("content"), F.lit(True)))
    d = d.withColumn("run", F.sum(F.col("new").cast("int")).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.select("doc_id", "points", "part", "edge", "new", "run", F.sha2(F.encode("content", "UTF-8"), 256).alias("text_sha256"), F.when(F.col("edge") & F.col("new"), F.col("content")).alias("content"))
    rows = save(d, "exact-rows")

    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
    heads = rows.groupBy("part", "run").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"), F.max("content").alias("content"), F.first("edge").alias("edge"))
    inner = heads.where(~F.col("edge")).select("part", "run", F.col("best.i").alias("keep_id"), "size")
    edges = heads.where("edge")
    joined = edges.groupBy("content").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    outer = edges.select("part", "run", "content").join(joined, "content").select("part", "run", F.col("best.i").alias("keep_id"), "size")
    groups = inner.unionByName(outer)
    out = rows.select("doc_id", "part", "run", "text_sha256").join(groups, ["part", "run"])
    return out.select("doc_id", "keep_id", F.col("size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


