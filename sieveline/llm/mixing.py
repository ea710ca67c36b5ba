"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import WORD, numbered, save


def water_fill(total: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Share total by weight; shares above their cap are clamped and the excess reshared by weight until none is above."""
    out: list[float | None] = [None] * len(caps)
    while any(x is None for x in out):
        free = [i for i, x in enumerate(out) if x is None]
        level = (total - sum(x for x in out if x is not None)) / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > caps[i]]
        for i in over:
            out[i] = float(caps[i])
        if not over:
            for i in free:
                out[i] = level * weights[i]
    return out  # type: ignore[return-value]


def source_plan(sizes: dict[str | None, int], weights: Sequence[float], share: float, max_epochs: float) -> list[tuple]:
    """(source, words it has, target, whole repetitions, words of the fractional one); weights repeat over sources in order."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    have = [sizes[s] for s in names]
    targets = water_fill(share * sum(have), [weights[i % len(weights)] for i in range(len(names))], [max_epochs * n for n in have])
    out = []
    for name, n, t in zip(names, have, targets, strict=True):
        whole = int(t // n) if n else 0
        out.append((name, n, t, whole, t - whole * n if whole < max_epochs else 0.0))
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size in words, source_size, target, repeats, taken (size times repeats), and keep if named.

    The mix is `share` times all words. Sources in code point order, null last, have the weights, repeated; no source takes
    more than `max_epochs` times its words. Each row is taken whole as often as its source's target allows; what is left
    comes from rows in the order of a seeded hash of their id, up to the row whose middle lies beyond the target, so that a
    source misses its target by half a document at most. Null and blank texts have size 0 and are taken 0 words. An empty
    table gives an empty result. Rows that share id, source and size may change places, unless `keep` names a column that tells
    them apart; their sum doesn't change.

    The driver gets one row per source. Running sums come in two steps, over 4096 hash ranges of each source and inside
    each range, so that a large source isn't one task's work.
    """
    key = F.concat(F.lit("="), F.col(source_col))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(key, F.lit("")).alias("src"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("h"), *([F.col(keep).alias("keep")] if keep else [])).withColumn("part", F.substring("h", 1, 3)), "mix-sizes")
    sums = sized.groupBy("src", "part").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    totals = {r["source"]: r["size"] for r in sums.groupBy("src").agg(F.sum("size").alias("size"), F.first("source").alias("source")).collect()}
    plan = [("" if s is None else f"={s}", n, t, whole, rest) for s, n, t, whole, rest in source_plan(totals, weights, share, max_epochs)]
    schema = T.StructType([T.StructField("src", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    plans = docs.sparkSession.createDataFrame(plan, schema)
    before = sums.select("src", "part", (F.sum("size").over(Window.partitionBy("src").orderBy("part")) - F.col("size")).alias("before"))
    inside = Window.partitionBy("src", "part").orderBy("h", "doc_id", "size", *["keep"] * bool(keep)).rowsBetween(Window.unboundedPreceding, 0)
    d = sized.withColumn("upto", F.sum("size").over(inside)).join(before, ["src", "part"]).join(plans, "src")
    extra = 2 * (F.col("before") + F.col("upto")) - F.col("size") <= 2 * F.col("rest")
    d = d.withColumn("repeats", F.col("whole") + extra.cast("int"))
    return d.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *([F.col("keep").alias(keep)] if keep else []))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that repeat an id, null too, are rows like others; docs should be
    a stored table (see numbered)."""
    rows, row = numbered(docs)
    take = mix_sources(rows, keep=row, **kw).where("repeats > 0 and size > 0").select(row, F.sequence(F.lit(1), "repeats").alias(f"{row}n"))
    return rows.join(take, row).select(*docs.columns, F.explode(f"{row}n")).select(*docs.columns)
