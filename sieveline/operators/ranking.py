"""Ranks and running counts of any number of rows, without one task per group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.session import shared_dir

_PART = "sieveline_part"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/sieveline/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_count(df: DataFrame, keys: list[str], order: list[str], out: str, counted: Column | None = None) -> DataFrame:
    """Add the number of rows (of those `counted`) before each row, in `order` among the rows of its keys.

    Rows are dealt by ranges of keys and order; ranges of one key number their own rows and add what earlier ranges hold, so a
    key's rows spread over as many tasks as they fill. Equal orders are numbered in any order.
    """
    one = (F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)).cast("long")
    dealt = stored(df.withColumn("sieveline_one", one).repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, _PART).agg(F.sum("sieveline_one").alias("n"))
    earlier = sums.select(*keys, _PART, (F.sum("n").over(Window.partitionBy(*keys).orderBy(_PART)) - F.col("n")).alias("sieveline_before"))
    inside = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("sieveline_local", F.sum("sieveline_one").over(inside) - F.col("sieveline_one"))
    both = local.join(earlier, [*keys, _PART])
    return both.withColumn(out, F.col("sieveline_before") + F.col("sieveline_local")).drop(_PART, "sieveline_one", "sieveline_before", "sieveline_local")
