"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, save


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links (a, b): the smallest id that it is linked to, directly or not.

    Each round hangs neighbours under the smallest one they know, so a chain's depth falls geometrically and the number of
    links never grows. Rounds end when none changes anything. Links with a null end are ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")
    e = save(ends.where("u != v").distinct(), "links")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(e)
        e = after
