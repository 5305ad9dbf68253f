"""Connected components by alternating large-star and small-star steps, with a written table between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, label): every node of ``edges`` (u, v) with the smallest node of its component.

    Each step is an aggregate of minima and an equi-join, so the edges of a large star are never gathered in one row. Null
    ends and loops are dropped; no edges give an empty table.
    """
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionAll(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small)
        seen = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38)"))).first()
        scratch.drop(now, large)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select("v", "v").distinct())
