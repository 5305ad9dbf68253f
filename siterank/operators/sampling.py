"""Samples and splits: class caps, outer folds, minimum spacing and design weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions import keyed
from siterank.operators.lineage import materialise
from siterank.operators.order import value_positions
from siterank.operators.raster import around


def capped_sample(df: DataFrame, label: str, ids: Sequence[str], cap: int = 4000, seed: int = keyed.SEED) -> DataFrame:
    """L1: at most ``cap`` rows per class, chosen by keyed hash.

    The cut is the exact hash of the cap-th row of each class, found from bucketed positions, so a class of
    any size is never sorted in one task.
    """
    hashed = df.withColumn("_u", keyed.uniform("cap", *ids, seed=seed))
    cut = value_positions(hashed, [label], "_u").where(F.col("before") < cap).groupBy(label).agg(F.max("value").alias("_cut"))
    return hashed.join(cut, label).where(F.col("_u") <= F.col("_cut")).drop("_u", "_cut")


#: Blocks that one task deals out; larger sets of blocks are dealt in several chunks at once.
CHUNK = 1 << 16


def stratified_folds(df: DataFrame, label: str, block: str, folds: int = 5, seed: int = keyed.SEED, chunk: int = CHUNK) -> DataFrame:
    """L2: block, fold. A block is never split, and folds keep level shares of every class.

    Blocks go one after the other, those with the most uneven class counts first, to the fold whose class shares it
    disturbs least (least growth of the summed squared shares; the first fold on a tie). Only counts per block and class are
    looked at. Chunks of blocks are dealt independently, each from a fold of its own on, so the shares of a fold differ by no more than the
    largest block's share of the class for each chunk.
    """
    counts = materialise(df.groupBy(F.col(block).alias("block"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    sizes = counts.agg(F.ceil(F.count_distinct("block") / chunk).cast("int").alias("chunks"))
    dealt = counts.join(totals, "label").withColumn("chunks", sizes.scalar()).withColumn("chunk", F.pmod(F.xxhash64("block"), F.col("chunks")))
    first = keyed.pick(F.lit(folds), "first_fold", "chunk", seed=seed)
    dealt = dealt.withColumn("first", F.when(F.col("chunks") > 1, first).otherwise(0).cast("int"))
    return dealt.groupBy("chunk").applyInArrow(_deal_blocks(folds), f"block {df.schema[block].dataType.simpleString()}, fold bigint")


def _deal_blocks(folds: int):
    def run(rows: pa.Table) -> pa.Table:
        labels, column_ = np.unique(np.asarray(rows.column("label").to_pylist(), object), return_inverse=True)
        blocks = rows.column("block").to_pylist()
        names = sorted(set(blocks))
        where = {name: i for i, name in enumerate(names)}
        counts = np.zeros((len(names), len(labels)), np.int64)
        counts[[where[b] for b in blocks], column_] = rows.column("n").to_numpy()
        squares = np.ones(len(labels))
        squares[column_] = rows.column("total").to_numpy().astype(float) ** 2
        spread = len(labels) * np.square(counts).sum(1) - np.square(counts.sum(1))
        held, out = np.zeros((folds, len(labels)), np.int64), np.zeros(len(names), np.int64)
        for i in np.lexsort((np.arange(len(names)), -spread)):
            growth = (2 * held * counts[i] + counts[i] * counts[i]) / squares
            cost = np.zeros(folds)
            for k in range(len(labels)):  # in the order of labels, so that every engine adds alike
                cost += growth[:, k]
            out[i] = int(np.argmin(cost))
            held[out[i]] += counts[i]
        first = rows.column("first")[0].as_py()
        return pa.table([pa.array(names, rows.schema.field("block").type), pa.array((out + first) % folds)], names=["block", "fold"])

    return run


def choose_outer_split(df: DataFrame, label: str, block: str, folds: int = 5, seed: int = keyed.SEED) -> DataFrame:
    """L2: score every fold as test side: most classes present on both sides, then the size nearest to an even share, then the first."""
    dealt = stratified_folds(df, label, block, folds, seed)
    rows = df.select(F.col(block).alias("block"), F.col(label).alias(label)).join(dealt, "block")
    counts = materialise(rows.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.withColumns({"_all": F.sum("n").over(W.partitionBy(label)), "_rows": F.sum("n").over(W.partitionBy(F.lit(1)))})
    scored = totals.groupBy("fold").agg(
        F.count(F.lit(1)).alias("classes_in_test"), F.count_if(F.col("n") == F.col("_all")).alias("_missing_in_train"),
        F.sum("n").alias("test_rows"), F.max("_rows").alias("_rows"), F.max(F.abs(F.col("n") / F.col("_all") - 1.0 / folds)).alias("largest_share_gap"))
    classes = counts.agg(F.count_distinct(label))
    out = scored.withColumns({"completeness": F.col("classes_in_test") + classes.scalar() - F.col("_missing_in_train"),
                              "size_penalty": F.abs(F.col("test_rows") / F.col("_rows") - 1.0 / folds)})
    order = W.orderBy(F.col("completeness").desc(), F.round("size_penalty", 12), "fold")
    return out.withColumn("selected", F.row_number().over(order) == 1).select("fold", "test_rows", "completeness", "size_penalty", "largest_share_gap", "selected")


def spread_sample(candidates: DataFrame, strata: Sequence[str], spacing: int, requested: Column | int, seed: int = keyed.SEED) -> DataFrame:
    """L3: up to ``requested`` cells per stratum at Chebyshev distance of at least ``spacing``, filled up if short.

    The greedy choice in hash order is found in rounds. Cells of one tile of side ``spacing`` all exclude each
    other, so only the tile minimum can be chosen; it is chosen once no remaining cell of a neighbouring
    tile both precedes and excludes it. Each round joins every cell with at most nine tile minima.
    """
    strata = list(strata)
    base = candidates.select(*strata, "row", "col").distinct().withColumn("u", keyed.uniform("spread", *strata, "row", "col", seed=seed))
    left = materialise(base.withColumns({"tr": F.floor(F.col("row") / spacing), "tc": F.floor(F.col("col") / spacing)}))
    everyone, chosen = left, None
    near = F.sequence(F.lit(-1), F.lit(1))
    tile = [*strata, "tr", "tc"]
    clash = (F.abs(F.col("row") - F.col("r")) < spacing) & (F.abs(F.col("col") - F.col("c")) < spacing)

    def neighbours(points: DataFrame) -> DataFrame:
        return points.select(*strata, F.col("row").alias("r"), F.col("col").alias("c"), F.col("u").alias("v"), around("tr", near).alias("tr"), F.col("tc").alias("_c")).select(
            *strata, "r", "c", "v", "tr", around("_c", near).alias("tc"))

    while not left.isEmpty():
        lowest = left.groupBy(*tile).agg(F.min(F.struct("u", "row", "col")).alias("m")).select(*tile, "m.*")
        blocked = lowest.join(neighbours(left), tile).where(clash & (F.col("v") < F.col("u"))).select(*strata, "row", "col").distinct()
        picked = materialise(lowest.join(blocked, [*strata, "row", "col"], "left_anti"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        gone = left.join(neighbours(picked), tile).where(clash).select(*strata, "row", "col").distinct()
        left = materialise(left.join(gone, [*strata, "row", "col"], "left_anti"))
    if chosen is None:
        return everyone.select(*strata, "row", "col", F.lit(0).alias("sequence"), F.lit(False).alias("spaced"))
    ranked = everyone.join(chosen.select(*strata, "row", "col", F.lit(0).alias("_second")), [*strata, "row", "col"], "left").withColumn(
        "key", F.coalesce("_second", F.lit(1)) + F.col("u"))
    positions = value_positions(ranked, strata, "key").select(*strata, F.col("value").alias("key"), "before")
    kept = ranked.join(positions, [*strata, "key"]).where(F.col("before") < requested)
    return kept.select(*strata, "row", "col", (F.col("before") + 1).alias("sequence"), F.col("_second").isNotNull().alias("spaced"))


def design_weights(sample: DataFrame, population: DataFrame, strata: Sequence[str]) -> DataFrame:
    """L3: stratum sizes, inclusion probability and weight on every sampled cell."""
    strata = list(strata)
    sizes = population.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_population_pixels_Nh")).join(
        sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_sample_size_nh")), strata)
    n, k = F.col("stratum_population_pixels_Nh"), F.col("stratum_sample_size_nh")
    return sample.join(sizes.withColumns({"inclusion_probability": k / n, "design_weight": n / k}), strata)
