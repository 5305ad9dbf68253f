"""Resampled rankings: block bootstraps, displacement and the joint design.

A draw is a row key. Discs are cut out once (or once per displaced point), block summaries shrink them
before the draws multiply, and every window stays inside one draw and one component inventory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions import keyed
from siterank.functions.columns import mean_of
from siterank.operators.order import inventory_percentile, inventory_rank
from siterank.operators.raster import disc_join, lonlat_disc_cells
from siterank.operators.scoring import LANDSCAPE, SPECTRAL, TERRAIN, TERRAIN_MODELS, TERRAIN_SCORE, landscape_score, terrain_formulations

SPECTRAL_INDICES = ["ndvi", "ndbi", "mndwi"]
BLOCK_SIZES = [90, 150, 300]
JOINT_DISPLACEMENT = 120.0


def with_block(joined: DataFrame, size_m: Column | float, cell_m: float, width: int) -> DataFrame:
    """P18 on a column of block sizes."""
    size = size_m if isinstance(size_m, Column) else F.lit(float(size_m))
    k = F.greatest(F.lit(1), F.round(size / cell_m).cast("bigint"))
    block = F.floor(F.col("row") / k) * F.ceil(F.lit(float(width)) / k) + F.floor(F.col("col") / k)
    return joined.withColumn("block", block.cast("bigint"))


def block_summary(joined: DataFrame, keys: Sequence[str], values: Sequence[str] = tuple(SPECTRAL_INDICES)) -> DataFrame:
    """Cells and medians per (keys, block); a block holds at most (size / cell)^2 cells."""
    return joined.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("cells"), *[F.percentile(v, F.lit(0.5)).alias(v) for v in values])


def spectral_draw_scores(medians: DataFrame, draw_keys: Sequence[str]) -> DataFrame:
    """Pressures and landscape score ranked over the components of one draw (not over all epochs)."""
    pressures = {out: inventory_percentile(draw_keys, c, high) for out, (c, high) in SPECTRAL.items()}
    return medians.withColumns(pressures).withColumns(landscape_score())


def terrain_draw_pressures(metrics: DataFrame, draw_keys: Sequence[str]) -> DataFrame:
    return metrics.withColumns({out: inventory_percentile(draw_keys, c, high) for out, (c, high) in TERRAIN.items()})


def independent_block_bootstrap(cells: DataFrame, fixed_terrain: DataFrame, draws: int = 2000, seed: int = keyed.SEED) -> DataFrame:
    """M3: blocks resampled per component, pooled cell medians, average ranks with the terrain held fixed.

    Pooling drawn blocks is the same as weighting each cell by how often its block was drawn, so the cells
    of a component are one compact array row and a draw only carries block multiplicities.
    """
    per_block = cells.groupBy("component_id", "block").agg(F.collect_list(F.struct(*SPECTRAL_INDICES)).alias("cells"))
    order = W.partitionBy("component_id").orderBy("block")
    indexed = per_block.withColumns({"slot": F.row_number().over(order) - 1, "blocks": F.count(F.lit(1)).over(W.partitionBy("component_id"))})
    sizes = indexed.select("component_id", "blocks").distinct()
    picks = sizes.select("component_id", "blocks", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(
        "component_id", "draw", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("k")).select(
        "component_id", "draw", keyed.pick(F.col("blocks"), "blocks", "component_id", "draw", "k", seed=seed).alias("slot"))
    times = picks.groupBy("component_id", "draw", "slot").agg(F.count(F.lit(1)).alias("times"))
    pooled = times.join(indexed.select("component_id", "slot", "cells"), ["component_id", "slot"]).select(
        "component_id", "draw", "times", F.explode("cells").alias("c"))
    medians = pooled.groupBy("component_id", "draw").agg(
        *[F.percentile(f"c.{v}", F.lit(0.5), F.col("times")).alias(f"{v}_median") for v in SPECTRAL_INDICES])
    scored = spectral_draw_scores(medians, ["draw"]).join(fixed_terrain.select("component_id", TERRAIN_SCORE), "component_id")
    scored = scored.withColumn("score", mean_of([LANDSCAPE, TERRAIN_SCORE]))
    return scored.select("component_id", "draw", "score", inventory_rank(["draw"], "score", "average").alias("rank"))


def weighted_block_medians(summary: DataFrame, draw_keys: Sequence[str], seed: int = keyed.SEED) -> DataFrame:
    """M4: one unit-exponential weight per (draw, block) shared by all components, times the cell count; the
    weighted median is the first block median at which the running weight reaches half."""
    draw_keys = list(draw_keys)
    weight = keyed.exponential("shared", *draw_keys, "block", seed=seed) * F.col("cells")
    long = summary.withColumn("_w", weight).select(
        *draw_keys, "component_id", "_w", F.explode(F.array(*[F.struct(F.lit(v).alias("f"), F.col(v).alias("v")) for v in SPECTRAL_INDICES])).alias("o"))
    long = long.select(*draw_keys, "component_id", "_w", "o.f", "o.v").where(F.col("v").isNotNull() & (F.col("_w") > 0))
    group = W.partitionBy(*draw_keys, "component_id", "f")
    run = F.sum("_w").over(group.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    reached = long.withColumns({"_run": run, "_all": F.sum("_w").over(group)}).where(F.col("_run") >= 0.5 * F.col("_all"))
    return reached.groupBy(*draw_keys, "component_id").agg(
        *[F.min(F.when(F.col("f") == v, F.col("v"))).alias(f"{v}_median") for v in SPECTRAL_INDICES])


def shared_block_bootstrap(joined: DataFrame, fixed_terrain: DataFrame, cell_m: float, width: int, sizes: Sequence[int] = tuple(BLOCK_SIZES),
                           draws: int = 2000, seed: int = keyed.SEED) -> DataFrame:
    """M4 over several block sizes with ordinal ranks."""
    sized = joined.withColumn("block_size_m", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    blocks = block_summary(with_block(sized, F.col("block_size_m"), cell_m, width), ["block_size_m", "component_id"])
    drawn = blocks.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    medians = weighted_block_medians(drawn, ["block_size_m", "draw"], seed)
    scored = spectral_draw_scores(medians, ["block_size_m", "draw"]).join(fixed_terrain.select("component_id", TERRAIN_SCORE), "component_id")
    scored = scored.withColumn("score", mean_of([LANDSCAPE, TERRAIN_SCORE]))
    return scored.select("block_size_m", "draw", "component_id", "score",
                         inventory_rank(["block_size_m", "draw"], "score", "ordinal", "component_id").alias("rank"))


def displaced(points: DataFrame, reach: Column, draw_keys: Sequence[str], seed: int = keyed.SEED) -> DataFrame:
    """Points moved uniformly inside a disc of the given reach, in both coordinate systems."""
    angle = keyed.uniform("angle", *draw_keys, "component_id", seed=seed) * F.lit(6.283185307179586)
    distance = reach * F.sqrt(keyed.uniform("distance", *draw_keys, "component_id", seed=seed))
    moved = points.withColumns({"_dx": distance * F.cos(angle), "_dy": distance * F.sin(angle)})
    return moved.withColumns({
        "x": F.col("x") + F.col("_dx"), "y": F.col("y") + F.col("_dy"),
        "longitude": F.col("longitude") + F.col("_dx") / (111320.0 * F.cos(F.radians("latitude"))),
        "latitude": F.col("latitude") + F.col("_dy") / 111132.0}).drop("_dx", "_dy")


def terrain_metrics(points: DataFrame, terrain_cells: DataFrame, radius: int, lat0: float, lon0: float, step: float, keys: Sequence[str]) -> DataFrame:
    """The three terrain summaries of every (displaced) point; a disc holds a fixed number of cells."""
    joined = lonlat_disc_cells(points, [radius], lat0, lon0, step, keys).join(terrain_cells, ["row", "col"])
    return joined.groupBy(*keys).agg(
        F.round(F.percentile("slope", F.lit(0.9)), 9).alias("slope_p90_deg"), F.round(F.percentile("wetness", F.lit(0.9)), 9).alias("twi_proxy_p90"),
        F.round(F.percentile("drainage_distance", F.lit(0.5)), 9).alias("drainage_distance_median_m"))


def displacement_ranks(points: DataFrame, cells: DataFrame, terrain_cells: DataFrame, radius: int, grid: tuple[float, float, float],
                       lonlat: tuple[float, float, float], reaches: Sequence[int] = (0, 30, 60, 120), draws: int = 2000,
                       seed: int = keyed.SEED) -> DataFrame:
    """M5: spectral and terrain summaries re-extracted around displaced points; reach 0 is one draw."""
    located = points.where(F.col("x").isNotNull())
    plan = F.array(*[F.struct(F.lit(int(r)).alias("reach_m"), F.lit(1 if r == 0 else draws).alias("n")) for r in reaches])
    drawn = located.withColumn("_p", F.explode(plan)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_p.n") - 1))).withColumn("reach_m", F.col("_p.reach_m")).drop("_p")
    keys = ["reach_m", "draw"]
    moved = displaced(drawn, F.col("reach_m"), keys, seed)
    each = [*keys, "component_id"]
    spectral = disc_join(moved, cells, [radius], *grid, each).groupBy(*each).agg(
        *[F.percentile(v, F.lit(0.5)).alias(f"{v}_median") for v in SPECTRAL_INDICES])
    terrain = terrain_metrics(moved, terrain_cells, radius, *lonlat, each)
    scored = spectral_draw_scores(spectral, keys).join(
        terrain_draw_pressures(terrain, keys).withColumn(TERRAIN_SCORE, mean_of(list(TERRAIN))).select(*each, TERRAIN_SCORE), each)
    scored = scored.withColumn("score", mean_of([LANDSCAPE, TERRAIN_SCORE]))
    return scored.select(*each, "score", inventory_rank(keys, "score", "ordinal", "component_id").alias("rank"))


def joint_draws(points: DataFrame, cells: DataFrame, terrain_cells: DataFrame, radius: int, grid: tuple[float, float, float],
                lonlat: tuple[float, float, float], width: int, states: int = 500, decisions: int = 10, sizes: Sequence[int] = tuple(BLOCK_SIZES),
                reach: float = JOINT_DISPLACEMENT, alpha: float = 1.0, seed: int = keyed.SEED) -> DataFrame:
    """M7: spatial states (block size, displacement, shared weights, re-extraction) times decision settings.

    The weight is Beta(alpha, alpha), uniform by default; formulation weights are recomputed in every state.
    """
    located = points.where(F.col("x").isNotNull())
    state = located.withColumn("spatial_state_id", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    options = F.array(*[F.lit(int(s)) for s in sizes])
    state = state.withColumn("block_size_m", F.element_at(options, keyed.pick(F.lit(len(sizes)), "size", "spatial_state_id", seed=seed).cast("int") + 1))
    moved = displaced(state, F.lit(float(reach)), ["spatial_state_id"], seed)
    keys = ["spatial_state_id", "block_size_m"]
    each = [*keys, "component_id"]
    joined = disc_join(moved, cells, [radius], *grid, each)
    blocks = block_summary(with_block(joined, F.col("block_size_m"), grid[2], width), each)
    spectral = spectral_draw_scores(weighted_block_medians(blocks, keys, seed), keys).select(*each, LANDSCAPE)
    pressures = terrain_draw_pressures(terrain_metrics(moved, terrain_cells, radius, *lonlat, each), keys)
    models = terrain_formulations(pressures.select(*each, *TERRAIN), keys).select(*each, *TERRAIN_MODELS)
    both = spectral.join(models, each).withColumn("decision_setting_id", F.explode(F.sequence(F.lit(0), F.lit(decisions - 1))))
    setting = ["spatial_state_id", "decision_setting_id"]
    model = F.element_at(F.array(*[F.lit(m) for m in TERRAIN_MODELS]), keyed.pick(F.lit(3), "model", *setting, seed=seed).cast("int") + 1)
    both = both.withColumns({"landscape_weight": keyed.symmetric_beta(alpha, "weight", *setting, seed=seed), "terrain_model": model})
    terrain = F.coalesce(*[F.when(F.col("terrain_model") == m, F.col(m)) for m in TERRAIN_MODELS])
    scored = both.withColumn("score", F.round(F.col("landscape_weight") * F.col(LANDSCAPE) + (1 - F.col("landscape_weight")) * terrain, 12))  # equal scores tie, whatever the order of their sums
    rank = inventory_rank(setting, "score", "ordinal", "component_id")
    return scored.select(*setting, "block_size_m", F.lit(float(reach)).alias("maximum_displacement_m"), "landscape_weight", "terrain_model",
                         "component_id", "score", rank.alias("rank")).withColumns({"top3": F.col("rank") <= 3, "top5": F.col("rank") <= 5})
