"""Decision-weight sensitivity: draws, exact crossings, acceptability, variance split and budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions import keyed
from siterank.operators.order import inventory_rank, numbered
from siterank.operators.scoring import CLIMATE, LANDSCAPE, TERRAIN_MODELS, TERRAIN_SCORE

RESIDUAL_TOLERANCE = 1e-9


def summarise_ranks(draws: DataFrame, keys: Sequence[str], score: str | None = None) -> DataFrame:
    """M8: median, 95 % interval and top-set probability of the rank (and score) over the draws of each key."""
    bounds = [0.025, 0.5, 0.975]
    aggregates = [F.percentile("rank", F.array(*map(F.lit, bounds))).alias("_r"),
                  F.avg((F.col("rank") <= 3).cast("int")).alias("probability_top_3"),
                  F.avg((F.col("rank") <= 5).cast("int")).alias("probability_top_5"), F.count(F.lit(1)).alias("draws")]
    if score:
        aggregates.append(F.percentile(score, F.array(*map(F.lit, bounds))).alias("_s"))
    out = draws.groupBy(*keys).agg(*aggregates)
    columns = [F.col("_r")[1].alias("rank_median"), F.col("_r")[0].alias("rank_ci_low_95"), F.col("_r")[2].alias("rank_ci_high_95")]
    if score:
        columns += [F.col("_s")[1].alias("score_median"), F.col("_s")[0].alias("score_ci_low_95"), F.col("_s")[2].alias("score_ci_high_95")]
    return out.select(*keys, *columns, "probability_top_3", "probability_top_5", "draws")


def with_draws(frame: DataFrame, draws: int, column: str = "draw") -> DataFrame:
    """Every row once per draw, spread so that one draw stays within one task."""
    return frame.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def beta_weight_ranks(frame: DataFrame, alphas: Sequence[float] = (0.5, 1.0, 2.0), draws: int = 50_000,
                      seed: int = keyed.SEED) -> DataFrame:
    """M6: ordinal ranks under Beta(alpha, alpha) landscape weights."""
    weight = lambda a: keyed.symmetric_beta(a, f"beta{a}", "draw", seed=seed)
    options = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), weight(a).alias("w")) for a in alphas])
    long = with_draws(frame, draws).select("component_id", "radius_m", LANDSCAPE, TERRAIN_SCORE, "draw", F.explode(options).alias("o"))
    scored = long.select("component_id", "radius_m", "draw", "o.alpha",
                         (F.col("o.w") * F.col(LANDSCAPE) + (1 - F.col("o.w")) * F.col(TERRAIN_SCORE)).alias("score"))
    return scored.withColumn("rank", inventory_rank(["radius_m", "alpha", "draw"], "score", "ordinal", "component_id"))


def dirichlet_ranks(frame: DataFrame, draws: int = 50_000, seed: int = keyed.SEED) -> DataFrame:
    """Ordinal ranks of three domain scores under Dirichlet(1, 1, 1) weights."""
    e = [keyed.exponential(f"dirichlet{i}", "draw", seed=seed) for i in range(3)]
    weighted = with_draws(frame, draws).withColumns({f"_e{i}": x for i, x in enumerate(e)})
    domains = [LANDSCAPE, TERRAIN_SCORE, CLIMATE]
    top = sum((F.col(f"_e{i}") * F.col(c) for i, c in enumerate(domains)), F.lit(0.0))
    scored = weighted.select("component_id", "radius_m", "draw", (top / (F.col("_e0") + F.col("_e1") + F.col("_e2"))).alias("score"))
    return scored.withColumn("rank", inventory_rank(["radius_m", "draw"], "score", "ordinal", "component_id"))


# --- exact weight intervals ------------------------------------------------------------

def weight_breaks(frame: DataFrame) -> DataFrame:
    """Per radius the merged crossings of the score lines, with 0 and 1, as intervals [w_lower, w_upper]."""
    lines = frame.select("radius_m", "component_id", F.col(TERRAIN_SCORE).alias("t"),
                         (F.col(LANDSCAPE) - F.col(TERRAIN_SCORE)).alias("m"))
    a = lines.select("radius_m", F.col("component_id").alias("i"), F.col("t").alias("ti"), F.col("m").alias("mi"))
    b = lines.select("radius_m", F.col("component_id").alias("j"), F.col("t").alias("tj"), F.col("m").alias("mj"))
    gap = F.col("mi") - F.col("mj")
    crossings = (a.join(b, "radius_m").where((F.col("i") < F.col("j")) & (F.abs(gap) > 1e-12))
                 .select("radius_m", ((F.col("tj") - F.col("ti")) / gap).alias("w"))
                 .where((F.col("w") > 1e-10) & (F.col("w") < 1 - 1e-10)))
    ends = lines.select("radius_m").distinct().select("radius_m", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("w"))
    ordered = W.partitionBy("radius_m").orderBy("w")
    merged = (crossings.unionByName(ends).withColumn("_p", F.lag("w").over(ordered))
              .where(F.col("_p").isNull() | (F.col("w") - F.col("_p") > 1e-10)))
    return (merged.select("radius_m", F.col("w").alias("w_lower"), F.lead("w").over(ordered).alias("w_upper"))
            .where(F.col("w_upper").isNotNull()))


def rank_intervals(frame: DataFrame) -> DataFrame:
    """The rank of every component inside every interval (evaluated at the midpoint)."""
    base = frame.select("radius_m", "component_id", LANDSCAPE, TERRAIN_SCORE)
    mid = (F.col("w_lower") + F.col("w_upper")) / 2
    scored = weight_breaks(frame).join(base, "radius_m").withColumn(
        "score", F.col(TERRAIN_SCORE) + mid * (F.col(LANDSCAPE) - F.col(TERRAIN_SCORE)))
    rank = inventory_rank(["radius_m", "w_lower"], "score", "ordinal", "component_id")
    return scored.select("radius_m", "w_lower", "w_upper", "component_id", rank.alias("rank")).withColumn("top3", F.col("rank") <= 3)


TIE, MERGE = 1e-11, 1e-10


def top_levels(t: np.ndarray, m: np.ndarray, order: np.ndarray, low: float, high: float, top: int) -> list[tuple[float, float, np.ndarray]]:
    """The ``top`` highest lines t + w m as w goes from low to high: (from, to, lines by rank), swap by swap.

    Lines that meet at a swap are ordered by slope, then by ``order``. The next swap is where two neighbours of the ranking meet or
    where a lower line reaches the last one, so no pair of lines is looked at otherwise.
    """
    out, w, n, k = [], low, len(t), min(top, len(t))
    while k and w < high:
        s = t + m * w
        near = np.flatnonzero(s >= np.partition(s, n - k)[n - k] - k * TIE)
        near = near[np.argsort(-s[near], kind="stable")]
        level = np.cumsum(np.append(0, -np.diff(s[near]) > TIE))
        best = near[np.lexsort((order[near], -np.round(m[near], 12), level))][:k]
        rise = np.append(m[best[1:]] - m[best[:-1]], m - m[best[-1]])
        fall = np.append(s[best[:-1]] - s[best[1:]], s[best[-1]] - s)
        rise[k - 1 + best] = 0.0
        after = fall[rise > 1e-12] / rise[rise > 1e-12]
        after = after[after > MERGE]
        stop = min(high, w + after.min()) if len(after) else high
        stop = high if high - stop < MERGE else float(stop)
        out.append((w, stop, best))
        w = stop
    return out


def _levels(slab: bool, top: int):
    """One group of lines to the intervals on which each of them is among the highest."""

    def run(key: tuple, lines: pa.Table) -> pa.Table:
        part, parts = (key[1].as_py(), key[2].as_py()) if slab else (0, 1)
        ids = lines.column("component_id").to_pylist()
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        found = top_levels(lines.column("t").to_numpy(), lines.column("m").to_numpy(), order, part / parts, (part + 1) / parts, top)
        rows, held = [], {}
        for low, high, best in found:
            now = {(int(j), k + 1): held.get((int(j), k + 1), low) for k, j in enumerate(best)}
            rows += [(j, rank, start, low) for (j, rank), start in held.items() if (j, rank) not in now]
            held = now
        rows += [(j, rank, start, found[-1][1]) for (j, rank), start in held.items()]
        where = pa.array([r[0] for r in rows], pa.int64())
        fixed = [lines.column(c).take(where) for c in ("radius_m", "component_id", "t", "m")]
        return pa.table([*fixed, *[pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int32()), (2, pa.float64()), (3, pa.float64()))]], names=["radius_m", "component_id", "t", "m", "rank", "w_lower", "w_upper"])

    return run


def top_intervals(frame: DataFrame, top: int = 3, per_bucket: int = 4096) -> DataFrame:
    """The maximal weight intervals on which a component holds each rank up to ``top``; radius_m, component_id, rank, w_lower, w_upper.

    A line among the highest of all is among the highest of any bucket of lines at the same weight. Buckets of lines are swept first, and
    what they leave goes to the slabs of the weight axis where it may count, which are swept again. Only neighbours of
    the running ranking meet, so the work follows the upper envelope and not the pairs. Components without both scores take no rank.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = f"radius_m {kinds['radius_m']}, component_id {kinds['component_id']}, t double, m double, rank int, w_lower double, w_upper double"
    lines = frame.select("radius_m", "component_id", F.col(TERRAIN_SCORE).cast("double").alias("t"), (F.col(LANDSCAPE) - F.col(TERRAIN_SCORE)).cast("double").alias("m")).where(
        F.col("t").isNotNull() & F.col("m").isNotNull())
    parts = lines.groupBy("radius_m").agg(F.ceil(F.count(F.lit(1)) / per_bucket).cast("int").alias("parts"))
    dealt = lines.join(parts, "radius_m").withColumn("part", F.pmod(F.xxhash64("component_id"), F.col("parts")))
    local = dealt.groupBy("radius_m", "part", "parts").applyInArrow(_levels(False, top), schema)
    slabs = local.join(parts, "radius_m").select("radius_m", "component_id", "t", "m", "parts", F.explode(F.sequence(
        F.floor(F.col("w_lower") * F.col("parts")).cast("int"), F.least(F.floor(F.col("w_upper") * F.col("parts")).cast("int"), F.col("parts") - 1))).alias("part")).distinct()
    found = slabs.groupBy("radius_m", "part", "parts").applyInArrow(_levels(True, top), schema)
    line = W.partitionBy("radius_m", "component_id", "rank").orderBy("w_lower")
    joined = found.withColumn("_new", (~F.col("w_lower").eqNullSafe(F.lag("w_upper").over(line))).cast("int"))
    island = joined.withColumn("_g", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("radius_m", "component_id", "rank", "_g").agg(F.min("w_lower").alias("w_lower"), F.max("w_upper").alias("w_upper")).drop("_g")


def leader_intervals(intervals: DataFrame) -> DataFrame:
    """The interval of each leader; an envelope of lines holds each line once."""
    return intervals.where(F.col("rank") == 1).groupBy("radius_m", "component_id").agg(F.min("w_lower").alias("w_lower"), F.max("w_upper").alias("w_upper"))


def uniform_top3_mass(intervals: DataFrame, components: DataFrame) -> DataFrame:
    """M13d: share of the weight axis on which a component is in the top three, for every row of ``components``."""
    width = F.col("w_upper") - F.col("w_lower")
    held = intervals.where(F.col("rank") <= 3).groupBy("radius_m", "component_id").agg(F.sum(width).alias("_held"))
    total = intervals.where(F.col("rank") == 1).groupBy("radius_m").agg(F.sum(width).alias("total_weight_mass"))
    every = components.select("radius_m", "component_id").distinct().join(total, "radius_m").join(held, ["radius_m", "component_id"], "left")
    return every.select("radius_m", "component_id", F.coalesce("_held", F.lit(0.0)).alias("exact_uniform_top3"), "total_weight_mass")


def response_grid(frame: DataFrame, points: int = 1001) -> DataFrame:
    """M13e: ordinal ranks on an even weight grid."""
    w = F.col("g") / F.lit(float(points - 1))
    long = frame.select("radius_m", "component_id", LANDSCAPE, TERRAIN_SCORE, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    scored = long.select("radius_m", "component_id", w.alias("landscape_weight"),
                         (F.col(TERRAIN_SCORE) + w * (F.col(LANDSCAPE) - F.col(TERRAIN_SCORE))).alias("score"))
    return scored.withColumn("rank", inventory_rank(["radius_m", "landscape_weight"], "score", "ordinal", "component_id")).drop("score")


# --- geometry recovery and acceptability -------------------------------------------------

def recover_geometry(draws: DataFrame) -> DataFrame:
    """M9: solve score = w L + (1 - w) T_model per (state, component) by least squares.

    The normal matrix is a diagonal bordered by the L row, so eliminating the T terms
    leaves one scalar equation; everything is sums over the group.
    """
    keys = ["spatial_state_id", "component_id"]
    w, y = F.col("landscape_weight"), F.col("score")
    aggregates = [F.sum(w * w).alias("ww"), F.sum(w * y).alias("wy"), F.countDistinct("terrain_model").alias("n_models")]
    for i, m in enumerate(TERRAIN_MODELS):
        hit = F.col("terrain_model") == m
        part = lambda c: F.sum(F.when(hit, c).otherwise(0.0))
        aggregates += [part((1 - w) * (1 - w)).alias(f"d{i}"), part(w * (1 - w)).alias(f"b{i}"), part((1 - w) * y).alias(f"r{i}")]
    sums = draws.groupBy(*keys).agg(*aggregates)
    span = range(len(TERRAIN_MODELS))
    share = lambda x, i: F.when(F.col(f"d{i}") > 0, F.col(x) / F.col(f"d{i}"))
    pivot = F.col("ww") - sum((F.col(f"b{i}") * share(f"b{i}", i) for i in span), F.lit(0.0))
    rhs = F.col("wy") - sum((F.col(f"b{i}") * share(f"r{i}", i) for i in span), F.lit(0.0))
    solved = sums.withColumn("_pivot", pivot).withColumn("L", F.when(F.col("_pivot") > 1e-9, rhs / F.col("_pivot")))
    return solved.select(*keys, "n_models", "L", *[((F.col(f"r{i}") - F.col(f"b{i}") * F.col("L")) / F.col(f"d{i}")).alias(f"T_{m}") for i, m in enumerate(TERRAIN_MODELS)]
                         ).withColumn("identified", (F.col("n_models") == len(TERRAIN_MODELS)) & F.col("L").isNotNull())


def geometry_residual(draws: DataFrame, geometry: DataFrame) -> DataFrame:
    """Largest absolute residual of each recovered group."""
    keys = ["spatial_state_id", "component_id"]
    t = F.coalesce(*[F.when(F.col("terrain_model") == m, F.col(f"T_{m}")) for m in TERRAIN_MODELS])
    w = F.col("landscape_weight")
    fit = w * F.col("L") + (1 - w) * t
    return draws.join(geometry.where("identified"), keys).groupBy(*keys).agg(F.max(F.abs(F.col("score") - fit)).alias("max_residual"))


def factorial_ranks(geometry: DataFrame, components: Column | int, step_count: int = 200) -> DataFrame:
    """Ranks of all components for each identified state x formulation x grid weight.

    ``components`` is the inventory size; a state missing an identified component is dropped whole.
    """
    complete = geometry.where("identified").withColumn("_have", F.count(F.lit(1)).over(W.partitionBy("spatial_state_id")))
    usable = complete.where(F.col("_have") == components)
    options = F.array(*[F.struct(F.lit(m).alias("terrain_model"), F.col(f"T_{m}").alias("terrain")) for m in TERRAIN_MODELS])
    long = usable.select("spatial_state_id", "component_id", "L", F.explode(options).alias("o")).select(
        "spatial_state_id", "component_id", "L", "o.*", F.explode(F.sequence(F.lit(0), F.lit(step_count))).alias("g"))
    w = F.round(F.col("g") / F.lit(float(step_count)), 6)
    scored = long.withColumn("landscape_weight", w).withColumn("score", F.round(w * F.col("L") + (1 - w) * F.col("terrain"), 9))
    rank = inventory_rank(["spatial_state_id", "terrain_model", "g"], "score", "ordinal", "component_id")
    return scored.select("spatial_state_id", "terrain_model", "g", "landscape_weight", "component_id", rank.alias("rank"))


def acceptability(ranks: DataFrame, step_count: int = 200) -> DataFrame:
    """Rank acceptability, central weight, confidence at the nearest grid weight, formulation shares."""
    first = F.col("rank") == 1
    share = lambda m: F.try_divide(F.sum((first & (F.col("terrain_model") == m)).cast("double")), F.sum(first.cast("double")))
    table = ranks.groupBy("component_id").agg(
        F.avg(first.cast("int")).alias("acceptability_rank1"), F.avg((F.col("rank") <= 3).cast("int")).alias("acceptability_top3"),
        F.avg((F.col("rank") <= 5).cast("int")).alias("acceptability_top5"), F.percentile("rank", F.lit(0.5)).alias("median_rank"),
        F.avg(F.when(first, F.col("g"))).alias("_centre"),
        *[F.coalesce(share(m), F.lit(0.0)).alias(f"first_rank_share_{m}") for m in TERRAIN_MODELS])
    by_weight = ranks.groupBy("component_id", "g").agg(F.avg(first.cast("int")).alias("confidence"))
    nearest = F.ceil(F.round(F.col("_centre"), 9) - F.lit(0.5))
    joined = table.withColumn("g", nearest).join(by_weight, ["component_id", "g"], "left")
    return joined.select(
        "component_id", "acceptability_rank1", "acceptability_top3", "acceptability_top5", "median_rank",
        (F.col("_centre") / F.lit(float(step_count))).alias("central_landscape_weight"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence_factor"), *[f"first_rank_share_{m}" for m in TERRAIN_MODELS])


def variance_split(ranks: DataFrame) -> DataFrame:
    """Share of the rank variance from space, decision, weight, formulation and interaction.

    The design is balanced, so each sum of squares is the variance of a marginal mean.
    """
    def marginal(factors: Sequence[str], name: str) -> DataFrame:
        means = ranks.groupBy("component_id", *factors).agg(F.avg("rank").alias("m"))
        return means.groupBy("component_id").agg(F.var_pop("m").alias(name))

    out = ranks.groupBy("component_id").agg(F.var_pop("rank").alias("rank_variance"))
    for factors, name in ((["spatial_state_id"], "_s"), (["terrain_model", "g"], "_d"), (["g"], "_w"), (["terrain_model"], "_m")):
        out = out.join(marginal(factors, name), "component_id")
    part = lambda c: F.try_divide(F.col(c), F.col("rank_variance"))
    return out.select(
        "component_id", "rank_variance", part("_s").alias("fraction_spatial_support"), part("_d").alias("fraction_decision"),
        part("_w").alias("fraction_landscape_weight"), part("_m").alias("fraction_terrain_formulation"),
        F.try_divide(F.col("rank_variance") - F.col("_s") - F.col("_d"), F.col("rank_variance")).alias("fraction_interaction"))


def weighted_split(split: DataFrame) -> DataFrame:
    """Variance-weighted totals of the split."""
    columns = [c for c in split.columns if c.startswith("fraction_")]
    return split.agg(*[F.try_divide(F.sum(F.col(c) * F.col("rank_variance")), F.sum("rank_variance")).alias(c) for c in columns])


def budget_curve(ranks: DataFrame, top: int = 3) -> DataFrame:
    """Expected misses and full-coverage probability when inspecting in order of top-set acceptability.

    Per scenario only the ``top`` members matter: with their positions in the order, the k-th budget
    covers those at or before k, so the curve comes from counts per position.
    """
    shares = ranks.groupBy("component_id").agg(F.avg((F.col("rank") <= top).cast("int")).alias("a"))
    order = numbered(shares, [F.col("a").desc(), "component_id"], "inspection_budget_k").withColumn("inspection_budget_k", F.col("inspection_budget_k") + 1)
    placed = ranks.where(F.col("rank") <= top).join(order.select("component_id", "inspection_budget_k"), "component_id")
    scenario = placed.groupBy("spatial_state_id", "terrain_model", "g").agg(
        F.max("inspection_budget_k").alias("last"), F.count(F.lit(1)).alias("size"))
    full = scenario.where(F.col("size") == top).groupBy(F.col("last").alias("inspection_budget_k")).agg(F.count(F.lit(1)).alias("full"))
    hits = placed.groupBy("inspection_budget_k").agg(F.count(F.lit(1)).alias("hits"))
    total = scenario.agg(F.count(F.lit(1)))
    each = order.join(full, "inspection_budget_k", "left").join(hits, "inspection_budget_k", "left")
    sums = {"_sf": F.coalesce("full", F.lit(0)).cast("bigint"), "_sh": F.coalesce("hits", F.lit(0)).cast("bigint")}
    curve = numbered(each, ["inspection_budget_k"], "_place", sums).withColumn("_n", total.scalar()).withColumns({"_f": F.col("_sf") / F.col("_n"), "_h": F.col("_sh") / F.col("_n")})
    return curve.select("inspection_budget_k", F.col("component_id").alias("component_added"),
                        (F.lit(top) - F.col("_h")).alias("expected_top3_missed"), F.col("_f").alias("probability_full_coverage"),
                        (F.coalesce("full", F.lit(0)) / F.col("_n")).alias("marginal_coverage_gain"))
