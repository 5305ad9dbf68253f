"""Percentile-based hierarchical scores, ablations, baselines and structural scenarios."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siterank.functions.columns import logistic, mean_of
from siterank.operators.agreement import correlation, rank_change, spearman
from siterank.operators.lineage import materialise
from siterank.operators.order import by_rows, inventory_rank, quantiles, with_percentile, with_ranks

# Fixed names of the six factors and the three domains.
SPECTRAL = {"ndvi_pressure": ("ndvi_median", False), "ndbi_pressure": ("ndbi_median", True),
            "mndwi_pressure": ("mndwi_median", False)}
TERRAIN = {"slope_pressure": ("slope_p90_deg", True), "wetness_pressure": ("twi_proxy_p90", True),
           "drainage_proximity_pressure": ("drainage_distance_median_m", False)}
FACTORS = [*SPECTRAL, *TERRAIN]
TERRAIN_MODELS = ["equal_factors", "correlation_adjusted", "reduced_slope_drainage"]
LANDSCAPE, TERRAIN_SCORE, PRIORITY = "landscape_pressure_score", "terrain_susceptibility_score", "local_priority_score"
CLIMATE, INTEGRATED = "climate_extreme_score", "integrated_exposure_score"


def landscape_score() -> dict[str, Column]:
    surface = mean_of(["ndvi_pressure", "ndbi_pressure"])
    return {"surface_cover_pressure": surface, LANDSCAPE: mean_of([surface, F.col("mndwi_pressure")])}


def fixed_scores(spectral: DataFrame, terrain: DataFrame, last_epoch: str,
                 comparison: dict[str, tuple[str, bool]] | None = None, bounded: bool = False) -> DataFrame:
    """R1 (and R3 through ``comparison``): pressures, domain scores, priority and the last-epoch ordinal rank.

    Spectral percentiles run over all component-epochs of a radius, terrain over all components.
    """
    stage = (lambda df: df) if bounded else materialise
    scored = stage(with_percentile(spectral, ["radius_m"], {**SPECTRAL, **(comparison or {})}, ["component_id", "epoch_id"], bounded))
    static = stage(with_percentile(terrain, ["radius_m"], TERRAIN, ["component_id"], bounded).select(
        "component_id", "radius_m", *TERRAIN, mean_of(list(TERRAIN)).alias(TERRAIN_SCORE)))
    out = scored.withColumns(landscape_score()).join(static if bounded else by_rows(static), ["component_id", "radius_m"], "left")
    out = stage(out.withColumn(PRIORITY, mean_of([LANDSCAPE, TERRAIN_SCORE])))
    ranked = with_ranks(out, ["radius_m", "epoch_id"], PRIORITY, "fixed_rank", "ordinal", tie="component_id", bounded=bounded)
    return ranked.withColumn("fixed_rank", F.when(F.col("epoch_id") == last_epoch, F.col("fixed_rank")))


def integrated_scores(scores: DataFrame, climate_epochs: DataFrame) -> DataFrame:
    """R2: add the climate score of the epoch and the three-domain mean."""
    return scores.join(climate_epochs.select("epoch_id", CLIMATE), "epoch_id", "left").withColumn(
        INTEGRATED, mean_of([LANDSCAPE, TERRAIN_SCORE, CLIMATE]))


def factor_frame(scores: DataFrame, last_epoch: str, radius: int | None = None) -> DataFrame:
    """The factor table of the last epoch, of one radius or of all."""
    keep = F.col("epoch_id") == last_epoch
    if radius is not None:
        keep = keep & (F.col("radius_m") == radius)
    return scores.where(keep).select("component_id", "radius_m", *FACTORS, "surface_cover_pressure", LANDSCAPE,
                                     TERRAIN_SCORE, PRIORITY, *(c for c in (CLIMATE, INTEGRATED) if c in scores.columns))


def compare_alternatives(frame: DataFrame, alternatives: dict[str, Column], reference: Column, label: str,
                         tie: str = "average", bounded: bool = False) -> DataFrame:
    """Rank every alternative per radius and compare it with the reference ranking."""
    options = F.array(*[F.struct(F.lit(n).alias(label), c.cast("double").alias("score")) for n, c in alternatives.items()])
    long = frame.select("radius_m", "component_id", reference.cast("double").alias("_reference"), F.explode(options).alias("o"))
    ranked = long.select("radius_m", "component_id", "_reference", "o.*")
    for value, output in (("_reference", "reference_rank"), ("score", "rank")):
        ranked = with_ranks(ranked, ["radius_m", label], value, output, tie, tie="component_id", bounded=bounded)
        ranked = ranked if bounded else materialise(ranked)
    return rank_change(ranked, ["radius_m", label], "reference_rank", "rank", "component_id", bounded)


def _half(*sides) -> Column:
    return mean_of([s if isinstance(s, (Column, str)) else mean_of(s) for s in sides])


def factor_ablations() -> dict[str, Column]:
    """The nine alternatives of the local score: drop a factor, or keep one domain."""
    n, b, m, s, w, d = FACTORS
    return {
        "Full hierarchy": F.col(PRIORITY),
        "Landscape only": F.col(LANDSCAPE),
        "Terrain only": F.col(TERRAIN_SCORE),
        "Without NDVI": _half([b, m], TERRAIN_SCORE),
        "Without NDBI": _half([n, m], TERRAIN_SCORE),
        "Without MNDWI": _half([n, b], TERRAIN_SCORE),
        "Without slope": _half(LANDSCAPE, [w, d]),
        "Without wetness": _half(LANDSCAPE, [s, d]),
        "Without drainage": _half(LANDSCAPE, [s, w]),
    }


def domain_ablations() -> dict[str, Column]:
    """The fourteen alternatives compared with the integrated three-domain score."""
    n, b, m, s, w, d = FACTORS
    local = mean_of([LANDSCAPE, TERRAIN_SCORE])
    return {
        "Full integrated context": mean_of([LANDSCAPE, TERRAIN_SCORE, CLIMATE]),
        "Primary local priority": local,
        "Landscape only": F.col(LANDSCAPE),
        "Terrain only": F.col(TERRAIN_SCORE),
        "Climate only": F.col(CLIMATE),
        "Leave climate out": local,
        "Leave landscape out": mean_of([TERRAIN_SCORE, CLIMATE]),
        "Leave terrain out": mean_of([LANDSCAPE, CLIMATE]),
        "Leave NDVI out": _half([m, b], TERRAIN_SCORE),
        "Leave MNDWI out": mean_of(["surface_cover_pressure", TERRAIN_SCORE]),
        "Leave NDBI out": _half([m, n], TERRAIN_SCORE),
        "Leave slope out": _half(LANDSCAPE, [w, d]),
        "Leave terrain wetness out": _half(LANDSCAPE, [s, d]),
        "Leave drainage proximity out": _half(LANDSCAPE, [s, w]),
    }


def local_ablations() -> dict[str, Column]:
    """The six ordinal-rank alternatives of the integrated script."""
    n, b, m = FACTORS[:3]
    return {
        "Full local (landscape + terrain)": mean_of([LANDSCAPE, TERRAIN_SCORE]),
        "Landscape only": F.col(LANDSCAPE),
        "Terrain only": F.col(TERRAIN_SCORE),
        "No NDVI": _half([m, b], TERRAIN_SCORE),
        "No MNDWI": mean_of(["surface_cover_pressure", TERRAIN_SCORE]),
        "No NDBI": _half([m, n], TERRAIN_SCORE),
    }


# --- weighting rules -----------------------------------------------------------------

def critic_weights(frame: DataFrame, columns: Sequence[str] = tuple(FACTORS)) -> DataFrame:
    """Contrast times conflict per factor and radius: one aggregation of moments."""
    columns = list(columns)
    info = []
    for a in columns:
        conflict = sum((1 - correlation(a, b) for b in columns if b != a), F.lit(0.0))
        info.append((F.stddev_samp(a) * conflict).alias(a))
    raw = frame.groupBy("radius_m").agg(*info)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return raw.select("radius_m", *[(F.col(c) / total).alias(f"w_{c}") for c in columns])


def entropy_weights(frame: DataFrame, columns: Sequence[str] = tuple(FACTORS)) -> DataFrame:
    """Entropy weights; with s the shifted column sum, H = ln s - sum(x ln x) / s."""
    columns = list(columns)
    lows = frame.groupBy("radius_m").agg(*[F.min(c).alias(f"m_{c}") for c in columns])
    shifted = frame.join(lows, "radius_m").select(
        "radius_m", *[(F.col(c) - F.col(f"m_{c}") + F.lit(1e-12)).alias(c) for c in columns])
    sums = shifted.groupBy("radius_m").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(c) * F.log(c)).alias(f"l_{c}") for c in columns])
    gain = {c: 1 - (F.log(F.col(f"s_{c}")) - F.col(f"l_{c}") / F.col(f"s_{c}")) / F.log("n") for c in columns}
    total = sum(gain.values(), F.lit(0.0))
    return sums.select("radius_m", *[(gain[c] / total).alias(f"w_{c}") for c in columns])


def weighted_sum(columns: Sequence[str] = tuple(FACTORS), prefix: str = "w_") -> Column:
    return sum((F.col(prefix + c) * F.col(c) for c in columns), F.lit(0.0))


def robust_logistic(frame: DataFrame, oriented: dict[str, Column], bounded: bool = False) -> DataFrame:
    """Mean logistic of robust z-scores (median, MAD scaled by 1.4826; a zero MAD counts as 1)."""
    names = list(oriented)
    base = frame.select("radius_m", "component_id", *[c.cast("double").alias(n) for n, c in oriented.items()])
    centre = _medians(base, names, "c_", bounded)
    deviations = base.join(centre, "radius_m").select(
        "radius_m", "component_id", *names, *[F.col(f"c_{n}") for n in names],
        *[F.abs(F.col(n) - F.col(f"c_{n}")).alias(f"d_{n}") for n in names])
    spread = _medians(deviations, [f"d_{n}" for n in names], "m_", bounded)
    z = lambda n: (F.col(n) - F.col(f"c_{n}")) / F.when(F.col(f"m_d_{n}") > 0, F.col(f"m_d_{n}") * 1.4826).otherwise(1.0)
    return deviations.join(spread, "radius_m").select(
        "radius_m", "component_id", mean_of([logistic(z(n)) for n in names]).alias("robust_score"))


def _medians(df: DataFrame, names: Sequence[str], prefix: str, bounded: bool) -> DataFrame:
    long = quantiles(df, ["radius_m"], {n: n for n in names}, {"q": 0.5}, bounded=bounded)
    return long.groupBy("radius_m").agg(*[F.max(F.when(F.col("measure") == n, F.col("q"))).alias(prefix + n) for n in names])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _first_eigenvector(matrix: pd.Series) -> pd.Series:
    """Leading eigenvector of a small symmetric matrix given row by row (fixed size: factors squared)."""
    import numpy as np

    def leading(flat):
        side = int(round(len(flat) ** 0.5))
        values, vectors = np.linalg.eigh(np.asarray(flat, dtype=float).reshape(side, side))
        return vectors[:, int(np.argmax(values))].tolist()

    return matrix.map(leading)


def first_component(frame: DataFrame, columns: Sequence[str] = tuple(FACTORS), bounded: bool = False) -> DataFrame:
    """Oriented first principal component of the standardised factors, per radius.

    The correlation matrix is one distributed aggregation; only its 6 x 6 result meets Python.
    """
    columns = list(columns)
    cells = [F.lit(1.0) if a == b else F.coalesce(correlation(a, b), F.lit(0.0)) for a in columns for b in columns]
    moments = frame.groupBy("radius_m").agg(
        F.array(*cells).alias("matrix"), *[F.avg(c).alias(f"a_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    axis = moments.withColumn("axis", _first_eigenvector("matrix")).drop("matrix")
    score = sum((F.coalesce(F.try_divide(F.col("axis")[i] * (F.col(c) - F.col(f"a_{c}")), F.col(f"s_{c}")), F.lit(0.0)) for i, c in enumerate(columns)), F.lit(0.0))
    scored = frame.join(axis, "radius_m").select("radius_m", "component_id", *columns, score.alias("pc"))
    long = scored.select("radius_m", "pc", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])).alias("o"))
    sign = spearman(long.select("radius_m", "pc", "o.f", "o.v"), ["radius_m", "f"], "pc", "v", bounded).groupBy("radius_m").agg(
        F.when(F.avg("rho") < 0, -1.0).otherwise(1.0).alias("sign"))
    return scored.join(sign, "radius_m").select("radius_m", "component_id", (F.col("pc") * F.col("sign")).alias("pc_score"))


def baseline_comparison(frame: DataFrame, raw_oriented: dict[str, Column] | None = None, bounded: bool = False) -> DataFrame:
    """The hierarchical ranking against eight (or seven) aggregation rules."""
    work = (frame.join(critic_weights(frame), "radius_m")
            .withColumn("critic", F.round(weighted_sum(), 12)).drop(*[f"w_{c}" for c in FACTORS])
            .join(entropy_weights(frame), "radius_m").withColumn("entropy", F.round(weighted_sum(), 12))
            .join(first_component(frame, bounded=bounded), ["radius_m", "component_id"]))
    work = work if bounded else materialise(work)
    rules = {
        "Hierarchical reference": F.col(PRIORITY),
        "Ungrouped equal-factor mean": mean_of(FACTORS),
        "Landscape only": F.col(LANDSCAPE),
        "Terrain only": F.col(TERRAIN_SCORE),
        "CRITIC weighting": F.col("critic"),
        "Entropy weighting": F.col("entropy"),
        "Oriented first principal component": F.round("pc_score", 9),
    }
    if raw_oriented is not None:
        work = work.join(robust_logistic(work, raw_oriented, bounded), ["radius_m", "component_id"])
        rules["Robust-z logistic"] = F.round("robust_score", 12)
    return compare_alternatives(work, rules, F.col(PRIORITY), "baseline", bounded=bounded)


# --- terrain formulations and scenarios ----------------------------------------------

def factor_correlations(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("radius_m",),
                        bounded: bool = False) -> DataFrame:
    """Spearman of every unordered factor pair within the keys."""
    columns = list(columns)
    pairs = [F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a).alias("x"), F.col(b).alias("y"))
             for i, a in enumerate(columns) for b in columns[i + 1:]]
    long = frame.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*")
    return spearman(long, [*keys, "factor_a", "factor_b"], "x", "y", bounded).withColumnRenamed("rho", "spearman_rho")


def redundancy_screen(correlations: DataFrame, limit: float = 0.85) -> DataFrame:
    """Pairs at or beyond the limit with the rule that applies to them."""
    grouped = F.col("factor_a").isin("ndvi_pressure", "ndbi_pressure") & F.col("factor_b").isin("ndvi_pressure", "ndbi_pressure")
    return correlations.where(F.abs("spearman_rho") >= limit).withColumn(
        "decision", F.when(grouped, "group_into_surface_cover").otherwise("exclude_mapped_proxy_keep_for_comparison"))


def terrain_formulations(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal, inverse-correlation and reduced terrain scores within each ``keys`` group.

    The factors of one group are the inventory of one radius or one spatial state.
    """
    keys = list(keys)
    s, w, d = TERRAIN
    ranks = {c: inventory_rank(keys, c, "average", descending=False) for c in TERRAIN}
    ranked = frame.withColumns({f"_r_{c}": x for c, x in ranks.items()})
    pair = lambda a, b: F.abs(correlation(f"_r_{a}", f"_r_{b}"))
    sums = ranked.groupBy(*keys).agg(pair(s, w).alias("_sw"), pair(s, d).alias("_sd"), pair(w, d).alias("_wd"))
    inverse = {
        s: 1 / F.greatest(1 + F.col("_sw") + F.col("_sd"), F.lit(1e-12)),
        w: 1 / F.greatest(1 + F.col("_sw") + F.col("_wd"), F.lit(1e-12)),
        d: 1 / F.greatest(1 + F.col("_sd") + F.col("_wd"), F.lit(1e-12)),
    }
    total = sum(inverse.values(), F.lit(0.0))
    weights = sums.select(*keys, *[(x / total).alias(f"_w_{c}") for c, x in inverse.items()])
    joined = ranked.join(weights, keys)
    adjusted = sum((F.col(f"_w_{c}") * F.col(c) for c in TERRAIN), F.lit(0.0))
    return joined.select(
        *frame.columns, mean_of(list(TERRAIN)).alias("equal_factors"), adjusted.alias("correlation_adjusted"),
        mean_of([s, d]).alias("reduced_slope_drainage"))


def terrain_options() -> Column:
    """The three formulations of a row as (terrain_model, terrain) structs."""
    return F.array(*[F.struct(F.lit(m).alias("terrain_model"), F.col(m).alias("terrain")) for m in TERRAIN_MODELS])


def structural_scenarios(frame: DataFrame, weights: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Radius x formulation x weight scenarios with ordinal ranks."""
    base = terrain_formulations(frame, ["radius_m"])
    long = base.select("component_id", "radius_m", LANDSCAPE, F.explode(terrain_options()).alias("o")).select(
        "component_id", "radius_m", LANDSCAPE, "o.*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("landscape_weight"))
    score = F.round(F.col("landscape_weight") * F.col(LANDSCAPE) + (1 - F.col("landscape_weight")) * F.col("terrain"), 12)
    long = long.withColumn("score", score)
    rank = inventory_rank(["radius_m", "terrain_model", "landscape_weight"], "score", "ordinal", "component_id")
    return long.withColumn("rank", rank).withColumns({"top3": F.col("rank") <= 3, "top5": F.col("rank") <= 5})


def scenario_stability(scenarios: DataFrame) -> DataFrame:
    """Median, range and top-set frequency over scenarios, and the tier rule."""
    out = scenarios.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("scenarios"), F.percentile("rank", F.lit(0.5)).alias("median_rank"),
        F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"),
        F.avg(F.col("top3").cast("int")).alias("top3_frequency"), F.avg(F.col("top5").cast("int")).alias("top5_frequency"))
    tier = (F.when(F.col("top3_frequency") >= 0.5, "Tier 1: robust high priority")
            .when(F.col("top5_frequency") >= 0.5, "Tier 2: conditional high priority")
            .otherwise("Tier 3: routine/uncertain priority"))
    return out.withColumn("inspection_tier", tier)


def scale_sensitivity(scores: DataFrame, bounded: bool = False) -> DataFrame:
    """Every ordered pair of radii compared over the components they share."""
    ranked = with_ranks(scores, ["radius_m"], PRIORITY, "rank", "average", bounded=bounded).select("component_id", "radius_m", "rank")
    ranked = ranked if bounded else materialise(ranked)
    left = ranked.select("component_id", F.col("radius_m").alias("radius_a_m"), F.col("rank").alias("rank_a"))
    right = ranked.select("component_id", F.col("radius_m").alias("radius_b_m"), F.col("rank").alias("rank_b"))
    return rank_change(left.join(right, "component_id"), ["radius_a_m", "radius_b_m"], "rank_a", "rank_b", "component_id", bounded)
