"""Pixels and cells: compositing, coverage, disc joins, endpoint change, classes and class maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions.columns import (BANDS, HARMONISED_PLATFORM, INDICES, clear_pixel, harmonised, nested_levels, normalised_differences, physical,
                                        reflectance, strict_clear_pixel)
from siterank.operators.order import by_rows, quantiles, quantiles_wide

MINIMUM_OBSERVATIONS, PREFERRED_OBSERVATIONS = 3, 5
SCENE_CLEAR_FLOOR = 0.05
CONVERGENCE = {"ndvi": (0.20, False), "mndwi": (0.20, False), "ndbi": (0.80, True)}


def screened_pixels(pixels: DataFrame) -> DataFrame:
    """Valid and strictly valid flags from QA bits and the physical range of all six bands."""
    inside = physical([reflectance(b) for b in BANDS])
    return pixels.withColumns({"valid": clear_pixel() & inside, "strict_valid": strict_clear_pixel() & inside})


def scene_audit(screened: DataFrame, floor: float = SCENE_CLEAR_FLOOR) -> DataFrame:
    """Clear share per scene and whether it is retained."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = screened.groupBy("epoch_id", "scene_id", "platform").agg(
        share("valid").alias("valid_share"), share("strict_valid").alias("strict_share"), F.count(F.lit(1)).alias("pixels"))
    return out.withColumn("retained", F.col("valid_share") >= floor)


def composite(screened: DataFrame, retained: DataFrame, minimum: int = MINIMUM_OBSERVATIONS) -> DataFrame:
    """Per-pixel band medians of retained scenes, native and harmonised indices, observation counts.

    Medians are taken over integer digital numbers: a band has at most 65,536 distinct values, which bounds
    the aggregation buffer of any pixel, and the linear scaling commutes with the median.
    """
    keep = retained.where("retained").select("epoch_id", "scene_id")
    platforms = retained.where("retained").groupBy("epoch_id").agg(
        (F.collect_set("platform") == F.array(F.lit(HARMONISED_PLATFORM))).alias("_only"))
    pixels = screened.join(keep, ["epoch_id", "scene_id"], "left_semi")
    medians = pixels.groupBy("epoch_id", "row", "col").agg(
        *[F.percentile(F.when(F.col("valid"), F.col(b)), F.lit(0.5)).alias(f"_{b}") for b in BANDS],
        F.count_if("valid").alias("observations"), F.count_if("strict_valid").alias("strict_observations"))
    enough = F.col("observations") >= minimum
    native = medians.withColumns({f"native_{b}": F.when(enough, reflectance(f"_{b}")) for b in BANDS}).join(platforms, "epoch_id", "left")
    common = native.withColumns({f"common_{b}": harmonised(b, F.col(f"native_{b}"), F.coalesce(F.col("_only"), F.lit(False))) for b in BANDS})
    return common.select(
        "epoch_id", "row", "col", "observations", "strict_observations", *[f"native_{b}" for b in BANDS], *[f"common_{b}" for b in BANDS],
        *[c.alias(n) for n, c in normalised_differences("common_").items()],
        *[c.alias(f"native_{n}") for n, c in normalised_differences("native_").items()])


def coverage_audit(cells: DataFrame, grid_cells: Column | int, minimum: int = MINIMUM_OBSERVATIONS, preferred: int = PREFERRED_OBSERVATIONS) -> DataFrame:
    """Share of the whole grid with enough, preferred and strictly enough observations.

    Observation counts are small integers, so their median comes from the counts per value.
    """
    counts = cells.groupBy("epoch_id", "observations").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("strict_observations") >= minimum).alias("s"))
    percent = lambda c: c * 100.0 / grid_cells
    when = lambda limit: F.sum(F.when(F.col("observations") >= limit, F.col("n")).otherwise(0))
    out = counts.groupBy("epoch_id").agg(
        percent(when(minimum)).alias("eligible_percent"), percent(when(preferred)).alias("preferred_percent"), percent(F.sum("s")).alias("strict_percent"),
        F.min("observations").alias("observations_min"), F.percentile("observations", F.lit(0.5), F.col("n")).alias("observations_median"),
        F.max("observations").alias("observations_max"))
    return out.withColumn("coverage_check", F.when(F.col("eligible_percent") >= 90.0, "PASS").otherwise("FAIL"))


def around(base: str | Column, offsets: Column) -> Column:
    """One row per offset from the base value."""
    base = F.col(base) if isinstance(base, str) else base
    return F.explode(F.transform(offsets, lambda o: base + o))


# --- disc join -----------------------------------------------------------------------

def disc_cells(points: DataFrame, radii: Sequence[int], xmin: float, ymax: float, cell: float, keys: Sequence[str] = ("component_id",)) -> DataFrame:
    """Every cell whose centre lies within a radius of a point, as (keys, radius_m, row, col).

    A point with no location yields nothing. Only the candidate window of the largest radius is expanded,
    so a point costs a fixed number of rows and the cells then meet it by an equi join.
    """
    half = int(max(radii) // cell) + 2
    offsets = F.sequence(F.lit(-half), F.lit(half))
    at = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    at = at.select(*keys, "x", "y", F.floor((F.col("x") - xmin) / cell).alias("_c"), F.floor((F.lit(ymax) - F.col("y")) / cell).alias("_r"))
    window = at.select(*keys, "x", "y", "_c", around("_r", offsets).alias("row")).select(
        *keys, "x", "y", "row", around("_c", offsets).alias("col")).where((F.col("row") >= 0) & (F.col("col") >= 0))
    dx = F.lit(xmin) + (F.col("col") + 0.5) * cell - F.col("x")
    dy = F.lit(ymax) - (F.col("row") + 0.5) * cell - F.col("y")
    reached = nested_levels(F.col("_d2"), {int(r): float(r * r) for r in radii})
    return window.withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= max(radii) ** 2).select(
        *keys, "row", "col", F.explode(reached).alias("radius_m"))


TILE = ["_ty", "_tx"]


def disc_join(points: DataFrame, cells: DataFrame, radii: Sequence[int], xmin: float, ymax: float, cell: float,
              keys: Sequence[str] = ("component_id",)) -> DataFrame:
    """The columns of every cell within a radius of a point, with keys, radius_m and the point's tile.

    A point lies in one tile; cells go to their tile and to those they border within the largest radius. All cells of a point meet
    it in one task, so groups by keys and tile need no exchange. The sides are merged: statistics do not see how far they unfold.
    """
    reach = int(max(radii) // cell) + 2
    side = 4 * reach
    at = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, "x", "y", F.floor((F.lit(ymax) - F.col("y")) / cell / side).alias("_ty"), F.floor((F.col("x") - xmin) / cell / side).alias("_tx"))
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    dealt = cells.where((F.col("row") >= 0) & (F.col("col") >= 0)).withColumn("_ty", tiles("row")).withColumn("_tx", tiles("col"))
    dx = F.lit(xmin) + (F.col("col") + 0.5) * cell - F.col("x")
    dy = F.lit(ymax) - (F.col("row") + 0.5) * cell - F.col("y")
    reached = nested_levels(F.col("_d2"), {int(r): float(r * r) for r in radii})
    met = by_rows(at).join(dealt, TILE).withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= max(radii) ** 2)
    return met.withColumn("radius_m", F.explode(reached)).drop("x", "y", "_d2")


def by_place(points: DataFrame, summarise: Callable[[DataFrame, list[str]], DataFrame], keys: Sequence[str] = ("component_id",)) -> DataFrame:
    """``summarise(points, extra)`` with the tile as extra grouping columns, for keys with one place; keys with several places pool them."""
    counted = points.withColumn("_places", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    part = lambda condition: counted.where(condition).drop("_places")
    return summarise(part("_places = 1"), TILE).drop(*TILE).unionByName(summarise(part("_places > 1"), []))


def lonlat_disc_cells(points: DataFrame, radii: Sequence[int], lat0: float, lon0: float, step: float, keys: Sequence[str] = ("component_id",)) -> DataFrame:
    """As ``disc_cells`` on a longitude-latitude grid with the metric scale of the point's own latitude."""
    scale_x, scale_y = 111320.0, 111132.0
    half_y = int(max(radii) / (scale_y * step)) + 2
    at = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select(*keys, "longitude", "latitude")
    metre_x = scale_x * F.cos(F.radians("latitude"))
    half_x = F.ceil(F.lit(float(max(radii))) / (metre_x * step)).cast("int") + 2
    rows = at.select("*", around(F.round((F.lit(lat0) - F.col("latitude")) / step).cast("bigint"), F.sequence(F.lit(-half_y), F.lit(half_y))).alias("row"))
    window = rows.select("*", around(F.round((F.col("longitude") - lon0) / step).cast("bigint"), F.sequence(-half_x, half_x)).alias("col"))
    window = window.where((F.col("row") >= 0) & (F.col("col") >= 0))
    dx = (F.lit(lon0) + F.col("col") * step - F.col("longitude")) * metre_x
    dy = (F.lit(lat0) - F.col("row") * step - F.col("latitude")) * scale_y
    reached = nested_levels(F.col("_d2"), {int(r): float(r * r) for r in radii})
    return window.withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= max(radii) ** 2).select(
        *keys, "row", "col", F.explode(reached).alias("radius_m"))


def neighbourhood_summary(joined: DataFrame, keys: Sequence[str], indices: Sequence[str] = tuple(INDICES), bounded: bool = False, weight: str | None = None) -> DataFrame:
    """A1: valid cells, median and 10 / 90 % quantiles of every index. A disc is ``bounded`` by its radius."""
    wide = quantiles_wide(joined, keys, {i: i for i in indices}, {"median": 0.5, "p10": 0.1, "p90": 0.9}, weight, bounded)
    return wide.withColumnRenamed(f"{indices[0]}_n", "valid_cells").drop(*[f"{i}_n" for i in indices[1:]])


def class_shares(joined: DataFrame, keys: Sequence[str], column: str = "lc_class", classes: Sequence[int] = range(1, 7)) -> DataFrame:
    """A2: share of each class among classified cells, NULL where none is classified."""
    classified = F.count_if(F.col(column) > 0)
    return joined.groupBy(*keys).agg(
        classified.alias("classified_cells"),
        *[F.try_divide(F.count_if(F.col(column) == k), classified).alias(f"lc_class_{k}_share") for k in classes])


# --- endpoint change -----------------------------------------------------------------

def endpoint_deltas(valid_cells: DataFrame, first: str, last: str, indices: Sequence[str] = ("ndvi", "ndbi", "mndwi")) -> DataFrame:
    """Last minus first epoch on cells valid in both, by one conditional aggregation."""
    both = valid_cells.where(F.col("epoch_id").isin(first, last)).groupBy("row", "col").agg(
        *[F.max(F.when(F.col("epoch_id") == e, F.col(i))).alias(f"_{i}_{s}") for i in indices for s, e in (("a", first), ("b", last))])
    present = F.lit(True)
    for i in indices:
        present = present & F.col(f"_{i}_a").isNotNull() & F.col(f"_{i}_b").isNotNull()
    return both.where(present).select("row", "col", *[(F.col(f"_{i}_b") - F.col(f"_{i}_a")).alias(f"d_{i}") for i in indices])


def tail_thresholds(deltas: DataFrame, tails: Sequence[float] = (0.20,), bounded: bool = False) -> DataFrame:
    """Adverse-tail thresholds of each delta for each tail share, one row per share."""
    names = {f"q{int(round(q * 1000))}": q for q in tails} | {f"q{int(round((1 - q) * 1000))}": 1 - q for q in tails}
    wide = quantiles_wide(deltas, [], {i: f"d_{i}" for i in CONVERGENCE}, names, bounded=bounded)
    at = lambda i, q: F.col(f"{i}_q{int(round(q * 1000))}")
    rows = [F.struct(F.lit(float(q)).alias("tail"), *[at(i, 1 - q if high else q).alias(f"limit_{i}") for i, (_, high) in CONVERGENCE.items()]) for q in tails]
    return wide.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def convergence(deltas: DataFrame, limits: DataFrame) -> DataFrame:
    """A4: number of adverse criteria met per cell (0-3), for every tail row of ``limits``."""
    packed = limits.agg(F.collect_list(F.struct(*limits.columns)).alias("l"))
    tagged = deltas.withColumn("_l", F.explode(packed.scalar()))
    score = F.lit(0)
    for i, (_, high) in CONVERGENCE.items():
        limit = F.col(f"_l.limit_{i}")
        score = score + (F.col(f"d_{i}") >= limit if high else F.col(f"d_{i}") <= limit).cast("int")
    return tagged.withColumns({"tail": F.col("_l.tail"), "convergence": score}).drop("_l")


def convergence_counts(cells: DataFrame) -> DataFrame:
    """A4: cells and shares at or above each count; R13: expectation if the criteria were independent."""
    h = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    totals = cells.groupBy("tail", "convergence").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    out = totals.groupBy("tail", "h").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("convergence") >= F.col("h"), F.col("n")).otherwise(0)).alias("cells"),
                                          F.sum(F.col("convergence") * F.col("n")).alias("_met"))
    p = F.col("tail")
    at_least = (F.when(F.col("h") == 1, 1 - F.pow(1 - p, F.lit(3.0))).when(F.col("h") == 2, 3 * p * p * (1 - p) + p * p * p).otherwise(p * p * p))
    return out.select("tail", F.col("h").alias("criteria_met_at_least"), F.col("support").alias("common_support_cells"), "cells",
                      (F.col("cells") / F.col("support")).alias("observed_share"), at_least.alias("expected_share_under_independence"),
                      (F.col("cells") / F.col("support") / at_least).alias("ratio_observed_to_expected"),
                      (F.col("_met") / (3 * F.col("support"))).alias("marginal_rate"))


def hotspots(joined: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """A5: share of cells at two and three criteria, and the median deltas."""
    shares = [F.count(F.lit(1)).alias("valid_cells"), F.avg((F.col("convergence") >= 2).cast("int")).alias("share_c_ge_2"),
              F.avg((F.col("convergence") == 3).cast("int")).alias("share_c_eq_3")]
    if bounded:
        return joined.groupBy(*keys).agg(*shares, *[F.percentile(f"d_{i}", F.lit(0.5)).alias(f"d_{i}_median") for i in CONVERGENCE])
    medians = quantiles_wide(joined, keys, {f"d_{i}": f"d_{i}" for i in CONVERGENCE}, {"median": 0.5}, bounded=bounded)
    return joined.groupBy(*keys).agg(*shares).join(medians.drop(*[f"d_{i}_n" for i in CONVERGENCE]), list(keys))


def common_support(joined_all: DataFrame, epochs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per component the cells seen, those valid in every epoch and the valid share per epoch.

    ``joined_all`` carries ``is_valid`` per (keys, row, col, epoch).
    """
    cells = joined_all.groupBy(*keys, "row", "col").agg(
        F.count_if("is_valid").alias("_v"), *[F.max(F.when(F.col("epoch_id") == e, F.col("is_valid").cast("int")).otherwise(0)).alias(f"_{e}") for e in epochs])
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support_cells"), F.count_if(F.col("_v") == len(epochs)).alias("all_epoch_valid_cells"),
        F.avg((F.col("_v") == len(epochs)).cast("int")).alias("all_epoch_valid_share"), *[F.avg(f"_{e}").alias(f"valid_share_{e}") for e in epochs])


def harmonisation_sensitivity(native: DataFrame, common: DataFrame, keys: Sequence[str], indices: Sequence[str], bounded: bool = False) -> DataFrame:
    """Endpoint deltas under both representations compared per radius and index."""
    from siterank.operators.agreement import spearman

    side = lambda df, s: df.select(*keys, "radius_m", *[F.col(f"d_{i}_median").alias(f"{i}_{s}") for i in indices])
    both = side(native, "a").join(side(common, "b"), [*keys, "radius_m"])
    long = both.select("radius_m", F.explode(F.array(*[F.struct(F.lit(i).alias("index"), F.col(f"{i}_a").alias("a"), F.col(f"{i}_b").alias("b")) for i in indices])).alias("o")).select("radius_m", "o.*")
    group = ["radius_m", "index"]
    direction = long.groupBy(*group).agg(F.avg((F.signum("a") == F.signum("b")).cast("int")).alias("direction_agreement"))
    gap = quantiles(long, group, {"gap": F.abs(F.col("a") - F.col("b"))}, {"median_abs_difference": 0.5}, bounded=bounded).drop("measure", "n")
    return direction.join(gap, group).join(spearman(long, group, "a", "b", bounded).withColumnRenamed("rho", "spearman_rho"), group)


def pressure_raster(valid_cells: DataFrame, bounded: bool = False) -> DataFrame:
    """P20: pooled 2-98 % scaling over all epochs, clipped to [0, 1], and the combined pressure."""
    names = ("ndvi", "ndbi", "mndwi")
    bounds = quantiles_wide(valid_cells, [], {i: i for i in names}, {"lo": 0.02, "hi": 0.98}, bounded=bounded)
    out = valid_cells.withColumn("_b", bounds.select(F.struct("*")).scalar())
    scaled = {i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(i) - F.col(f"_b.{i}_lo"), F.col(f"_b.{i}_hi") - F.col(f"_b.{i}_lo")))) for i in names}
    surface = ((1 - scaled["ndvi"]) + scaled["ndbi"]) / 2
    return out.select("epoch_id", "row", "col", ((surface + (1 - scaled["mndwi"])) / 2).alias("pressure"))


# --- classes -------------------------------------------------------------------------

def majority_purity(fine: DataFrame, keys: Sequence[str] = ("year",), factor: int = 3, column: str = "lc_class") -> DataFrame:
    """Majority class and its count in each factor x factor window; ties go to the lowest class, 0 when empty."""
    block = fine.select(*keys, F.floor(F.col("row") / factor).cast("bigint").alias("row"), F.floor(F.col("col") / factor).cast("bigint").alias("col"), F.col(column).alias("_k"))
    counts = block.groupBy(*keys, "row", "col", "_k").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("_k") > 0, F.struct("n", (-F.col("_k")).alias("k"))))
    return counts.groupBy(*keys, "row", "col").agg(best.alias("_b")).select(
        *keys, "row", "col", F.coalesce(-F.col("_b.k"), F.lit(0)).alias("majority"), F.coalesce("_b.n", F.lit(0)).alias("count"))


def consensus_labels(majority: DataFrame, years: tuple, required: int = 8, window: int = 9) -> DataFrame:
    """Label where both years agree with enough purity."""
    side = lambda y, s: majority.where(F.col("year") == y).select("row", "col", F.col("majority").alias(f"m{s}"), F.col("count").alias(f"c{s}"))
    both = side(years[0], 0).join(side(years[1], 1), ["row", "col"])
    agree = (F.col("m0") == F.col("m1")) & (F.col("m0") > 0) & (F.col("c0") >= required) & (F.col("c1") >= required)
    return both.select("row", "col", F.when(agree, F.col("m0")).otherwise(0).alias("proxy_class"),
                       F.when(agree, F.least("c0", "c1") / F.lit(float(window))).otherwise(0.0).alias("purity"))


def class_area(classified: DataFrame, cell_m: float = 30.0) -> DataFrame:
    """Pixels and hectares per epoch and class."""
    return classified.where(F.col("class_id") > 0).groupBy("epoch_id", "class_id").agg(F.count(F.lit(1)).alias("mapped_pixels")).withColumn(
        "area_ha", F.col("mapped_pixels") * (cell_m * cell_m / 10000.0))


def probability_diagnostics(classified: DataFrame, bounded: bool = False) -> DataFrame:
    """Median and low decile of the top probability, share at 0.7 or more, median entropy."""
    q = quantiles_wide(classified, ["epoch_id"], {"max_probability": "max_probability", "entropy": "entropy"}, {"median": 0.5, "p10": 0.1}, bounded=bounded)
    share = classified.groupBy("epoch_id").agg((F.avg((F.col("max_probability") >= 0.7).cast("int")) * 100).alias("percent_at_least_070"))
    return q.select("epoch_id", F.col("max_probability_median").alias("median_max_probability"), F.col("max_probability_p10").alias("p10_max_probability"),
                    F.col("entropy_median").alias("median_normalized_entropy"), F.col("max_probability_n").alias("mapped_pixels")).join(share, "epoch_id")


def monotone_check(area: DataFrame, class_id: int = 1) -> DataFrame:
    """Change of one class between consecutive epochs; a fall fails."""
    w = W.partitionBy("class_id").orderBy("epoch_id")
    steps = area.where(F.col("class_id") == class_id).withColumns({"from_epoch": F.lag("epoch_id").over(w), "_p": F.lag("area_ha").over(w)})
    change = F.col("area_ha") - F.col("_p")
    return steps.where(F.col("from_epoch").isNotNull()).select(
        "from_epoch", F.col("epoch_id").alias("to_epoch"), change.alias("change_ha"), F.when(change >= 0, "PASS").otherwise("FAIL").alias("non_decreasing_check"))


def band_identity(cells: DataFrame, references: DataFrame, bands: Sequence[str], bounded: bool = False) -> DataFrame:
    """Each band's median should be nearest to the centre of the component-median range of its own label."""
    medians = quantiles(cells, [], {b: b for b in bands}, {"median": 0.5}, bounded=bounded).select(F.col("measure").alias("band"), "median")
    centres = references.agg(*[F.struct(F.lit(b).alias("label"), ((F.min(b) + F.max(b)) / 2).alias("centre")).alias(f"c_{b}") for b in bands])
    options = medians.withColumn("_o", F.explode(centres.select(F.array(*[f"c_{b}" for b in bands])).scalar()))
    nearest = options.groupBy("band", "median").agg(F.min_by("_o.label", F.struct(F.abs(F.col("median") - F.col("_o.centre")), F.col("_o.label"))).alias("nearest_label"))
    return nearest.withColumn("matches", F.col("band") == F.col("nearest_label"))
