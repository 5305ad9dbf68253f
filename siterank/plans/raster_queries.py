"""Pixels, cells, discs, endpoint change and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions import columns as C, geodesy
from siterank.operators import raster, spatial
from siterank.operators.lineage import materialise
from siterank.operators.order import by_rows
from siterank.plans import bindings as B
from siterank.plans.registry import query, r, rounded, row_count, table

BANDS, INDICES = C.BANDS, C.INDICES
SCREEN_SQL = B.scene_pixels_sql() + f""",
sv AS (SELECT *, base AND phys AS valid, strict AND phys AS strict_valid FROM (SELECT *, {' AND '.join(f'{b} * 2.75e-5 + -2e-1 BETWEEN -2e-1 AND 16e-1' for b in BANDS)} AS phys FROM pq) q2)"""
AUDIT_SQL = SCREEN_SQL + """,
au AS (SELECT epoch_id, scene_id, platform, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS valid_share, avg(CASE WHEN strict_valid THEN 1 ELSE 0 END) AS strict_share,
  count(*) AS pixels, avg(CASE WHEN valid THEN 1 ELSE 0 END) >= 5e-2 AS retained FROM sv GROUP BY 1, 2, 3)"""


def screened(spark, folder):
    return raster.screened_pixels(B.scene_pixels(spark, folder))


@query("p3_p6_screened_pixels", f"""WITH {SCREEN_SQL}
SELECT epoch_id, platform, count(*) AS pixels, count(*) FILTER (valid) AS valid, count(*) FILTER (strict_valid) AS strict_valid,
  {r('sum(CASE WHEN valid THEN red ELSE 0 END)', 1)} AS valid_red FROM sv GROUP BY 1, 2""")
def screened_pixels(spark, folder):
    return rounded(screened(spark, folder).groupBy("epoch_id", "platform").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("valid").alias("valid"), F.count_if("strict_valid").alias("strict_valid"),
        F.sum(F.when(F.col("valid"), F.col("red")).otherwise(0)).cast("double").alias("valid_red")))


@query("a8_scene_audit", f"WITH {AUDIT_SQL} SELECT epoch_id, scene_id, platform, {r('valid_share')} AS valid_share, {r('strict_share')} AS strict_share, pixels, retained FROM au")
def scene_audit(spark, folder):
    return rounded(raster.scene_audit(screened(spark, folder)))


@query("a39_sensor_composition", f"WITH {AUDIT_SQL} SELECT epoch_id, platform, count(*) AS scenes, count(*) FILTER (retained) AS retained_scenes FROM au GROUP BY 1, 2")
def sensor_composition(spark, folder):
    a = raster.scene_audit(screened(spark, folder))
    return a.groupBy("epoch_id", "platform").agg(F.count(F.lit(1)).alias("scenes"), F.count_if("retained").alias("retained_scenes"))


_nd = lambda p, q: f"(({p}) - ({q})) / nullif(({p}) + ({q}), 0)"


def _indices_sql(prefix: str) -> dict:
    b = {n: prefix + n for n in BANDS}
    return {"ndvi": _nd(b["nir08"], b["red"]), "ndbi": _nd(b["swir16"], b["nir08"]), "mndwi": _nd(b["green"], b["swir16"]),
            "bsi": _nd(b["swir16"] + " + " + b["red"], b["nir08"] + " + " + b["blue"])}


def _harmonised_sql(b):
    i, s = C.HARMONISATION[b]
    return f"CASE WHEN only7 THEN {i!r}::DOUBLE + {s!r}::DOUBLE * native_{b} ELSE native_{b} END AS common_{b}"


COMPOSITE_SQL = AUDIT_SQL + f""",
ep AS (SELECT epoch_id, bool_and(platform = 'landsat-7') AS only7 FROM au WHERE retained GROUP BY 1),
md AS (SELECT sv.epoch_id, row, col, {', '.join(f'quantile_cont({b}, 0.5) FILTER (valid) AS m_{b}' for b in BANDS)}, count(*) FILTER (valid) AS observations,
  count(*) FILTER (strict_valid) AS strict_observations FROM sv JOIN au USING (epoch_id, scene_id) WHERE retained GROUP BY 1, 2, 3),
nt AS (SELECT epoch_id, row, col, observations, strict_observations, only7, {', '.join(f'CASE WHEN observations >= 3 THEN m_{b} * 2.75e-5 + -2e-1 END AS native_{b}' for b in BANDS)} FROM md JOIN ep USING (epoch_id)),
cm0 AS (SELECT *, {', '.join(_harmonised_sql(b) for b in BANDS)} FROM nt),
cp AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _indices_sql('common_').items())}, {', '.join(f'{e} AS native_{n}' for n, e in _indices_sql('native_').items())} FROM cm0)"""


def composite(spark, folder):
    s = screened(spark, folder)
    return raster.composite(s, raster.scene_audit(s))


@query("a7_p7_p8_median_composite", f"""WITH {COMPOSITE_SQL}
SELECT epoch_id, row, col, observations, strict_observations, {', '.join(f'{r(f"common_{b}", 12)} AS common_{b}' for b in BANDS)}, {', '.join(f'{r(i, 12)} AS {i}' for i in INDICES)} FROM cp""")
def median_composite(spark, folder):
    c = composite(spark, folder)
    return rounded(c.select("epoch_id", "row", "col", "observations", "strict_observations", *[f"common_{b}" for b in BANDS], *INDICES), 12)


@query("a9_coverage_audit", f"""WITH {COMPOSITE_SQL}, g AS (SELECT count(*) AS n FROM part),
c AS (SELECT epoch_id, count(*) FILTER (observations >= 3) * 1e2 / min(n) AS e, count(*) FILTER (observations >= 5) * 1e2 / min(n) AS p, count(*) FILTER (strict_observations >= 3) * 1e2 / min(n) AS s,
  min(observations) AS mn, median(observations) AS md, max(observations) AS mx FROM cp, g GROUP BY 1)
SELECT epoch_id, {r('e')} AS eligible_percent, {r('p')} AS preferred_percent, {r('s')} AS strict_percent, mn AS observations_min, {r('md')} AS observations_median, mx AS observations_max,
  CASE WHEN e >= 90 THEN 'PASS' ELSE 'FAIL' END AS coverage_check FROM c""")
def coverage(spark, folder):
    cells = row_count(spark, folder, "part")
    return rounded(raster.coverage_audit(composite(spark, folder), F.lit(cells)))


# --- discs ---------------------------------------------------------------------------

GRID = (B.GRID_XMIN, B.GRID_YMAX, B.CELL)


def valid_cells(spark, folder):
    return B.index_cells(spark, folder).where(C.valid_cell())


def disc_table(spark, folder):
    return raster.disc_join(B.places(spark, folder), valid_cells(spark, folder), B.DISC_RADII, *GRID)


def disc_groups(spark, folder, cells, summarise, keys, radii=B.DISC_RADII):
    """``summarise(joined, keys)`` of the discs of all places, within their tiles."""
    return raster.by_place(B.places(spark, folder), lambda p, tile: summarise(raster.disc_join(p, cells, radii, *GRID), [*keys, *tile]))


DISC_SQL = f"{B.index_cells_sql()}, {B.places_sql()}, {B.discs_sql()}"


@query("p2_valid_cells", f"WITH {B.index_cells_sql()} SELECT epoch_id, row, col, {', '.join(f'{r(i, 7)} AS {i}' for i in INDICES)} FROM vcells")
def valid(spark, folder):
    return rounded(valid_cells(spark, folder).select("epoch_id", "row", "col", *INDICES), 7)


@query("j3_p17_disc_join", f"WITH {DISC_SQL} SELECT component_id, radius_m, epoch_id, count(*) AS cells, {r('avg(ndvi)')} AS mean_ndvi FROM discs GROUP BY 1, 2, 3")
def disc_join(spark, folder):
    return rounded(disc_table(spark, folder).groupBy("component_id", "radius_m", "epoch_id").agg(F.count(F.lit(1)).alias("cells"), F.avg("ndvi").alias("mean_ndvi")))


@query("a1_neighbourhood_summary", f"""WITH {DISC_SQL}
SELECT component_id, radius_m, epoch_id, count(*) AS valid_cells, {', '.join(f'{r(f"quantile_cont({i}, {q})")} AS {i}_{n}' for i in INDICES for n, q in (('median', 0.5), ('p10', 0.1), ('p90', 0.9)))}
FROM discs GROUP BY 1, 2, 3""")
def neighbourhood(spark, folder):
    summarise = lambda joined, keys: raster.neighbourhood_summary(joined, keys, bounded=True)
    return rounded(disc_groups(spark, folder, valid_cells(spark, folder), summarise, ["component_id", "radius_m", "epoch_id"]))


@query("a1_neighbourhood_summary_bucketed", f"""WITH {DISC_SQL}
SELECT radius_m, epoch_id, count(*) AS valid_cells, {', '.join(f'{r(f"quantile_cont({i}, {q})")} AS {i}_{n}' for i in INDICES for n, q in (('median', 0.5), ('p10', 0.1), ('p90', 0.9)))}
FROM discs GROUP BY 1, 2""")
def neighbourhood_bucketed(spark, folder):
    """The bucketed quantiles that large inputs take, over groups of all discs of a radius; a cell counts once per disc that covers it."""
    discs = raster.disc_cells(B.places(spark, folder), B.DISC_RADII, *GRID).groupBy("radius_m", "row", "col").agg(F.count(F.lit(1)).alias("discs"))
    covered = by_rows(materialise(discs)).join(materialise(valid_cells(spark, folder).drop("lc_class")), ["row", "col"])
    return rounded(raster.neighbourhood_summary(covered, ["radius_m", "epoch_id"], weight="discs"))


@query("a2_class_shares", f"""WITH {DISC_SQL}
SELECT component_id, radius_m, epoch_id, count(*) FILTER (lc_class > 0) AS classified_cells,
  {', '.join(f'{r(f"count(*) FILTER (lc_class = {k}) * 1e0 / nullif(count(*) FILTER (lc_class > 0), 0)")} AS lc_class_{k}_share' for k in range(1, 7))} FROM discs GROUP BY 1, 2, 3""")
def class_shares(spark, folder):
    return rounded(raster.class_shares(disc_table(spark, folder).drop(*raster.TILE), ["component_id", "radius_m", "epoch_id"]))


@query("a30_site_epoch_medians", f"WITH {B.index_cells_sql()} SELECT epoch_id, {', '.join(f'{r(f"median({i})")} AS grid_median_{i}' for i in INDICES[:3])} FROM vcells GROUP BY 1")
def site_medians(spark, folder):
    from siterank.operators.order import quantiles_wide

    q = quantiles_wide(valid_cells(spark, folder), ["epoch_id"], {f"grid_median_{i}": i for i in INDICES[:3]}, {"m": 0.5})
    return rounded(q.select("epoch_id", *[F.col(f"grid_median_{i}_m").alias(f"grid_median_{i}") for i in INDICES[:3]]))


FIRST, LAST = "E1995", "E2001"
DELTA_SQL = f"""
dl AS (SELECT a.row, a.col, b.ndvi - a.ndvi AS d_ndvi, b.ndbi - a.ndbi AS d_ndbi, b.mndwi - a.mndwi AS d_mndwi FROM vcells a JOIN vcells b
  ON a.row = b.row AND a.col = b.col AND a.epoch_id = '{FIRST}' AND b.epoch_id = '{LAST}')"""
LIMITS_SQL = "\ntl AS (" + " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS tail, quantile_cont(d_ndvi, {q}) AS limit_ndvi, quantile_cont(d_mndwi, {q}) AS limit_mndwi, quantile_cont(d_ndbi, {round(1 - q, 2)}) AS limit_ndbi FROM dl" for q in (0.15, 0.2, 0.25)) + ")"
CONV_SQL = """
cv AS (SELECT dl.*, tail, CAST(round(d_ndvi, 12) <= round(limit_ndvi, 12) AS INTEGER) + CAST(round(d_mndwi, 12) <= round(limit_mndwi, 12) AS INTEGER) + CAST(round(d_ndbi, 12) >= round(limit_ndbi, 12) AS INTEGER) AS convergence FROM dl, tl)"""
TAILS = (0.15, 0.2, 0.25)


def deltas(spark, folder):
    d = raster.endpoint_deltas(valid_cells(spark, folder), FIRST, LAST)
    return d.select("row", "col", *[F.round(c, 12).alias(c) for c in ("d_ndvi", "d_ndbi", "d_mndwi")])


DELTA_SQL = DELTA_SQL.replace("b.ndvi - a.ndvi", "round(b.ndvi - a.ndvi, 12)").replace("b.ndbi - a.ndbi", "round(b.ndbi - a.ndbi, 12)").replace("b.mndwi - a.mndwi", "round(b.mndwi - a.mndwi, 12)")


@query("j17_endpoint_deltas", f"WITH {B.index_cells_sql()}, {DELTA_SQL} SELECT row, col, {', '.join(f'{r(c)} AS {c}' for c in ('d_ndvi', 'd_ndbi', 'd_mndwi'))} FROM dl")
def endpoint_deltas(spark, folder):
    return rounded(deltas(spark, folder))


@query("a3_a6_tail_thresholds", f"WITH {B.index_cells_sql()}, {DELTA_SQL}, {LIMITS_SQL} SELECT {r('tail')} AS tail, {', '.join(f'{r(c)} AS {c}' for c in ('limit_ndvi', 'limit_mndwi', 'limit_ndbi'))} FROM tl")
def tail_thresholds(spark, folder):
    return rounded(raster.tail_thresholds(deltas(spark, folder), TAILS))


def convergence_cells(spark, folder, tails=TAILS):
    d = deltas(spark, folder)
    limits = raster.tail_thresholds(d, tails)
    return raster.convergence(d, limits.select("tail", *[F.round(c, 12).alias(c) for c in limits.columns if c != "tail"]))


@query("a4_a6_r13_convergence", f"""WITH {B.index_cells_sql()}, {DELTA_SQL}, {LIMITS_SQL}, {CONV_SQL},
x AS (SELECT tail, h, count(*) AS n, count(*) FILTER (convergence >= h) AS cells, sum(convergence) / (3e0 * count(*)) AS mr FROM cv, (VALUES (1), (2), (3)) v(h) GROUP BY 1, 2),
y AS (SELECT *, CASE h WHEN 1 THEN 1 - pow(1 - tail, 3) WHEN 2 THEN 3 * tail * tail * (1 - tail) + tail * tail * tail ELSE tail * tail * tail END AS e FROM x)
SELECT {r('tail')} AS tail, h AS criteria_met_at_least, n AS common_support_cells, cells, {r('cells * 1e0 / n')} AS observed_share, {r('e')} AS expected_share_under_independence,
  {r('cells * 1e0 / n / e')} AS ratio_observed_to_expected, {r('mr')} AS marginal_rate FROM y""")
def convergence(spark, folder):
    return rounded(raster.convergence_counts(convergence_cells(spark, folder)))


@query("a5_hotspots", f"""WITH {B.index_cells_sql()}, {B.places_sql()}, {DELTA_SQL}, {LIMITS_SQL}, {CONV_SQL}, c2 AS (SELECT * FROM cv WHERE tail = 2e-1), {B.discs_sql(cells='c2')}
SELECT component_id, radius_m, count(*) AS valid_cells, {r('avg(CASE WHEN convergence >= 2 THEN 1 ELSE 0 END)')} AS share_c_ge_2, {r('avg(CASE WHEN convergence = 3 THEN 1 ELSE 0 END)')} AS share_c_eq_3,
  {', '.join(f'{r(f"median(d_{i})", 9)} AS d_{i}_median' for i in ('ndvi', 'mndwi', 'ndbi'))} FROM discs GROUP BY 1, 2""")
def hotspots(spark, folder):
    summarise = lambda joined, keys: raster.hotspots(joined, keys, bounded=True)
    out = disc_groups(spark, folder, materialise(convergence_cells(spark, folder, (0.2,))), summarise, ["component_id", "radius_m"])
    return rounded(out, 9).withColumns(
        {c: F.round(c, 6) + 0.0 for c in ("share_c_ge_2", "share_c_eq_3")})


EPOCHS = [f"E{y}" for y in range(1995, 2002)]


@query("a36_common_support", f"""WITH {B.index_cells_sql()}, {B.places_sql()}, a AS (SELECT c.*, v.ndvi IS NOT NULL AS ok FROM cells c LEFT JOIN vcells v USING (epoch_id, row, col)), {B.discs_sql(cells='a')},
pc AS (SELECT component_id, radius_m, row, col, count(*) FILTER (ok) AS v, {', '.join(f"max(CASE WHEN epoch_id = '{e}' AND ok THEN 1 ELSE 0 END) AS v_{e}" for e in EPOCHS)} FROM discs GROUP BY 1, 2, 3, 4)
SELECT component_id, radius_m, count(*) AS support_cells, count(*) FILTER (v = 7) AS all_epoch_valid_cells, {r('avg(CASE WHEN v = 7 THEN 1 ELSE 0 END)')} AS all_epoch_valid_share,
  {', '.join(f'{r(f"avg(v_{e})")} AS valid_share_{e}' for e in EPOCHS)} FROM pc GROUP BY 1, 2""")
def common_support(spark, folder):
    cells = B.index_cells(spark, folder).withColumn("is_valid", C.valid_cell())
    seen = cells.select("epoch_id", "row", "col", "is_valid")
    return rounded(disc_groups(spark, folder, seen, lambda joined, keys: raster.common_support(joined, EPOCHS, keys), ["component_id", "radius_m"]))


def _delta_medians_sql(prefix, name):
    return f"""
{name}d AS (SELECT a.row, a.col, {', '.join(f'b.{prefix}{i} - a.{prefix}{i} AS {i}' for i in INDICES[:3])} FROM cp a JOIN cp b ON a.row = b.row AND a.col = b.col AND a.epoch_id = '{FIRST}' AND b.epoch_id = '{LAST}'
  WHERE {' AND '.join(f'a.{prefix}{i} IS NOT NULL AND b.{prefix}{i} IS NOT NULL' for i in INDICES[:3])}),
{name} AS (SELECT p.component_id, radius_m, {', '.join(f'round(median({i}), 9) AS {i}' for i in INDICES[:3])} FROM places p, (VALUES (60), (120), (240)) t(radius_m), {name}d c
  WHERE p.x IS NOT NULL AND pow({B.GRID_XMIN_SQL} + (c.col + 5e-1) * 30e0 - p.x, 2) + pow({B.GRID_YMAX_SQL} - (c.row + 5e-1) * 30e0 - p.y, 2) <= radius_m * radius_m GROUP BY 1, 2)"""


@query("a37_harmonisation_sensitivity", f"""WITH {COMPOSITE_SQL}, {B.places_sql()}, {_delta_medians_sql('native_', 'hn')}, {_delta_medians_sql('', 'hc')},
lg AS ({' UNION ALL '.join(f"SELECT radius_m, '{i}' AS index, n.{i} AS a, c.{i} AS b FROM hn n JOIN hc c USING (component_id, radius_m)" for i in INDICES[:3])}),
rk AS ({B.ranks_sql('lg', 'radius_m, index', 'a', 'b')})
SELECT radius_m, index, {r('avg(CASE WHEN sign(a) = sign(b) THEN 1 ELSE 0 END)')} AS direction_agreement, {r('median(abs(a - b))', 8)} AS median_abs_difference, count(*) AS n, {r('corr(rx, ry)')} AS spearman_rho FROM rk GROUP BY 1, 2""")
def harmonisation(spark, folder):
    cells = materialise(composite(spark, folder).where(F.col("epoch_id").isin(FIRST, LAST)).select("epoch_id", "row", "col", *[f"{p}{i}" for p in ("native_", "") for i in INDICES[:3]]))
    summarise = lambda joined, keys: raster.hotspots(joined, keys, bounded=True)
    sides = []
    for prefix in ("native_", ""):
        side = raster.endpoint_deltas(cells.select("epoch_id", "row", "col", *[F.col(f"{prefix}{i}").alias(i) for i in INDICES[:3]]), FIRST, LAST)
        h = disc_groups(spark, folder, side.withColumn("convergence", F.lit(0)), summarise, ["component_id", "radius_m"])
        sides.append(materialise(h.select("component_id", "radius_m", *[F.round(f"d_{i}_median", 9).alias(f"d_{i}_median") for i in INDICES[:3]])))
    out = raster.harmonisation_sensitivity(sides[0], sides[1], ["component_id"], INDICES[:3])
    return rounded(out, 8).withColumns({c: F.round(c, 6) + 0.0 for c in ("direction_agreement", "spearman_rho")})


_sc = lambda i: f"greatest(0e0, least(1e0, ({i} - {i}_lo) / nullif({i}_hi - {i}_lo, 0)))"


@query("p20_pressure_raster", f"""WITH {B.index_cells_sql()}, b AS (SELECT {', '.join(f'quantile_cont({i}, 0.02) AS {i}_lo, quantile_cont({i}, 0.98) AS {i}_hi' for i in INDICES[:3])} FROM vcells)
SELECT epoch_id, row, col, {r(f"(((1 - {_sc('ndvi')}) + {_sc('ndbi')}) / 2 + (1 - {_sc('mndwi')})) / 2")} AS pressure FROM vcells, b""")
def pressure_raster(spark, folder):
    return rounded(raster.pressure_raster(valid_cells(spark, folder)))


# --- classes -------------------------------------------------------------------------

MAJORITY_SQL = B.index_cells_sql() + """,
k AS (SELECT epoch_id AS year, row // 3 AS row, col // 3 AS col, lc_class AS c, count(*) AS n FROM cells WHERE lc_class > 0 GROUP BY ALL),
w AS (SELECT DISTINCT epoch_id AS year, row // 3 AS row, col // 3 AS col FROM cells),
b AS (SELECT *, row_number() OVER (PARTITION BY year, row, col ORDER BY n DESC, c) AS i FROM k),
mj AS (SELECT w.*, coalesce(c, 0) AS majority, coalesce(n, 0) AS count FROM w LEFT JOIN (SELECT * FROM b WHERE i = 1) q USING (year, row, col))"""


def majority(spark, folder):
    return raster.majority_purity(B.index_cells(spark, folder).withColumnRenamed("epoch_id", "year"))


@query("a31_majority_purity", f"WITH {MAJORITY_SQL} SELECT year, row, col, majority, count FROM mj")
def majority_purity(spark, folder):
    return rounded(majority(spark, folder))


@query("a31_consensus_labels", f"""WITH {MAJORITY_SQL}, j AS (SELECT a.row, a.col, a.majority = b.majority AND a.majority > 0 AND a.count >= 3 AND b.count >= 3 AS ok, a.majority AS m, least(a.count, b.count) AS c
  FROM mj a JOIN mj b ON a.row = b.row AND a.col = b.col AND a.year = 'E1999' AND b.year = 'E2000')
SELECT row, col, CASE WHEN ok THEN m ELSE 0 END AS proxy_class, {r('CASE WHEN ok THEN c / 9e0 ELSE 0 END')} AS purity FROM j""")
def consensus(spark, folder):
    return rounded(raster.consensus_labels(majority(spark, folder), ("E1999", "E2000"), required=3))


def classified(spark, folder):
    c = B.index_cells(spark, folder)
    return c.select("epoch_id", "row", "col", F.col("lc_class").alias("class_id"), F.abs("ndvi").alias("max_probability"), F.abs("ndbi").alias("entropy"))


AREA_SQL = B.index_cells_sql() + ", ar AS (SELECT epoch_id, lc_class AS class_id, count(*) AS mapped_pixels, count(*) * 9e-2 AS area_ha FROM cells WHERE lc_class > 0 GROUP BY 1, 2)"


@query("a32_class_area", f"WITH {AREA_SQL} SELECT epoch_id, class_id, mapped_pixels, {r('area_ha')} AS area_ha FROM ar")
def class_area(spark, folder):
    return rounded(raster.class_area(classified(spark, folder)))


@query("a32_probability_diagnostics", f"""WITH {B.index_cells_sql()}
SELECT epoch_id, {r('median(abs(ndvi))')} AS median_max_probability, {r('quantile_cont(abs(ndvi), 0.1)')} AS p10_max_probability, {r('median(abs(ndbi))')} AS median_normalized_entropy,
  count(*) AS mapped_pixels, {r('avg(CASE WHEN abs(ndvi) >= 0.7 THEN 1 ELSE 0 END) * 100')} AS percent_at_least_070 FROM cells WHERE lc_class > 0 GROUP BY 1""")
def diagnostics(spark, folder):
    return rounded(raster.probability_diagnostics(classified(spark, folder).where(F.col("class_id") > 0)))


@query("a33_monotone_check", f"""WITH {AREA_SQL}, s AS (SELECT lag(epoch_id) OVER w AS f, epoch_id AS t, area_ha - lag(area_ha) OVER w AS d FROM ar WHERE class_id = 1 WINDOW w AS (ORDER BY epoch_id))
SELECT f AS from_epoch, t AS to_epoch, {r('d')} AS change_ha, CASE WHEN d >= 0 THEN 'PASS' ELSE 'FAIL' END AS non_decreasing_check FROM s WHERE f IS NOT NULL""")
def monotone(spark, folder):
    return rounded(raster.monotone_check(raster.class_area(classified(spark, folder))))


@query("v11_band_identity", f"""WITH {DISC_SQL}, cmx AS (SELECT component_id, {', '.join(f'median({i}) AS {i}' for i in INDICES[:3])} FROM discs WHERE radius_m = 240 AND epoch_id = '{LAST}' GROUP BY 1),
ce AS ({' UNION ALL '.join(f"SELECT '{i}' AS label, (min({i}) + max({i})) / 2 AS centre FROM cmx" for i in INDICES[:3])}),
bm AS ({' UNION ALL '.join(f"SELECT '{i}' AS band, median({i}) AS median FROM vcells WHERE epoch_id = '{LAST}'" for i in INDICES[:3])}),
x AS (SELECT band, median, label, row_number() OVER (PARTITION BY band ORDER BY abs(median - centre), label) AS i FROM bm, ce)
SELECT band, {r('median')} AS median, label AS nearest_label, band = label AS matches FROM x WHERE i = 1""")
def band_identity(spark, folder):
    cells = valid_cells(spark, folder).where(F.col("epoch_id") == LAST)
    summarise = lambda joined, keys: raster.neighbourhood_summary(joined, keys, INDICES[:3], bounded=True)
    summary = disc_groups(spark, folder, cells, summarise, ["component_id"], [240])
    references = summary.select(*[F.col(f"{i}_median").alias(i) for i in INDICES[:3]])
    return rounded(raster.band_identity(cells, references, INDICES[:3]))


# --- geometry ------------------------------------------------------------------------

@query("p15_analysis_envelope", f"""WITH {B.places_sql()}, e AS (SELECT floor((min(x) - 5000) / 30) * 30 AS xmin, floor((min(y) - 5000) / 30) * 30 AS ymin, ceil((max(x) + 5000) / 30) * 30 AS xmax, ceil((max(y) + 5000) / 30) * 30 AS ymax FROM places)
SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('xmin', 'ymin', 'xmax', 'ymax'))}, CAST(round((xmax - xmin) / 30) AS BIGINT) AS width, CAST(round((ymax - ymin) / 30) AS BIGINT) AS height FROM e""")
def envelope(spark, folder):
    e = spatial.envelope(B.places(spark, folder))
    return e.select(*[F.col(c).cast("bigint").alias(c) for c in e.columns])


@query("p16_circle_rings", f"""WITH {B.places_sql()}
SELECT component_id, radius_m, i AS vertex, {r('round(x + radius_m * cos(i * 6.283185307179586e0 / 96e0), 3)', 3)} AS px, {r('round(y + radius_m * sin(i * 6.283185307179586e0 / 96e0), 3)', 3)} AS py
FROM places, (VALUES (250), (500), (1000)) t(radius_m), range(97) v(i) WHERE x IS NOT NULL""")
def circle_rings(spark, folder):
    p = B.places(spark, folder).where(F.col("x").isNotNull()).withColumn("radius_m", F.explode(F.array(*map(F.lit, (250, 500, 1000)))))
    ring = p.select("component_id", "radius_m", F.posexplode(geodesy.circle_ring(F.col("x"), F.col("y"), F.col("radius_m"))).alias("vertex", "pt"))
    return rounded(ring.select("component_id", "radius_m", "vertex", F.col("pt")[0].alias("px"), F.col("pt")[1].alias("py")), 3)


@query("p14_projection_round_trip")
def projection(spark, folder):
    p = B.places(spark, folder).where(F.col("x").isNotNull())
    lon, lat = geodesy.from_utm(F.col("x"), F.col("y"))
    back = p.select("component_id", "x", "y", lon.alias("longitude"), lat.alias("latitude"))
    e, n = geodesy.to_utm(F.col("longitude"), F.col("latitude"))
    return rounded(back.select("component_id", "longitude", "latitude", F.hypot(e - F.col("x"), n - F.col("y")).alias("round_trip_m")), 9)


@query("p14_haversine", f"""WITH g AS (SELECT c_custkey, 72 + c_nationkey / 25e0 AS lon, 33 + abs(c_acctbal) / 10000e0 AS lat FROM customer),
h AS (SELECT c_custkey, pow(sin(radians(336e-1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(336e-1)) * pow(sin(radians(728e-1 - lon) / 2), 2) AS h FROM g)
SELECT c_custkey, {r('2 * 6371008.8e0 * asin(sqrt(h))', 4)} AS distance_m FROM h""")
def haversine(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", (72 + F.col("c_nationkey") / F.lit(25.0)).alias("lon"), (33 + F.abs("c_acctbal") / 10000).alias("lat"))
    return rounded(c.select("c_custkey", geodesy.haversine_m(F.col("lon"), F.col("lat"), F.lit(72.8), F.lit(33.6)).alias("distance_m")), 4)


@query("p18_p19_blocks_and_roles", f"""WITH {B.index_cells_sql()}, b AS (SELECT (row // 5) * ((({B.width_sql('part')}) + 4) // 5) + col // 5 AS block FROM vcells)
SELECT CASE WHEN block % 10 IN (3, 4) THEN 'test' WHEN block % 10 IN (2, 5) THEN 'buffer' ELSE 'development' END AS role, count(*) AS cells, count(DISTINCT block) AS blocks FROM b GROUP BY 1""")
def blocks(spark, folder):
    width = B.grid_width(spark, folder, "part")
    b = valid_cells(spark, folder).select(C.block_id("row", "col", 150, 30.0, width).alias("block"))
    return rounded(b.groupBy(C.split_role("block").alias("role")).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("block").alias("blocks")))


# Each nation is a square with a square hole; a second part lies beside it.
NATION_BOX = "n_nationkey % 5 * 400e0 + 293100e0 AS bx, 3748500e0 - n_nationkey // 5 * 150e0 AS b2"


def footprints(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey"), (F.col("n_nationkey") % 5 * 400.0 + 293100.0).alias("bx"),
                                              (F.lit(3748500.0) - F.floor(F.col("n_nationkey") / 5) * 150.0).alias("by"))
    square = lambda x, y, s: F.array(*[F.array(x + dx * s, y - dy * s) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    x, y = F.col("bx"), F.col("by")
    return n.select("n_nationkey", F.array(F.array(square(x, y, 120.0), square(x + 30, y - 30, 45.0)), F.array(square(x + 150, y, 60.0))).alias("rings"))


@query("p13_points_in_polygons", f"""WITH {B.places_sql()}, n AS (SELECT n_nationkey, {NATION_BOX} FROM nation),
t AS (SELECT component_id, n_nationkey, (x BETWEEN bx AND bx + 120 AND y BETWEEN b2 - 120 AND b2 AND NOT (x BETWEEN bx + 30 AND bx + 75 AND y BETWEEN b2 - 75 AND b2 - 30))
  OR (x BETWEEN bx + 150 AND bx + 210 AND y BETWEEN b2 - 60 AND b2) AS inside FROM places, n WHERE x IS NOT NULL)
SELECT component_id, n_nationkey FROM t WHERE inside""")
def polygons(spark, folder):
    points = B.places(spark, folder).where(F.col("x").isNotNull())
    found = spatial.points_in_polygons(points, footprints(spark, folder), ["component_id"], ["n_nationkey"], 60.0)
    return rounded(found.where("inside").select("component_id", "n_nationkey"))


@query("r10_j7_support_overlap", f"""WITH {B.places_sql()}, d AS (SELECT radius_m, a.component_id AS component_a, b.component_id AS component_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM places a JOIN places b ON a.component_id < b.component_id AND a.x IS NOT NULL AND b.x IS NOT NULL, (VALUES (60), (120), (500)) t(radius_m)),
l AS (SELECT *, 2e0 * radius_m * radius_m * acos(d / (2e0 * radius_m)) - d / 2 * sqrt(greatest(4e0 * radius_m * radius_m - d * d, 0)) AS a FROM d WHERE d < 2 * radius_m),
m AS (SELECT *, CASE WHEN a > 0 THEN a / (6.283185307179586e0 * radius_m * radius_m - a) ELSE 0 END AS j FROM l)
SELECT radius_m, component_a, component_b, {r('d')} AS distance_m, {r('a', 3)} AS intersection_area_m2, {r('j')} AS jaccard_overlap, radius_m = 500 AND j >= 0.25 AS flag_cluster_aware FROM m""")
def overlap(spark, folder):
    o = spatial.support_overlap(B.places(spark, folder), [60, 120, 500])
    return rounded(o.withColumn("intersection_area_m2", F.round("intersection_area_m2", 3)))


@query("p12_catalogue_acceptance", """WITH c AS (SELECT o_orderpriority AS epoch_id, o_custkey AS item_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 7 % 1000) / 1e1 END AS cloud,
  CASE WHEN o_orderkey % 5 = 0 THEN 'L1TP' ELSE 'L2SP' END AS level, o_orderstatus AS platform, o_orderkey % 3 = 0 AS part, o_orderkey % 7 <> 0 AS cover, o_orderkey FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY epoch_id, item_id ORDER BY cloud NULLS FIRST, platform, level, part, cover) AS i FROM c),
f AS (SELECT CASE WHEN cloud IS NULL OR cloud > 80 THEN 'cloud_threshold' WHEN level <> 'L2SP' THEN 'processing_level' WHEN part THEN 'asset_completeness' WHEN NOT cover THEN 'full_aoi_coverage' ELSE 'accepted' END AS reason FROM o WHERE i = 1)
SELECT reason, count(*) AS scenes FROM f GROUP BY 1""")
def catalogue(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    c = o.select(F.col("o_orderpriority").alias("epoch_id"), F.col("o_custkey").alias("item_id"), F.when(k % 13 != 0, (k * 7 % 1000) / F.lit(10.0)).alias("cloud"),
                 F.when(k % 5 == 0, "L1TP").otherwise("L2SP").alias("level"),
                 F.when(k % 3 == 0, F.array(F.lit("blue"))).otherwise(F.array(F.lit("blue"), F.lit("red"))).alias("assets"),
                 F.concat_ws("|", "o_orderstatus", F.when(k % 5 == 0, "L1TP").otherwise("L2SP"), F.when(k % 3 == 0, "t").otherwise("f"), F.when(k % 7 != 0, "t").otherwise("f")).alias("platform"),
                 (k % 7 != 0).alias("full_coverage"))
    a = spatial.accepted_scenes(c, ["L2SP", "L2SR"], ["blue", "red"])
    return a.groupBy(F.coalesce("rejection", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("scenes"))


WC_SQL = """WITH f AS (SELECT c_custkey, round(33 + (c_nationkey % 7) / 1e1, 6) AS la, round(72 + (c_nationkey % 3) / 1e1, 6) AS lo FROM customer),
k AS (SELECT la, lo, min(c_custkey) AS f FROM f GROUP BY 1, 2), n AS (SELECT la, lo, 'OM_' || lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), 2, '0') AS weather_cell_id FROM k)"""


def weather_map(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", (33 + F.col("c_nationkey") % 7 / F.lit(10.0)).alias("latitude"), (72 + F.col("c_nationkey") % 3 / F.lit(10.0)).alias("longitude"))
    return spatial.weather_cells(c, "c_custkey")


@query("j14_weather_cells", WC_SQL + f" SELECT c_custkey, weather_cell_id, {r('la')} AS returned_latitude, {r('lo')} AS returned_longitude FROM f JOIN n USING (la, lo)")
def weather_cell_map(spark, folder):
    return rounded(weather_map(spark, folder).select("c_custkey", "weather_cell_id", "returned_latitude", "returned_longitude"))


@query("a40_components_per_weather_cell", WC_SQL + " SELECT weather_cell_id, count(*) AS component_count FROM f JOIN n USING (la, lo) GROUP BY 1")
def weather_cell_counts(spark, folder):
    return weather_map(spark, folder).groupBy("weather_cell_id").agg(F.count(F.lit(1)).alias("component_count"))


@query("p1_p9_sentinels_and_recode", f"""SELECT c_custkey, {r('CASE WHEN c_acctbal > -9e2 THEN c_acctbal END', 2)} AS balance,
  CASE c_nationkey WHEN 10 THEN 6 WHEN 20 THEN 5 WHEN 5 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS class_id FROM customer""")
def sentinels(spark, folder):
    c = table(spark, folder, "customer")
    return rounded(c.select("c_custkey", C.clean("c_acctbal", C.SENTINEL["weather"]).alias("balance"), C.recode("c_nationkey", {10: 6, 20: 5, 5: 1, 0: 2}).alias("class_id")), 2)


@query("p24_sensor_contract", f"""WITH a AS (SELECT l_partkey AS pixel, year(l_shipdate) AS year, l_suppkey, (CAST(round(l_extendedprice) AS BIGINT) % 9000 + CASE WHEN l_returnflag >= 'N' THEN -1000 ELSE 0 END) / 10000e0 AS sr, l_linenumber AS scl,
  row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS i FROM lineitem),
v AS (SELECT * FROM a WHERE i <= 4 AND scl NOT IN (0, 1, 3) AND sr BETWEEN 0 AND 1)
SELECT pixel, year, count(*) AS observations, {r('median(sr)')} AS composite FROM v GROUP BY 1, 2 HAVING count(*) >= 3""")
def sensor_contract(spark, folder):
    from pyspark.sql import Window as W

    items = table(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    first = F.row_number().over(W.partitionBy("l_partkey", "year").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
    dn = F.expr("cast(round(l_extendedprice) as bigint) % 9000")
    a = items.select(F.col("l_partkey").alias("pixel"), "year", C.sensor_reflectance(dn, "l_returnflag", -1000, "N").alias("sr"), F.col("l_linenumber").alias("scl"), first.alias("i"))
    v = a.where((F.col("i") <= 4) & ~F.col("scl").isin(0, 1, 3) & F.col("sr").between(0, 1))
    out = v.groupBy("pixel", "year").agg(F.count(F.lit(1)).alias("observations"), F.percentile("sr", F.lit(0.5)).alias("composite"))
    return rounded(out.where(F.col("observations") >= 3))
