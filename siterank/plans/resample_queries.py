"""Resampled rankings, decision geometry and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions.columns import valid_cell
from siterank.operators import benchmark, decision, metrics, raster, resample, scoring
from siterank.operators.lineage import materialise
from siterank.plans import bindings as B
from siterank.plans.registry import query, r, rounded, table
from siterank.plans.score_queries import SUMMARY_SQL, UNIFORM_SQL, FORMULATION_SQL, frame
from siterank.plans.bindings import score_sql, score_table

GRID = (B.GRID_XMIN, B.GRID_YMAX, B.CELL)
LAST = B.LAST_EPOCH
RADIUS, DRAWS = 240, 2000
LAT0, LON0, STEP = 34.0, 72.0, 1 / 3600


def sites(spark, folder):
    """Nations at the mean position of their located suppliers, in both coordinate systems."""
    p = B.places(spark, folder).join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("component_id"), "s_nationkey"), "component_id")
    m = p.groupBy(F.col("s_nationkey").cast("bigint").alias("component_id")).agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    return m.where(F.col("x").isNotNull()).withColumns({"longitude": LON0 + (F.col("x") - B.GRID_XMIN) / 100000, "latitude": LAT0 - (B.GRID_YMAX - F.col("y")) / 100000})


SITES_SQL = f"""{B.places_sql()},
sites AS (SELECT component_id, x, y, 72e0 + (x - {B.GRID_XMIN_SQL}) / 100000 AS longitude, 34e0 - ({B.GRID_YMAX_SQL} - y) / 100000 AS latitude FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS component_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM places JOIN supplier ON s_suppkey = component_id GROUP BY 1) q WHERE x IS NOT NULL)"""


def last_cells(spark, folder):
    return B.index_cells(spark, folder).where(valid_cell() & (F.col("epoch_id") == LAST)).select("row", "col", "ndvi", "ndbi", "mndwi")


def fixed_terrain(spark, folder):
    return table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("component_id"), ((F.col("n_nationkey") * 7 % 25) / F.lit(25.0)).alias(scoring.TERRAIN_SCORE))


FIXED_SQL = "fx AS (SELECT CAST(n_nationkey AS BIGINT) AS component_id, (n_nationkey * 7 % 25) / 25e0 AS terrain FROM nation)"


def disc_sql(points: str, keys: str, name: str = "dj") -> str:
    k = ", ".join(f"p.{x}" for x in keys.split(", "))
    return f"""
{name} AS (SELECT {k}, c.* FROM {points} p, lc c WHERE pow({B.GRID_XMIN_SQL} + (c.col + 5e-1) * 30e0 - p.x, 2) + pow({B.GRID_YMAX_SQL} - (c.row + 5e-1) * 30e0 - p.y, 2) <= {RADIUS} * {RADIUS})"""


LAST_SQL = f"{B.index_cells_sql()}, lc AS (SELECT row, col, ndvi, ndbi, mndwi FROM vcells WHERE epoch_id = '{LAST}')"


def pct(v: str, part: str) -> str:
    return f"((rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2e0 - 5e-1) / count(*) OVER (PARTITION BY {part}))"


def landscape_sql(part: str) -> str:
    return f"(({pct('-ndvi', part)} + {pct('ndbi', part)}) / 2e0 + {pct('-mndwi', part)}) / 2e0"


@query("g8_block_summary", f"""WITH {LAST_SQL}, {SITES_SQL}, {disc_sql('sites', 'component_id')}
SELECT component_id, (row // 3) * (({B.width_sql('part')} + 2) // 3) + col // 3 AS block, count(*) AS cells, {', '.join(f'{r(f"median({v})")} AS {v}' for v in ('ndvi', 'ndbi', 'mndwi'))} FROM dj GROUP BY 1, 2""")
def block_summary(spark, folder):
    joined = raster.disc_join(sites(spark, folder), last_cells(spark, folder), [RADIUS], *GRID)
    return rounded(resample.block_summary(resample.with_block(joined, 90.0, B.CELL, B.grid_width(spark, folder, "part")), ["component_id"]))


M3_SQL = f"""
bl AS (SELECT *, (row // 5) * (({B.width_sql('part')} + 4) // 5) + col // 5 AS block FROM dj),
sl AS (SELECT component_id, block, row_number() OVER (PARTITION BY component_id ORDER BY block) - 1 AS slot, count(*) OVER (PARTITION BY component_id) AS nb FROM (SELECT DISTINCT component_id, block FROM bl)),
pk AS (SELECT component_id, draw, CAST(floor({UNIFORM_SQL('blocks', 'component_id', 'draw', 'slot')} * nb) AS BIGINT) AS pick FROM sl, range({DRAWS}) d(draw)),
po AS (SELECT p.component_id, p.draw, b.ndvi, b.ndbi, b.mndwi FROM pk p JOIN sl s ON s.component_id = p.component_id AND s.slot = p.pick JOIN bl b ON b.component_id = s.component_id AND b.block = s.block),
me AS (SELECT component_id, draw, median(ndvi) AS ndvi, median(ndbi) AS ndbi, median(mndwi) AS mndwi FROM po GROUP BY 1, 2),
ls AS (SELECT component_id, draw, {landscape_sql('draw')} AS l FROM me),
s2 AS (SELECT component_id, draw, (l + terrain) / 2e0 AS score FROM ls JOIN fx USING (component_id)),
x AS (SELECT component_id, draw, score, rank() OVER (PARTITION BY draw ORDER BY score DESC) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2e0 AS rank FROM s2)"""


@query("m3_independent_block_bootstrap", f"""WITH {LAST_SQL}, {SITES_SQL}, {disc_sql('sites', 'component_id')}, {FIXED_SQL}, {M3_SQL}
{SUMMARY_SQL('component_id')}, {r('quantile_cont(score, 0.5)', 9)} AS score_median, {r('quantile_cont(score, 0.025)', 9)} AS score_ci_low_95, {r('quantile_cont(score, 0.975)', 9)} AS score_ci_high_95 FROM x GROUP BY 1""")
def m3(spark, folder):
    joined = raster.disc_join(sites(spark, folder), last_cells(spark, folder), [RADIUS], *GRID)
    blocked = resample.with_block(joined, 150.0, B.CELL, B.grid_width(spark, folder, "part"))
    draws = resample.independent_block_bootstrap(blocked, fixed_terrain(spark, folder), DRAWS)
    return rounded(decision.summarise_ranks(draws, ["component_id"], "score"), 9)


SIZES = [90, 150, 300]


def shared_medians_sql(source: str, keys: str, stream_keys: tuple) -> str:
    w = f"-ln({UNIFORM_SQL('shared', *stream_keys, 'block')} + 5e-1 / 4503599627370496e0) * cells"
    parts = []
    for v in ("ndvi", "ndbi", "mndwi"):
        parts.append(f"""
w_{v} AS (SELECT {keys}, component_id, min(v) AS {v} FROM (SELECT {keys}, component_id, {v} AS v, sum(w) OVER (PARTITION BY {keys}, component_id ORDER BY {v} ROWS UNBOUNDED PRECEDING) AS run,
  sum(w) OVER (PARTITION BY {keys}, component_id) AS al FROM ww) q WHERE run >= 5e-1 * al GROUP BY ALL)""")
    return f"ww AS (SELECT *, {w} AS w FROM {source})," + ",".join(parts) + f""",
me AS (SELECT * FROM w_ndvi JOIN w_ndbi USING ({keys}, component_id) JOIN w_mndwi USING ({keys}, component_id))"""


M4_SQL = f"""
bs AS (SELECT block_size_m, component_id, (row // k) * (({B.width_sql('part')} + k - 1) // k) + col // k AS block, count(*) AS cells, median(ndvi) AS ndvi, median(ndbi) AS ndbi, median(mndwi) AS mndwi
  FROM dj, (VALUES (90, 3), (150, 5), (300, 10)) t(block_size_m, k) GROUP BY 1, 2, 3),
bd AS (SELECT * FROM bs, range({DRAWS}) d(draw)),
{shared_medians_sql('bd', 'block_size_m, draw', ('block_size_m', 'draw'))},
s2 AS (SELECT block_size_m, draw, component_id, (l + terrain) / 2e0 AS score FROM (SELECT *, {landscape_sql('block_size_m, draw')} AS l FROM me) q JOIN fx USING (component_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY block_size_m, draw ORDER BY score DESC, component_id) AS rank FROM s2)"""


@query("m4_w7_shared_block_bootstrap", f"""WITH {LAST_SQL}, {SITES_SQL}, {disc_sql('sites', 'component_id')}, {FIXED_SQL}, {M4_SQL}
{SUMMARY_SQL('block_size_m, component_id')} FROM x GROUP BY 1, 2""")
def m4(spark, folder):
    joined = raster.disc_join(sites(spark, folder), last_cells(spark, folder), [RADIUS], *GRID)
    draws = resample.shared_block_bootstrap(joined, fixed_terrain(spark, folder), B.CELL, B.grid_width(spark, folder, "part"), SIZES, DRAWS)
    return rounded(decision.summarise_ranks(draws, ["block_size_m", "component_id"]))


def terrain_cells(spark, folder):
    """Orders as a row-major longitude-latitude grid with three terrain layers."""
    width = B.grid_width(spark, folder, "orders")
    o = table(spark, folder, "orders")
    return o.select(F.floor(F.col("o_orderkey") / width).cast("bigint").alias("row"), (F.col("o_orderkey") % width).alias("col"),
                    F.col("o_totalprice").alias("slope"), (F.col("o_custkey") * 1.0).alias("wetness"), (F.col("o_orderkey") % 1009 * 1.0).alias("drainage_distance"))


TCELLS_SQL = f"""tc AS (SELECT o_orderkey // {B.width_sql('orders')} AS row, o_orderkey % {B.width_sql('orders')} AS col, o_totalprice AS slope, o_custkey * 1e0 AS wetness, o_orderkey % 1009 * 1e0 AS dd FROM orders)"""


def moved_sql(source: str, keys: tuple, reach: str) -> str:
    a = f"{UNIFORM_SQL('angle', *keys, 'component_id')} * 6.283185307179586e0"
    d = f"{reach} * sqrt({UNIFORM_SQL('distance', *keys, 'component_id')})"
    return f"""
mv0 AS (SELECT *, {d} * cos({a}) AS dx, {d} * sin({a}) AS dy FROM {source}),
mv AS (SELECT * REPLACE (x + dx AS x, y + dy AS y, longitude + dx / (111320e0 * cos(radians(latitude))) AS longitude, latitude + dy / 111132e0 AS latitude) FROM mv0)"""


def terrain_disc_sql(keys: str) -> str:
    k = ", ".join(f"p.{x}" for x in keys.split(", "))
    return f"""
td AS (SELECT {k}, round(quantile_cont(slope, 0.9), 9) AS s, round(quantile_cont(wetness, 0.9), 9) AS w, round(median(dd), 9) AS d FROM mv p JOIN tc c
  ON pow((72e0 + c.col * (1 / 3600e0) - p.longitude) * (111320e0 * cos(radians(p.latitude))), 2) + pow((34e0 - c.row * (1 / 3600e0) - p.latitude) * 111132e0, 2) <= {RADIUS} * {RADIUS} GROUP BY ALL)"""


REACHES, MOVES = [0, 30, 60], 12
M5_SQL = f"""
dr AS (SELECT s.*, reach_m, draw FROM sites s, (VALUES (0, 1), (30, {MOVES}), (60, {MOVES})) t(reach_m, n), range({MOVES}) d(draw) WHERE draw < n), {moved_sql('dr', ('reach_m', 'draw'), 'reach_m')}, {disc_sql('mv', 'reach_m, draw, component_id')},
me AS (SELECT reach_m, draw, component_id, median(ndvi) AS ndvi, median(ndbi) AS ndbi, median(mndwi) AS mndwi FROM dj GROUP BY 1, 2, 3), {TCELLS_SQL}, {terrain_disc_sql('reach_m, draw, component_id')},
tp AS (SELECT reach_m, draw, component_id, ({pct('s', 'reach_m, draw')} + {pct('w', 'reach_m, draw')} + {pct('-d', 'reach_m, draw')}) / 3e0 AS t FROM td),
s2 AS (SELECT reach_m, draw, component_id, (l + t) / 2e0 AS score FROM (SELECT *, {landscape_sql('reach_m, draw')} AS l FROM me) q JOIN tp USING (reach_m, draw, component_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY reach_m, draw ORDER BY score DESC, component_id) AS rank FROM s2)"""


@query("m5_j4_point_displacement", f"WITH {LAST_SQL}, {SITES_SQL}, {M5_SQL} {SUMMARY_SQL('reach_m, component_id')} FROM x GROUP BY 1, 2")
def m5(spark, folder):
    draws = resample.displacement_ranks(sites(spark, folder), last_cells(spark, folder), terrain_cells(spark, folder), RADIUS, GRID, (LAT0, LON0, STEP), REACHES, MOVES)
    return rounded(decision.summarise_ranks(draws, ["reach_m", "component_id"]))


STATES, DECISIONS = 500, 10


def joint(spark, folder):
    return resample.joint_draws(sites(spark, folder), last_cells(spark, folder), terrain_cells(spark, folder), RADIUS, GRID, (LAT0, LON0, STEP),
                                B.grid_width(spark, folder, "part"), STATES, DECISIONS, SIZES)


_cor = lambda a, b: f"abs(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})))"
M7_SQL = f"""
dr AS (SELECT s.*, spatial_state_id, [90, 150, 300][CAST(floor({UNIFORM_SQL('size', 'spatial_state_id')} * 3) AS BIGINT) + 1] AS block_size_m FROM sites s, range({STATES}) t(spatial_state_id)),
{moved_sql('dr', ('spatial_state_id',), '120e0')}, {disc_sql('mv', 'spatial_state_id, block_size_m, component_id')},
bs AS (SELECT spatial_state_id, block_size_m, component_id, (row // (block_size_m // 30)) * (({B.width_sql('part')} + block_size_m // 30 - 1) // (block_size_m // 30)) + col // (block_size_m // 30) AS block,
  count(*) AS cells, median(ndvi) AS ndvi, median(ndbi) AS ndbi, median(mndwi) AS mndwi FROM dj GROUP BY 1, 2, 3, 4),
{shared_medians_sql('bs', 'spatial_state_id, block_size_m', ('spatial_state_id', 'block_size_m'))},
ls AS (SELECT spatial_state_id, component_id, {landscape_sql('spatial_state_id')} AS l FROM me), {TCELLS_SQL}, {terrain_disc_sql('spatial_state_id, component_id')},
tp AS (SELECT spatial_state_id, component_id, {pct('s', 'spatial_state_id')} AS a, {pct('w', 'spatial_state_id')} AS b, {pct('-d', 'spatial_state_id')} AS c FROM td),
co AS (SELECT spatial_state_id, {_cor('a', 'b')} AS ab, {_cor('a', 'c')} AS ac, {_cor('b', 'c')} AS bc FROM tp GROUP BY 1),
iw AS (SELECT spatial_state_id, 1 / (1 + ab + ac) AS i0, 1 / (1 + ab + bc) AS i1, 1 / (1 + ac + bc) AS i2 FROM co),
tm AS (SELECT t.*, (a + b + c) / 3e0 AS equal_factors, i0 / (i0 + i1 + i2) * a + i1 / (i0 + i1 + i2) * b + i2 / (i0 + i1 + i2) * c AS correlation_adjusted, (a + c) / 2e0 AS reduced_slope_drainage FROM tp t JOIN iw USING (spatial_state_id)),
jd AS (SELECT spatial_state_id, decision_setting_id, component_id, l, {UNIFORM_SQL('weight', 'spatial_state_id', 'decision_setting_id')} AS w,
  ['equal_factors', 'correlation_adjusted', 'reduced_slope_drainage'][CAST(floor({UNIFORM_SQL('model', 'spatial_state_id', 'decision_setting_id')} * 3) AS BIGINT) + 1] AS model, equal_factors, correlation_adjusted, reduced_slope_drainage
  FROM ls JOIN tm USING (spatial_state_id, component_id), range({DECISIONS}) d(decision_setting_id)),
x0 AS (SELECT *, round(w * l + (1 - w) * CASE model WHEN 'equal_factors' THEN equal_factors WHEN 'correlation_adjusted' THEN correlation_adjusted ELSE reduced_slope_drainage END, 12) AS score FROM jd),
x AS (SELECT *, row_number() OVER (PARTITION BY spatial_state_id, decision_setting_id ORDER BY score DESC, component_id) AS rank FROM x0)"""


@query("m7_joint_uncertainty", f"""WITH {LAST_SQL}, {SITES_SQL}, {M7_SQL}
SELECT spatial_state_id, decision_setting_id, component_id, model AS terrain_model, {r('w')} AS landscape_weight, {r('score')} AS score, rank FROM x""")
def m7(spark, folder):
    return rounded(joint(spark, folder).select("spatial_state_id", "decision_setting_id", "component_id", "terrain_model", "landscape_weight", "score", "rank"))


@query("m7_m8_joint_summary", f"WITH {LAST_SQL}, {SITES_SQL}, {M7_SQL} {SUMMARY_SQL('component_id')} FROM x GROUP BY 1")
def m7_summary(spark, folder):
    return rounded(decision.summarise_ranks(joint(spark, folder), ["component_id"]))


# --- M9 to M12 on a decision table over epochs ---------------------------------------

L = scoring.LANDSCAPE
DEC, STEPS = 10, 200
STATES_SQL = f"""
st AS (SELECT s.epoch_id AS spatial_state_id, s.component_id, s.{L} AS l, t.equal_factors AS t0, t.correlation_adjusted AS t1, t.reduced_slope_drainage AS t2
  FROM scores s JOIN tf t ON t.component_id = s.component_id AND t.radius_m = s.radius_m WHERE s.radius_m = 1000)"""
FACTORIAL_SQL = STATES_SQL + f""",
fc AS (SELECT spatial_state_id, component_id, m, g, round(round(g / {STEPS}e0, 6) * l + (1 - round(g / {STEPS}e0, 6)) * CASE m WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END, 9) AS score FROM st, range(3) a(m), range({STEPS + 1}) b(g)),
rk AS (SELECT *, row_number() OVER (PARTITION BY spatial_state_id, m, g ORDER BY score DESC, component_id) AS rank FROM fc)"""
_M = scoring.TERRAIN_MODELS


def decision_draws(spark, folder):
    """Ten weight and formulation settings per epoch (as state) and brand."""
    from siterank.functions import keyed

    scores, _ = score_table(spark, folder)
    models = scoring.terrain_formulations(scoring.factor_frame(scores, LAST, 1000), ["radius_m"]).select("component_id", *_M)
    base = scores.where(F.col("radius_m") == 1000).select(F.col("epoch_id").alias("spatial_state_id"), "component_id", L).join(models, "component_id")
    d = base.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DEC - 1))))
    d = d.withColumns({"landscape_weight": keyed.uniform("decision", "spatial_state_id", "d"), "terrain_model": F.element_at(F.array(*map(F.lit, _M)), F.col("d") % 3 + 1)})
    t = F.coalesce(*[F.when(F.col("terrain_model") == m, F.col(m)) for m in _M])
    return d.select("spatial_state_id", "component_id", "landscape_weight", "terrain_model", (F.col("landscape_weight") * F.col(L) + (1 - F.col("landscape_weight")) * t).alias("score"))


@query("m9_affine_recovery", f"""WITH {score_sql()}, {FORMULATION_SQL}, {STATES_SQL}
SELECT spatial_state_id, component_id, {r('l')} AS "L", {r('t0')} AS T_equal_factors, {r('t1')} AS T_correlation_adjusted, {r('t2')} AS T_reduced_slope_drainage, true AS residual_ok FROM st""")
def recovery(spark, folder):
    draws = decision_draws(spark, folder)
    g = decision.recover_geometry(draws)
    res = decision.geometry_residual(draws, g)
    out = g.where("identified").join(res, ["spatial_state_id", "component_id"])
    return rounded(out.select("spatial_state_id", "component_id", "L", *[f"T_{m}" for m in _M], (F.col("max_residual") <= decision.RESIDUAL_TOLERANCE).alias("residual_ok")))


def factorial(spark, folder):
    draws = decision_draws(spark, folder)
    size = draws.agg(F.count_distinct("component_id"))
    return materialise(decision.factorial_ranks(decision.recover_geometry(draws), size.scalar(), STEPS))


@query("m10_j9_rank_acceptability", f"""WITH {score_sql()}, {FORMULATION_SQL}, {FACTORIAL_SQL},
a AS (SELECT component_id, avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS a1, avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS a3, avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS a5, median(rank) AS md,
  avg(g) FILTER (rank = 1) AS c, {', '.join(f'coalesce(count(*) FILTER (rank = 1 AND m = {i}) * 1e0 / nullif(count(*) FILTER (rank = 1), 0), 0) AS f{i}' for i in range(3))} FROM rk GROUP BY 1),
b AS (SELECT component_id, g, avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS conf FROM rk GROUP BY 1, 2)
SELECT component_id, {r('a1')} AS acceptability_rank1, {r('a3')} AS acceptability_top3, {r('a5')} AS acceptability_top5, {r('md')} AS median_rank, {r(f'c / {STEPS}e0')} AS central_landscape_weight,
  {r('coalesce(conf, 0)')} AS confidence_factor, {', '.join(f'{r(f"f{i}")} AS first_rank_share_{m}' for i, m in enumerate(_M))} FROM a LEFT JOIN b USING (component_id) WHERE b.g = ceil(round(c, 9) - 5e-1) OR (c IS NULL AND b.g = 0)""")
def acceptability(spark, folder):
    out = decision.acceptability(factorial(spark, folder), STEPS)
    return rounded(out)


_ss = lambda f: f"(SELECT component_id, var_pop(m) AS v FROM (SELECT component_id, {f}, avg(rank) AS m FROM rk GROUP BY ALL) q GROUP BY 1)"


@query("m11_variance_split", f"""WITH {score_sql()}, {FORMULATION_SQL}, {FACTORIAL_SQL}, v AS (SELECT component_id, var_pop(rank) AS v FROM rk GROUP BY 1),
j AS (SELECT v.component_id, v.v, s.v AS s, d.v AS d, w.v AS w, k.v AS k FROM v JOIN {_ss('spatial_state_id')} s USING (component_id) JOIN {_ss('m AS mm, g')} d USING (component_id) JOIN {_ss('g')} w USING (component_id) JOIN {_ss('m AS mm')} k USING (component_id))
SELECT component_id, {r('v')} AS rank_variance, {r('s / nullif(v, 0)')} AS fraction_spatial_support, {r('d / nullif(v, 0)')} AS fraction_decision, {r('w / nullif(v, 0)')} AS fraction_landscape_weight,
  {r('k / nullif(v, 0)')} AS fraction_terrain_formulation, {r('(v - s - d) / nullif(v, 0)')} AS fraction_interaction FROM j""")
def variance_split(spark, folder):
    return rounded(decision.variance_split(factorial(spark, folder)))


@query("m12_budget_curve", f"""WITH {score_sql()}, {FORMULATION_SQL}, {FACTORIAL_SQL},
o AS (SELECT component_id, row_number() OVER (ORDER BY avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) DESC, component_id) AS k FROM rk GROUP BY 1),
p AS (SELECT spatial_state_id, m, g, k FROM rk JOIN o USING (component_id) WHERE rank <= 3),
c AS (SELECT b.k, s.spatial_state_id, s.m, s.g, count(*) FILTER (p.k <= b.k) AS cov FROM o b, (SELECT DISTINCT spatial_state_id, m, g FROM p) s JOIN p USING (spatial_state_id, m, g) GROUP BY 1, 2, 3, 4),
f AS (SELECT k, avg(3 - cov) AS miss, avg(CASE WHEN cov = 3 THEN 1 ELSE 0 END) AS fl FROM c GROUP BY 1)
SELECT k AS inspection_budget_k, component_id AS component_added, {r('miss')} AS expected_top3_missed, {r('fl')} AS probability_full_coverage, {r('fl - coalesce(lag(fl) OVER (ORDER BY k), 0)')} AS marginal_coverage_gain FROM f JOIN o USING (k)""")
def budget(spark, folder):
    return rounded(decision.budget_curve(factorial(spark, folder)))


# --- classifier metrics --------------------------------------------------------------

K = 10


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("v"))


def centroids(e):
    """Mean vector of each class, packed in one row."""
    centre = e.select("y", F.posexplode("v").alias("i", "x")).groupBy("y", "i").agg(F.round(F.avg("x"), 9).alias("c")).groupBy("y").agg(
        F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s")).select("y", F.col("s.c").alias("c"))
    return centre.agg(F.array_sort(F.collect_list(F.struct("y", "c"))).alias("l"))


def centroid_probabilities(packed, e):
    """Nearest-centroid class probabilities at two sharpness settings; blocks are a 10 x 10 layout."""
    d2 = lambda v, c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, q: s + q)
    near = e.withColumn("_l", packed.scalar()).withColumn("_d", F.transform("_l", lambda k: d2(F.col("v"), k["c"])))
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(s).alias("s")) for n, s in (("sharp", 8.0), ("soft", 2.0))])
    out = near.withColumn("m", F.explode(models)).withColumn("_e", F.transform("_d", lambda d: F.exp(-F.col("m.s") * d)))
    # the soft model leaves every class distance to the next label, so that the models differ
    shifted = F.when(F.col("m.model") == "soft", F.concat(F.slice("_e", 10, 1), F.slice("_e", 1, 9))).otherwise(F.col("_e"))
    mixed = F.zip_with("_e", shifted, lambda a, b: a + b)
    total = F.aggregate(mixed, F.lit(0.0), lambda s, q: s + q)
    return out.select("m.model", F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("block"), "y", F.transform(mixed, lambda q: F.round(q / total, 9)).alias("p"))


def predictions(spark, folder):
    e = vectors(spark, folder)
    return centroid_probabilities(centroids(e), e)


PRED_SQL = f"""
ev AS (SELECT vec_id, label AS y, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
ce AS (SELECT y AS k, i, round(avg(x), 9) AS c FROM ev GROUP BY 1, 2),
ds AS (SELECT vec_id, ev.y, k, sum((x - c) * (x - c)) AS d FROM ev JOIN ce USING (i) GROUP BY 1, 2, 3),
ex AS (SELECT model, vec_id, y, k, exp(-s * d) AS e FROM ds, (VALUES ('sharp', 8e0), ('soft', 2e0)) m(model, s)),
mx AS (SELECT a.model, a.vec_id, a.y, a.k, a.e + b.e AS e FROM ex a JOIN ex b ON a.model = b.model AND a.vec_id = b.vec_id AND b.k = CASE WHEN a.model = 'soft' THEN (a.k + 9) % 10 ELSE a.k END),
pr AS (SELECT model, vec_id AS id, vec_id % 100 AS block, y, k, round(e / sum(e) OVER (PARTITION BY model, vec_id), 9) AS p FROM mx),
pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, id ORDER BY p DESC, k) AS i FROM pr) q WHERE i = 1),
pe AS (SELECT model, id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(10e0) AS entropy FROM pr GROUP BY 1, 2)"""


@query("l6_top_label", f"WITH {PRED_SQL} SELECT model, id, block, y, k AS prediction, {r('p')} AS confidence, {r('entropy')} AS entropy FROM pd JOIN pe USING (model, id)")
def top_label(spark, folder):
    return rounded(metrics.with_prediction(predictions(spark, folder)).select("model", "id", "block", "y", "prediction", "confidence", "entropy"))


@query("l7_confusion_matrix", f"WITH {PRED_SQL} SELECT model, y, {', '.join(f'count(*) FILTER (k = {k}) AS predicted_{k}' for k in range(K))} FROM pd GROUP BY 1, 2")
def confusion(spark, folder):
    return rounded(metrics.confusion_table(metrics.with_prediction(predictions(spark, folder)), K))


CLASS_SQL = f"""
pc AS (SELECT model, c.l AS label, count(*) FILTER (y = c.l) AS support, count(*) FILTER (k = c.l) AS predicted, count(*) FILTER (y = c.l AND k = c.l) AS hits FROM pd, range({K}) c(l) GROUP BY 1, 2),
pf AS (SELECT *, coalesce(hits * 1e0 / nullif(predicted, 0), 0) AS precision, coalesce(hits * 1e0 / nullif(support, 0), 0) AS recall, coalesce(2e0 * hits / nullif(predicted + support, 0), 0) AS f1 FROM pc)"""


@query("l7_per_class", f"WITH {PRED_SQL}, {CLASS_SQL} SELECT model, label, support, predicted, hits, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM pf")
def per_class(spark, folder):
    return rounded(metrics.per_class(metrics.confusion(metrics.with_prediction(predictions(spark, folder))), K))


@query("l7_l8_model_metrics", f"""WITH {PRED_SQL}, {CLASS_SQL}, sm AS (SELECT model, CAST(sum(support) AS BIGINT) AS n, sum(hits) * 1e0 / sum(support) AS overall_agreement, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1 FROM pf GROUP BY 1),
ls AS (SELECT model, -avg(ln(greatest(p, 1e-15))) FILTER (y = k) AS log_loss FROM pr GROUP BY 1),
br AS (SELECT model, avg(b) AS multiclass_brier FROM (SELECT model, id, sum(pow(p - CASE WHEN y = k THEN 1 ELSE 0 END, 2)) AS b FROM pr GROUP BY 1, 2) q GROUP BY 1)
SELECT model, n, {', '.join(f'{r(c)} AS {c}' for c in ('overall_agreement', 'balanced_accuracy', 'macro_f1', 'log_loss', 'multiclass_brier'))} FROM sm JOIN ls USING (model) JOIN br USING (model)""")
def model_metrics(spark, folder):
    p = metrics.with_prediction(predictions(spark, folder))
    return rounded(metrics.summary(metrics.confusion(p), K).join(metrics.probability_losses(p), "model"))


@query("l9_auroc_average_precision", f"""WITH {PRED_SQL},
rk AS (SELECT model, k AS label, y = k AS pos, p, rank() OVER (PARTITION BY model, k ORDER BY p) + (count(*) OVER (PARTITION BY model, k, p) - 1) / 2e0 AS rn, count(*) OVER (PARTITION BY model, k) AS n FROM pr),
au AS (SELECT model, label, (sum(rn) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2e0) / (count(*) FILTER (pos) * 1e0 * count(*) FILTER (NOT pos)) AS auroc FROM rk GROUP BY 1, 2),
th AS (SELECT model, label, p, count(*) FILTER (pos) AS pos, count(*) AS n FROM rk GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY model, label) AS tp FROM th WINDOW w AS (PARTITION BY model, label ORDER BY p DESC)),
ap AS (SELECT model, label, sum(pos * (cp * 1e0 / cn)) / min(tp) AS average_precision FROM cu GROUP BY 1, 2)
SELECT model, label, {r('auroc')} AS auroc, {r('average_precision')} AS average_precision FROM au JOIN ap USING (model, label)""")
def curves(spark, folder):
    return rounded(metrics.one_vs_rest(predictions(spark, folder)))


CAL_SQL = """
cb AS (SELECT model, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS count, avg(CASE WHEN y = k THEN 1 ELSE 0 END) AS accuracy, avg(p) AS mean_confidence FROM pd GROUP BY 1, 2),
cg AS (SELECT model, b.bin, coalesce(count, 0) AS count, accuracy, mean_confidence FROM (SELECT DISTINCT model FROM pd) m CROSS JOIN range(10) b(bin) LEFT JOIN cb USING (model, bin))"""


@query("l9_macro_curves")
def macro_curves(spark, folder):
    return rounded(metrics.macro_curves(metrics.one_vs_rest(predictions(spark, folder))))


@query("l10_calibration_table", f"WITH {PRED_SQL}, {CAL_SQL} SELECT model, bin, count, {r('accuracy')} AS accuracy, {r('mean_confidence')} AS mean_confidence, {r('bin / 1e1')} AS bin_left, {r('(bin + 1) / 1e1')} AS bin_right FROM cg")
def calibration(spark, folder):
    return rounded(metrics.calibration(metrics.with_prediction(predictions(spark, folder))))


@query("l10_calibration_error", f"WITH {PRED_SQL}, {CAL_SQL} SELECT model, {r('sum(count * abs(accuracy - mean_confidence)) / sum(count)')} AS ece FROM cg GROUP BY 1")
def calibration_error(spark, folder):
    return rounded(metrics.expected_calibration_error(metrics.calibration(metrics.with_prediction(predictions(spark, folder)))))


OOF, T_POINTS, T_ROUNDS = 5, 16, 3
OOF_SQL = f"""
ev AS (SELECT vec_id, vec_id % 100 // 20 AS fold, label AS y, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
ce AS (SELECT f.fold, y AS k, i, round(avg(x), 9) AS c FROM ev, (SELECT DISTINCT fold FROM ev) f WHERE ev.fold <> f.fold GROUP BY 1, 2, 3),
ds AS (SELECT vec_id, ev.y, k, sum((x - c) * (x - c)) AS d FROM ev JOIN ce USING (fold, i) GROUP BY 1, 2, 3),
ex AS (SELECT model, vec_id, y, k, exp(-s * d) AS e FROM ds, (VALUES ('sharp', 8e0), ('soft', 2e0)) m(model, s)),
mx AS (SELECT a.model, a.vec_id, a.y, a.k, a.e + b.e AS e FROM ex a JOIN ex b ON a.model = b.model AND a.vec_id = b.vec_id AND b.k = CASE WHEN a.model = 'soft' THEN (a.k + 9) % 10 ELSE a.k END),
oo AS (SELECT model, vec_id AS id, y, k, round(e / sum(e) OVER (PARTITION BY model, vec_id), 9) AS p FROM mx)"""


def _loss_sql(name: str, grid: str) -> str:
    """Log loss of every model at the temperatures of ``grid`` (model, t)."""
    return f"""{name} AS (SELECT model, t, -avg(ln(greatest(q, 1e-15))) AS loss FROM (SELECT model, t, id, y, k, e / sum(e) OVER (PARTITION BY model, t, id) AS q
  FROM (SELECT o.model, g.t, id, y, k, exp(ln(greatest(p, 1e-12)) / g.t) AS e FROM oo o JOIN {grid} g USING (model))) WHERE y = k GROUP BY 1, 2)"""


def _temperature_sql() -> str:
    out = ["b0 AS (SELECT DISTINCT model, 25e-2 AS low, 4e0 AS high FROM oo)"]
    for i in range(1, T_ROUNDS + 1):
        out.append(f"g{i} AS (SELECT model, low + s * ((high - low) / {T_POINTS - 1}) AS t, low, high FROM b{i - 1}, range({T_POINTS}) r(s))")
        out.append(_loss_sql(f"l{i}", f"g{i}"))
        out.append(f"b{i} AS (SELECT model, t, greatest(low, t - step) AS low, least(high, t + step) AS high FROM (SELECT model, arg_min(t, {{'l': round(loss, 12), 't': t}}) AS t FROM l{i} GROUP BY 1) JOIN (SELECT model, low, high, (high - low) / {T_POINTS - 1} AS step FROM b{i - 1}) USING (model))")
    out.append(f"stages AS (SELECT model, 'raw' AS stage, 1e0 AS t FROM b0 UNION ALL SELECT model, 'scaled', t FROM b{T_ROUNDS})")
    out.append(_loss_sql("lb", "stages"))
    return ", ".join(out)


@query("l11_temperature_scaling", f"WITH {OOF_SQL}, {_temperature_sql()} SELECT model, stage, {r('t', 4)} AS t, {r('loss')} AS log_loss FROM stages JOIN lb USING (model, t)")
def temperature(spark, folder):
    e = vectors(spark, folder).withColumn("fold", F.floor(F.col("vec_id") % 100 / 20))
    held_out = benchmark.out_of_fold(e, "fold", OOF, centroids, centroid_probabilities)
    best = metrics.fit_temperature(held_out, points=T_POINTS, rounds=T_ROUNDS)
    each = held_out.join(best, "model")
    stages = F.array(F.struct(F.lit("raw").alias("stage"), F.lit(1.0).alias("t")), F.struct(F.lit("scaled").alias("stage"), F.col("temperature").alias("t")))
    scaled = each.select("model", "y", "p", F.explode(stages).alias("s")).select("model", "y", "s.stage", "s.t", metrics.temperature_scaled(F.col("p"), F.col("s.t")).alias("p"))
    return scaled.groupBy("model", "stage", "t").agg(metrics.log_loss().alias("log_loss")).select("model", "stage", (F.round("t", 4) + 0.0).alias("t"), (F.round("log_loss", 6) + 0.0).alias("log_loss"))


BLOCK_DRAWS = 2000
BLOCK_SQL = f"""
bk AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS slot, count(*) OVER () AS nb FROM (SELECT DISTINCT block FROM pd)),
pk AS (SELECT draw, CAST(floor({UNIFORM_SQL('test_blocks', 'draw', 'slot')} * nb) AS BIGINT) AS slot FROM bk, range({BLOCK_DRAWS}) d(draw)),
sm AS (SELECT p.draw, pd.model, pd.y, pd.k FROM pk p JOIN bk b ON b.slot = p.slot JOIN pd ON pd.block = b.block),
dc AS (SELECT draw, model, c.l AS label, count(*) FILTER (y = c.l) AS support, count(*) FILTER (k = c.l) AS predicted, count(*) FILTER (y = c.l AND k = c.l) AS hits FROM sm, range({K}) c(l) GROUP BY 1, 2, 3),
dd AS (SELECT draw, model, avg(coalesce(2e0 * hits / nullif(predicted + support, 0), 0)) AS macro_f1 FROM dc GROUP BY 1, 2)"""


def f1_draws(spark, folder):
    return metrics.block_draws(metrics.with_prediction(predictions(spark, folder)), K, BLOCK_DRAWS)


@query("m14_block_bootstrap_f1", f"WITH {PRED_SQL}, {BLOCK_SQL} SELECT model, {r('quantile_cont(macro_f1, 0.025)')} AS macro_f1_ci_low_95, {r('quantile_cont(macro_f1, 0.975)')} AS macro_f1_ci_high_95 FROM dd GROUP BY 1")
def block_f1(spark, folder):
    return rounded(metrics.draw_interval(f1_draws(spark, folder), "macro_f1"))


@query("m15_paired_difference", f"""WITH {PRED_SQL}, {BLOCK_SQL}, p AS (SELECT a.model, b.macro_f1 - a.macro_f1 AS delta FROM dd a JOIN dd b ON a.draw = b.draw AND b.model = 'sharp' AND a.model <> 'sharp')
SELECT 'sharp' AS primary, model AS comparator, {r('avg(delta)')} AS mean_delta, {r('quantile_cont(delta, 0.025)')} AS ci_low, {r('quantile_cont(delta, 0.975)')} AS ci_high FROM p GROUP BY 2""".replace("AS primary,", 'AS "primary",'))
def paired(spark, folder):
    return rounded(metrics.paired_difference(f1_draws(spark, folder), "sharp"))


@query("m15_probability_best", f"""WITH {PRED_SQL}, {BLOCK_SQL}, b AS (SELECT draw, model, row_number() OVER (PARTITION BY draw ORDER BY macro_f1 DESC, model) AS i FROM dd)
SELECT model, count(*) AS wins, {r(f'count(*) / {BLOCK_DRAWS}e0')} AS probability_best FROM b WHERE i = 1 GROUP BY 1""")
def best(spark, folder):
    return rounded(metrics.probability_best(f1_draws(spark, folder)))
