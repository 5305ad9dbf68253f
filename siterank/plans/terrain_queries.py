"""Terrain layers of the order grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siterank.operators import raster, spatial, terrain
from siterank.plans import bindings as B
from siterank.plans.registry import query, r, rounded, row_count, table
from siterank.plans.resample_queries import LAT0, LON0, STEP, SITES_SQL, sites
from siterank.functions.columns import block_id, split_role

CELL_Y, CELL_X = 30.87, 25.7
TPI = 33


def dem_width(spark, folder) -> int:
    """Largest divisor of the number of orders up to its square root, so that the grid is a full rectangle."""
    n = row_count(spark, folder, "orders")
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def dem(spark, folder):
    w = dem_width(spark, folder)
    return table(spark, folder, "orders").select(F.floor(F.col("o_orderkey") / w).cast("bigint").alias("row"), (F.col("o_orderkey") % w).alias("col"),
                                                 F.round(F.col("o_totalprice") / 1000).alias("elev"))


WIDTH_SQL = "(SELECT max(d) FROM range(1, 100000) t(d), (SELECT count(*) AS n FROM orders) WHERE n % d = 0 AND d * d <= n)"
DEM_SQL = f"""wq AS (SELECT {WIDTH_SQL} AS w, count(*) AS n FROM orders),
dem AS (SELECT o_orderkey // w AS row, o_orderkey % w AS col, round(o_totalprice / 1000) AS elev FROM orders, wq)"""


def focal_sql(size: int, value: str) -> str:
    """Sums along the columns, then of these along the rows, with edge cells repeated."""
    k = size // 2
    return f"""SELECT a.row, a.col, sum(b.v) AS v FROM dem a, wq, range(-{k}, {k + 1}) c(dc), (SELECT a.row, a.col, sum({value}) AS v FROM dem a, wq, range(-{k}, {k + 1}) r(dr), dem b
  WHERE b.row = least(greatest(a.row + dr, 0), n // w - 1) AND b.col = a.col GROUP BY 1, 2) b WHERE b.row = a.row AND b.col = least(greatest(a.col + dc, 0), w - 1) GROUP BY 1, 2"""


@query("g1_roughness", f"""WITH {DEM_SQL}, s AS ({focal_sql(3, 'b.elev')}), q AS ({focal_sql(3, 'b.elev * b.elev')}), t AS ({focal_sql(TPI, 'b.elev')})
SELECT row, col, {r('sqrt(greatest(q.v / 9 - (s.v / 9) * (s.v / 9), 0))')} AS tri, {r(f'elev - t.v / {TPI * TPI}', 7)} AS tpi FROM dem JOIN s USING (row, col) JOIN q USING (row, col) JOIN t USING (row, col)""")
def roughness(spark, folder):
    out = terrain.roughness(dem(spark, folder), 3, TPI)
    return out.select("row", "col", (F.round("tri", 6) + 0.0).alias("tri"), (F.round("tpi", 7) + 0.0).alias("tpi"))


SLOPE_SQL = f"""
gr AS (SELECT *, CASE WHEN lag(elev) OVER v IS NULL THEN (lead(elev) OVER v - elev) / {CELL_Y}e0 WHEN lead(elev) OVER v IS NULL THEN (elev - lag(elev) OVER v) / {CELL_Y}e0 ELSE (lead(elev) OVER v - lag(elev) OVER v) / (2 * {CELL_Y}e0) END AS gy,
  CASE WHEN lag(elev) OVER h IS NULL THEN (lead(elev) OVER h - elev) / {CELL_X}e0 WHEN lead(elev) OVER h IS NULL THEN (elev - lag(elev) OVER h) / {CELL_X}e0 ELSE (lead(elev) OVER h - lag(elev) OVER h) / (2 * {CELL_X}e0) END AS gx
  FROM dem WINDOW v AS (PARTITION BY col ORDER BY row), h AS (PARTITION BY row ORDER BY col)),
sp AS (SELECT row, col, elev, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM gr)"""


@query("g2_slope", f"WITH {DEM_SQL}, {SLOPE_SQL} SELECT row, col, {r('slope_deg')} AS slope_deg FROM sp")
def slope(spark, folder):
    return rounded(terrain.slope(dem(spark, folder), CELL_Y, CELL_X).select("row", "col", "slope_deg"))


_dirs = ", ".join(f"({i}, {dr}, {dc}, {math.hypot(CELL_Y * dr, CELL_X * dc)!r}::DOUBLE)" for i, (dr, dc) in enumerate(terrain.DIRECTIONS))
D8_SQL = f"""
nb AS (SELECT a.row, a.col, b.row AS tr, b.col AS tc, i, CAST((a.elev - b.elev) / dist AS FLOAT) AS fall FROM dem a, (VALUES {_dirs}) d(i, dr, dc, dist), dem b WHERE b.row = a.row + dr AND b.col = a.col + dc),
rc AS (SELECT dem.row, dem.col, tr AS to_row, tc AS to_col FROM dem LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, i) AS k FROM nb WHERE fall > 0) z WHERE k = 1) y USING (row, col))"""


@query("g3_d8_receiver", f"WITH {DEM_SQL}, {D8_SQL} SELECT row, col, to_row, to_col FROM rc")
def d8(spark, folder):
    return terrain.d8_receiver(dem(spark, folder), CELL_Y, CELL_X).select("row", "col", "to_row", "to_col")


FLOW_SQL = D8_SQL + """,
fp AS (SELECT a.row AS r0, a.col AS c0, a.row AS row, a.col AS col FROM dem a UNION ALL SELECT f.r0, f.c0, rc.to_row, rc.to_col FROM fp f JOIN rc ON rc.row = f.row AND rc.col = f.col WHERE rc.to_row IS NOT NULL),
fl AS (SELECT row, col, count(*) AS flow FROM fp GROUP BY 1, 2)"""


def flow_table(spark, folder):
    return terrain.flow_accumulation(terrain.d8_receiver(dem(spark, folder), CELL_Y, CELL_X), dem_width(spark, folder))


@query("g4_flow_accumulation", f"WITH RECURSIVE {DEM_SQL}, {FLOW_SQL} SELECT row, col, flow FROM fl")
def flow(spark, folder):
    return flow_table(spark, folder)


@query("g5_wetness", f"""WITH RECURSIVE {DEM_SQL}, {FLOW_SQL}, {SLOPE_SQL}
SELECT row, col, {r(f'ln((flow + 1) * sqrt({CELL_X}e0 * {CELL_Y}e0)) - ln(tan(radians(greatest(slope_deg, 5e-2))) + 1e-2)')} AS wetness FROM fl JOIN sp USING (row, col)""")
def wetness(spark, folder):
    both = flow_table(spark, folder).join(terrain.slope(dem(spark, folder), CELL_Y, CELL_X), ["row", "col"])
    return rounded(both.select("row", "col", terrain.wetness(F.col("flow"), F.col("slope_deg"), CELL_Y, CELL_X).alias("wetness")))


DRAIN_SQL = FLOW_SQL + f""",
dg AS (SELECT row AS dr, col AS dc FROM fl WHERE flow >= (SELECT quantile_cont(flow, 0.99) FROM fl)),
dd AS (SELECT row, col, sqrt(min(pow((row - dr) * {CELL_Y}e0, 2) + pow((col - dc) * {CELL_X}e0, 2))) AS distance FROM fl, dg GROUP BY 1, 2)"""


@query("g6_j13_drainage_distance", f"WITH RECURSIVE {DEM_SQL}, {DRAIN_SQL} SELECT row, col, {r('distance')} AS distance FROM dd")
def drainage(spark, folder):
    return rounded(terrain.drainage_distance(flow_table(spark, folder), CELL_Y, CELL_X))


@query("g7_terrain_support")
def support(spark, folder):
    layers = terrain.terrain_layers(dem(spark, folder), dem_width(spark, folder), CELL_Y, CELL_X)
    points = sites(spark, folder)
    joined = raster.lonlat_disc_cells(points, [250, 500, 1000], LAT0, LON0, STEP).join(layers, ["row", "col"])
    return rounded(terrain.support_summary(joined, ["component_id", "radius_m"]))


@query("j4_lonlat_disc", f"""WITH {SITES_SQL}, {DEM_SQL}
SELECT component_id, radius_m, count(*) AS cells, {r('avg(elev)')} AS mean_elev FROM sites p, dem c, (VALUES (250), (500), (1000)) t(radius_m)
WHERE pow((72e0 + c.col * (1 / 3600e0) - p.longitude) * (111320e0 * cos(radians(p.latitude))), 2) + pow((34e0 - c.row * (1 / 3600e0) - p.latitude) * 111132e0, 2) <= radius_m * radius_m GROUP BY 1, 2""")
def lonlat_disc(spark, folder):
    joined = raster.lonlat_disc_cells(sites(spark, folder), [250, 500, 1000], LAT0, LON0, STEP).join(dem(spark, folder), ["row", "col"])
    return rounded(joined.groupBy("component_id", "radius_m").agg(F.count(F.lit(1)).alias("cells"), F.avg("elev").alias("mean_elev")))


@query("j12_train_test_separation", f"""WITH {DEM_SQL}, b AS (SELECT row, col, ((row // 5) * ((w + 4) // 5) + col // 5) % 10 AS c FROM dem, wq),
te AS (SELECT * FROM b WHERE c IN (3, 4)), de AS (SELECT * FROM b WHERE c NOT IN (2, 3, 4, 5))
SELECT {r('sqrt(min(pow((t.row - d.row) * 30e0, 2) + pow((t.col - d.col) * 30e0, 2)))')} AS minimum_distance_m FROM te t JOIN de d ON abs(t.row - d.row) <= 6 AND abs(t.col - d.col) <= 12""")
def separation(spark, folder):
    cells = dem(spark, folder).withColumn("role", split_role(block_id("row", "col", 150, 30.0, dem_width(spark, folder))))
    near = spatial.nearest_on_grid(cells.where(F.col("role") == "test"), cells.where(F.col("role") == "development"), [], 30.0, 30.0)
    return rounded(near.agg(F.min("distance").alias("minimum_distance_m")))
