"""The given tables seen as the data model of the operators, in Spark and as SQL text.

Places are brands or suppliers, periods are shipping years, neighbourhood radii are nested
quantity limits, raster cells are parts, daily weather is the daily flow of line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from siterank.functions.columns import nested_levels, reflectance
from siterank.operators.lineage import materialise
from siterank.operators.order import by_size, quantiles_of_cells, quantiles_wide
from siterank.operators.scoring import fixed_scores
from siterank.plans.registry import row_count, table

LAST_EPOCH = "E2001"
RADIUS_LIMITS = {250: 10.0, 500: 25.0, 1000: 50.0}


#: Entities whose number the data model fixes: ranks within one radius run as plain windows. Suppliers grow with the data.
FIXED_INVENTORIES = frozenset({"p_brand"})


# --- score frame ---------------------------------------------------------------------

def component_lines(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """Line items with their component, epoch and measures."""
    return table(spark, folder, "lineitem").select(
        F.col(entity).alias("component_id"), F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("epoch_id"),
        F.col("l_discount").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_quantity").alias("c"),
        (F.col("l_orderkey") % 1000).cast("double").alias("e"))


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """Lines once per radius whose quantity limit they meet."""
    return lines.withColumns({"radius_m": F.explode(nested_levels(F.col("c"), RADIUS_LIMITS)), "d": F.col("b") / F.col("c")})


def spectral_summary(lines: DataFrame, bounded: bool = False) -> DataFrame:
    wide = quantiles_wide(lines, ["component_id", "radius_m", "epoch_id"], {"ndvi": "a", "ndbi": "b", "mndwi": "c"}, {"median": 0.5}, bounded=bounded)
    return wide.select("component_id", "radius_m", "epoch_id",
                       *[F.round(f"{m}_median", 9).alias(f"{m}_median") for m in ("ndvi", "ndbi", "mndwi")])


def terrain_summary(lines: DataFrame, bounded: bool = False) -> DataFrame:
    wide = quantiles_wide(lines, ["component_id", "radius_m"], {"d": "d", "b": "b", "e": "e"}, {"q90": 0.9, "q50": 0.5}, bounded=bounded)
    return wide.select("component_id", "radius_m", F.round("d_q90", 9).alias("slope_p90_deg"),
                       F.round("b_q90", 9).alias("twi_proxy_p90"), F.round("e_q50", 9).alias("drainage_distance_median_m"))


RINGS = sorted(RADIUS_LIMITS, key=RADIUS_LIMITS.get)
#: Shares a year's place in a cell number; a line without a date has the last one.
NO_YEAR = (1 << 15) - 1


def inventory_summaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``spectral_summary`` and ``terrain_summary`` of the brands: few components of many lines each.

    A line lies in one cell of component, year and ring (the least radius that holds it), and is read twice for all radii and both summaries.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    brands = materialise(part.select(F.col("p_brand").alias("component_id")).distinct().select("component_id", (F.row_number().over(W.orderBy("component_id")) - 1).cast("bigint").alias("_brand")))
    part = part.join(F.broadcast(brands), F.col("p_brand").eqNullSafe(F.col("component_id"))).select("p_partkey", "_brand")
    ring = F.lit(None).cast("int")
    for i, radius in reversed(list(enumerate(RINGS))):
        ring = F.when(F.col("l_quantity") <= RADIUS_LIMITS[radius], i).otherwise(ring)
    year = F.coalesce(F.year("l_shipdate"), F.lit(NO_YEAR))
    items = table(spark, folder, "lineitem").select(
        "l_partkey", year.alias("_year"), ring.alias("_ring"), F.col("l_discount").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_quantity").alias("c"),
        (F.col("l_orderkey") % 1000).cast("double").alias("e")).where(F.col("_ring").isNotNull())
    place = F.shiftleft(F.col("_year").cast("bigint"), 2) + F.col("_ring")
    items = items.select("l_partkey", place.alias("_place"), "a", "b", "c", "e")
    # hashed, not merged: the parts of a task's share are few beside its lines, so the lines need no sorting
    joined = items.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    lines = materialise(joined.select((F.shiftleft("_brand", 17) + F.col("_place")).alias("cell"), "a", "b", "c", "e"))
    cells = materialise(lines.select("cell").distinct()).select(
        "cell", F.shiftright("cell", 17).alias("_brand"), F.shiftright("cell", 2).bitwiseAND(F.lit(NO_YEAR)).alias("_year"), F.col("cell").bitwiseAND(F.lit(3)).alias("_ring"))
    radii = F.array(*[F.struct(F.lit(i).alias("_least"), F.lit(r).alias("radius_m")) for i, r in enumerate(RINGS)])
    groups = cells.join(F.broadcast(brands), "_brand").select("*", F.explode(radii).alias("_r")).where(F.col("_ring") <= F.col("_r._least")).select(
        "cell", "component_id", "_r.radius_m", F.when(F.col("_year") != NO_YEAR, F.concat(F.lit("E"), F.col("_year").cast("string"))).alias("epoch_id"))
    spectral = {"ndvi_median": ("a", 0.5), "ndbi_median": ("b", 0.5), "mndwi_median": ("c", 0.5)}
    terrain = {"slope_p90_deg": ("d", 0.9), "twi_proxy_p90": ("b", 0.9), "drainage_distance_median_m": ("e", 0.5)}
    keys = ["component_id", "radius_m", "epoch_id", "summary"]
    ask = lambda kind, names: {"summary": F.lit(kind), "outputs": F.array(*map(F.lit, names))}
    both = groups.withColumns(ask("spectral", spectral)).unionByName(groups.withColumn("epoch_id", F.lit(None).cast("string")).withColumns(ask("terrain", terrain)))
    found = materialise(quantiles_of_cells(lines, {"a": "a", "b": "b", "c": "c", "d": F.col("b") / F.col("c"), "e": "e"}, both, keys, spectral | terrain))
    shape = lambda kind, by, names: found.where(F.col("summary") == kind).select(*by, *[F.round(n, 9).alias(n) for n in names])
    return shape("spectral", keys[:3], spectral), shape("terrain", keys[:2], terrain)


def score_table(spark: SparkSession, folder: str, entity: str = "p_brand") -> tuple[DataFrame, bool]:
    """Scores of all components, radii and epochs, and whether the model bounds that inventory."""
    bounded = entity in FIXED_INVENTORIES
    if bounded:
        parts = inventory_summaries(spark, folder)
    else:
        lines = component_lines(spark, folder, entity)
        parts = tuple(by_size(lines, "component_id", lambda rows, small: f(neighbourhoods(rows), small)) for f in (spectral_summary, terrain_summary))
        parts = map(materialise, parts)
    return fixed_scores(*parts, LAST_EPOCH, bounded=bounded), bounded


def score_sql(entity: str = "p_brand") -> str:
    """CTE chain ending in ``scores`` and ``frame`` (the last epoch)."""
    def pct(value: str, part: str) -> str:
        return (f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {value}) - 1 "
                f"+ count(*) OVER (PARTITION BY {part}, {value}) / 2e0) / count({value}) OVER (PARTITION BY {part}) END")

    return f"""
li AS (SELECT {entity} AS component_id, radius_m, 'E' || CAST(year(l_shipdate) AS VARCHAR) AS epoch_id,
    l_discount AS a, l_extendedprice AS b, l_quantity AS c, l_extendedprice / l_quantity AS d, CAST(l_orderkey % 1000 AS DOUBLE) AS e
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN (VALUES (250, 10), (500, 25), (1000, 50)) t(radius_m, qmax) ON l_quantity <= qmax),
sp AS (SELECT component_id, radius_m, epoch_id, round(quantile_cont(a, 0.5), 9) AS ndvi_median,
    round(quantile_cont(b, 0.5), 9) AS ndbi_median, round(quantile_cont(c, 0.5), 9) AS mndwi_median
  FROM li GROUP BY ALL),
te AS (SELECT component_id, radius_m, round(quantile_cont(d, 0.9), 9) AS slope_p90_deg,
    round(quantile_cont(b, 0.9), 9) AS twi_proxy_p90, round(quantile_cont(e, 0.5), 9) AS drainage_distance_median_m
  FROM li GROUP BY ALL),
sp2 AS (SELECT *, {pct('-ndvi_median', 'radius_m')} AS ndvi_pressure, {pct('ndbi_median', 'radius_m')} AS ndbi_pressure,
    {pct('-mndwi_median', 'radius_m')} AS mndwi_pressure FROM sp),
te2 AS (SELECT *, {pct('slope_p90_deg', 'radius_m')} AS slope_pressure, {pct('twi_proxy_p90', 'radius_m')} AS wetness_pressure,
    {pct('-drainage_distance_median_m', 'radius_m')} AS drainage_proximity_pressure FROM te),
sc0 AS (SELECT s.*, t.slope_pressure, t.wetness_pressure, t.drainage_proximity_pressure,
    (ndvi_pressure + ndbi_pressure) / 2e0 AS surface_cover_pressure,
    ((ndvi_pressure + ndbi_pressure) / 2e0 + mndwi_pressure) / 2e0 AS landscape_pressure_score,
    (slope_pressure + wetness_pressure + drainage_proximity_pressure) / 3e0 AS terrain_susceptibility_score
  FROM sp2 s LEFT JOIN te2 t USING (component_id, radius_m)),
sc1 AS (SELECT *, (landscape_pressure_score + terrain_susceptibility_score) / 2e0 AS local_priority_score FROM sc0),
scores AS (SELECT *, CASE WHEN epoch_id = '{LAST_EPOCH}' THEN row_number() OVER (PARTITION BY radius_m, epoch_id
    ORDER BY local_priority_score DESC, component_id) END AS fixed_rank FROM sc1),
frame AS (SELECT * FROM scores WHERE epoch_id = '{LAST_EPOCH}')"""


SPEARMAN_SQL = """corr(rx, ry)"""


def ranks_sql(source: str, keys: str, x: str, y: str) -> str:
    """Rows of ``source`` with complete pairs and average ranks rx, ry within ``keys``."""
    part = f"PARTITION BY {keys}" if keys else ""
    comma = ", " if keys else ""
    avg = lambda v: (f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}{comma}{v}) - 1) / 2e0)")
    return f"SELECT *, {avg(x)} AS rx, {avg(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


# --- raster cells --------------------------------------------------------------------

GRID_XMIN, GRID_YMAX, CELL = 292980.0, 3748620.0, 30.0
GRID_XMIN_SQL, GRID_YMAX_SQL = "292980e0", "3748620e0"


def grid_width(spark: SparkSession, folder: str, name: str) -> int:
    """Power of two near the square root of the table size (a count from the file footers)."""
    import math

    return int(2 ** math.ceil(math.log2(math.sqrt(row_count(spark, folder, name)))))


def width_sql(name: str) -> str:
    return f"(SELECT CAST(pow(2, ceil(log2(sqrt(count(*))))) AS BIGINT) FROM {name})"


def dn_columns() -> dict:
    """Integer digital numbers of six bands from the line-item measures."""
    return {
        "blue": F.expr("cast(8000 + l_quantity * 100 as int)"),
        "green": F.expr("cast(round(8000 + l_tax * 100000) as int)"),
        "red": F.expr("cast(round(7500 + l_discount * 100000) as int)"),
        "nir08": F.expr("cast(8000 + floor(l_extendedprice / 10) as int)"),
        "swir16": F.expr("cast(7800 + l_orderkey * 37 % 9000 as int)"),
        "swir22": F.expr("cast(7600 + l_orderkey * 101 % 8000 as int)"),
    }


def scene_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scene and pixel; a part is a pixel, a shipping month and platform is a scene."""
    width = grid_width(spark, folder, "part")
    items = table(spark, folder, "lineitem")
    platform = F.expr("CASE WHEN l_shipdate < TIMESTAMP_NTZ '1996-01-01' THEN 'landsat-7' WHEN l_returnflag = 'A' THEN 'landsat-7' "
                      "WHEN l_returnflag = 'N' THEN 'landsat-8' ELSE 'landsat-9' END")
    return items.select(
        F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("epoch_id"),
        F.concat(F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM"), F.lit("/"), platform).alias("scene_id"),
        platform.alias("platform"),
        F.floor(F.col("l_partkey") / width).cast("bigint").alias("row"), (F.col("l_partkey") % width).alias("col"),
        *[c.alias(n) for n, c in dn_columns().items()],
        F.expr("cast(if(l_orderkey % 11 = 0, shiftleft(1, l_linenumber % 6), 64) as int)").alias("qa_pixel"),
        F.expr("cast(if(l_suppkey % 97 = 0, 1, 0) as int)").alias("qa_radsat"),
        F.expr("cast((l_orderkey % 64) * 4 + 2 * (l_linenumber % 2) + if(l_orderkey % 17 = 0, 1, 0) as int)").alias("qa_aerosol"))


def scene_pixels_sql() -> str:
    platform = ("CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'landsat-7' WHEN l_returnflag = 'A' THEN 'landsat-7' "
                "WHEN l_returnflag = 'N' THEN 'landsat-8' ELSE 'landsat-9' END")
    return f"""
px AS (SELECT 'E' || CAST(year(l_shipdate) AS VARCHAR) AS epoch_id, strftime(l_shipdate, '%Y-%m') || '/' || {platform} AS scene_id,
    {platform} AS platform, l_partkey // {width_sql('part')} AS row, l_partkey % {width_sql('part')} AS col,
    CAST(floor(8000 + l_quantity * 100) AS INTEGER) AS blue, CAST(round(8000 + l_tax * 100000) AS INTEGER) AS green,
    CAST(round(7500 + l_discount * 100000) AS INTEGER) AS red, CAST(8000 + floor(l_extendedprice / 10) AS INTEGER) AS nir08,
    CAST(7800 + l_orderkey * 37 % 9000 AS INTEGER) AS swir16, CAST(7600 + l_orderkey * 101 % 8000 AS INTEGER) AS swir22,
    CAST(CASE WHEN l_orderkey % 11 = 0 THEN 1 << CAST(l_linenumber % 6 AS INTEGER) ELSE 64 END AS INTEGER) AS qa_pixel,
    CAST(CASE WHEN l_suppkey % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS qa_radsat,
    CAST((l_orderkey % 64) * 4 + 2 * (l_linenumber % 2) + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS INTEGER) AS qa_aerosol
  FROM lineitem),
pq AS (SELECT *, base AND (platform NOT IN ('landsat-8', 'landsat-9') OR ((qa_aerosol & 2) <> 0 AND (qa_aerosol & 32) = 0)) AS strict
  FROM (SELECT *, (qa_pixel & 63) = 0 AND qa_radsat = 0 AND (platform NOT IN ('landsat-8', 'landsat-9')
    OR ((qa_aerosol & 1) = 0 AND ((qa_aerosol >> 6) & 3) <> 3)) AS base FROM px) q)"""


def index_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Spectral indices per (epoch, cell) from mean digital numbers, with a mapped class."""
    width = grid_width(spark, folder, "part")
    items = table(spark, folder, "lineitem")
    means = items.groupBy(
        F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("epoch_id"), F.col("l_partkey").alias("k")
    ).agg(*[F.avg(c).alias(n) for n, c in dn_columns().items()], (F.max("l_linenumber") % 7).cast("bigint").alias("lc_class"))
    sr = {n: reflectance(F.col(n)) for n in dn_columns()}
    nd = lambda p, q: F.try_divide(p - q, p + q)
    return means.select(
        "epoch_id", F.floor(F.col("k") / width).cast("bigint").alias("row"), (F.col("k") % width).alias("col"),
        nd(sr["nir08"], sr["red"]).alias("ndvi"), nd(sr["swir16"], sr["nir08"]).alias("ndbi"),
        nd(sr["green"], sr["swir16"]).alias("mndwi"),
        nd(sr["swir16"] + sr["red"], sr["nir08"] + sr["blue"]).alias("bsi"), "lc_class")


def index_cells_sql() -> str:
    sr = lambda b: f"({b} * 2.75e-5 + -2e-1)"
    nd = lambda p, q: f"(({p}) - ({q})) / nullif(({p}) + ({q}), 0)"
    b = {n: sr(n) for n in ("blue", "green", "red", "nir08", "swir16", "swir22")}
    return f"""
cm AS (SELECT 'E' || CAST(year(l_shipdate) AS VARCHAR) AS epoch_id, l_partkey AS k,
    avg(CAST(floor(8000 + l_quantity * 100) AS INTEGER)) AS blue, avg(CAST(round(8000 + l_tax * 100000) AS INTEGER)) AS green,
    avg(CAST(round(7500 + l_discount * 100000) AS INTEGER)) AS red, avg(CAST(8000 + floor(l_extendedprice / 10) AS INTEGER)) AS nir08,
    avg(CAST(7800 + l_orderkey * 37 % 9000 AS INTEGER)) AS swir16, avg(CAST(7600 + l_orderkey * 101 % 8000 AS INTEGER)) AS swir22,
    max(l_linenumber) % 7 AS lc_class FROM lineitem GROUP BY ALL),
cells AS (SELECT epoch_id, k // {width_sql('part')} AS row, k % {width_sql('part')} AS col,
    {nd(b['nir08'], b['red'])} AS ndvi, {nd(b['swir16'], b['nir08'])} AS ndbi, {nd(b['green'], b['swir16'])} AS mndwi,
    {nd(b['swir16'] + ' + ' + b['red'], b['nir08'] + ' + ' + b['blue'])} AS bsi, lc_class FROM cm),
vcells AS (SELECT * FROM cells WHERE ndvi IS NOT NULL AND ndbi IS NOT NULL AND mndwi IS NOT NULL AND bsi IS NOT NULL
    AND abs(ndvi) <= 1.001e0 AND abs(ndbi) <= 1.001e0 AND abs(mndwi) <= 1.001e0 AND abs(bsi) <= 1.001e0)"""


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as points on the part grid; a negative balance means no known location (kept as NULL)."""
    width = grid_width(spark, folder, "part")
    height = -(-row_count(spark, folder, "part") // width)
    s = table(spark, folder, "supplier")
    share = F.col("s_acctbal") - F.floor("s_acctbal")
    known = F.col("s_acctbal") >= 0
    x = F.lit(GRID_XMIN) + (F.col("s_suppkey") * 13 % width + share) * CELL
    y = F.lit(GRID_YMAX) - (F.col("s_suppkey") * 29 % height + share) * CELL
    return s.select(F.col("s_suppkey").alias("component_id"), F.col("s_name").alias("component_name"),
                    F.when(known, x).alias("x"), F.when(known, y).alias("y"))


def places_sql() -> str:
    w = width_sql("part")
    h = f"(SELECT (count(*) + {w} - 1) // {w} FROM part)"
    return f"""
places AS (SELECT s_suppkey AS component_id, s_name AS component_name,
    CASE WHEN s_acctbal >= 0 THEN {GRID_XMIN_SQL} + (s_suppkey * 13 % {w} + (s_acctbal - floor(s_acctbal))) * 30e0 END AS x,
    CASE WHEN s_acctbal >= 0 THEN {GRID_YMAX_SQL} - (s_suppkey * 29 % {h} + (s_acctbal - floor(s_acctbal))) * 30e0 END AS y FROM supplier)"""


DISC_RADII = [60, 120, 240]


def discs_sql(radii=(60, 120, 240), cells: str = "vcells") -> str:
    values = ", ".join(f"({r})" for r in radii)
    return f"""
discs AS (SELECT p.component_id, radius_m, c.* FROM places p, (VALUES {values}) t(radius_m), {cells} c
  WHERE p.x IS NOT NULL AND pow({GRID_XMIN_SQL} + (c.col + 5e-1) * 30e0 - p.x, 2) + pow({GRID_YMAX_SQL} - (c.row + 5e-1) * 30e0 - p.y, 2) <= radius_m * radius_m)"""


# --- daily weather -------------------------------------------------------------------

WEATHER = ["temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "precipitation_sum",
           "relative_humidity_2m_mean", "dew_point_2m_mean", "wind_speed_10m_max", "soil_moisture_0_to_7cm_mean",
           "et0_fao_evapotranspiration_sum"]
BASELINE_YEARS = (1996, 2000)


def weather_daily(spark: SparkSession, folder: str) -> DataFrame:
    """First product: daily series of four weather cells from shipped line items."""
    items = table(spark, folder, "lineitem")
    q, t, disc = (F.expr(e) for e in ("cast(l_quantity as bigint)", "cast(round(l_tax * 100) as bigint)", "cast(round(l_discount * 100) as bigint)"))
    daily = items.groupBy(F.concat(F.lit("OM_0"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("weather_cell_id"),
                          F.to_date("l_shipdate").alias("date")).agg(
        F.avg(disc).alias("_d"), F.max(disc).alias("_dx"), F.min(disc).alias("_dn"), F.avg(q).alias("_q"),
        F.avg(t).alias("_t"), F.max(q).alias("_qx"), F.min(q).alias("_qn"))
    return daily.select(
        "weather_cell_id", "date", (F.col("_d") * 4).alias("temperature_2m_mean"), (F.col("_dx") * 4.0).alias("temperature_2m_max"),
        (F.col("_dn") * 4.0).alias("temperature_2m_min"), F.greatest(F.col("_q") - 24, F.lit(0.0)).alias("precipitation_sum"),
        (F.col("_t") * 10).alias("relative_humidity_2m_mean"), (F.col("_d") + F.col("_t")).alias("dew_point_2m_mean"),
        (F.col("_qx") / F.lit(5.0)).alias("wind_speed_10m_max"), (F.col("_t") / F.lit(16.0)).alias("soil_moisture_0_to_7cm_mean"),
        F.when(F.col("_qn") > 1, F.col("_t") + 1).alias("et0_fao_evapotranspiration_sum"))


def weather_sql() -> str:
    return """
wd0 AS (SELECT 'OM_0' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS weather_cell_id, CAST(l_shipdate AS DATE) AS date,
    avg(CAST(round(l_discount * 100) AS BIGINT)) AS d, max(CAST(round(l_discount * 100) AS BIGINT)) AS dx, min(CAST(round(l_discount * 100) AS BIGINT)) AS dn,
    avg(CAST(l_quantity AS BIGINT)) AS q, avg(CAST(round(l_tax * 100) AS BIGINT)) AS t, max(CAST(l_quantity AS BIGINT)) AS qx, min(CAST(l_quantity AS BIGINT)) AS qn
  FROM lineitem GROUP BY ALL),
wd AS (SELECT weather_cell_id, date, d * 4 AS temperature_2m_mean, dx * 4e0 AS temperature_2m_max, dn * 4e0 AS temperature_2m_min,
    greatest(q - 24, 0e0) AS precipitation_sum, t * 10 AS relative_humidity_2m_mean, d + t AS dew_point_2m_mean,
    qx / 5e0 AS wind_speed_10m_max, t / 16e0 AS soil_moisture_0_to_7cm_mean,
    CASE WHEN qn > 1 THEN t + 1 END AS et0_fao_evapotranspiration_sum FROM wd0)"""


def site_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Site means with a fixed number of decimals, so that run lengths and ties do not hang on summation order."""
    from siterank.operators.daily import site_mean

    site = site_mean(weather_daily(spark, folder), WEATHER)
    return site.select("date", *[F.round(c, 9).alias(c) for c in WEATHER])


def site_sql() -> str:
    means = ", ".join(f"round(avg({c}), 9) AS {c}" for c in WEATHER)
    return weather_sql() + f""",
site AS (SELECT date, {means} FROM wd GROUP BY date)"""


SECOND = ["precipitation_sum", "temperature_2m_mean", "temperature_2m_max", "temperature_2m_min", "relative_humidity_2m_mean"]


def second_product(spark: SparkSession, folder: str) -> DataFrame:
    """Second product: one site series from orders, with sentinels already NULL."""
    o = table(spark, folder, "orders")
    cents = F.expr("cast(round(o_totalprice) as bigint)")
    key = F.expr("o_custkey % 41")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.greatest(F.round(F.avg(cents) / 10000 - 20, 6), F.lit(0.0)).alias("precipitation_sum"),
        F.round(F.avg(key), 6).alias("temperature_2m_mean"), F.max(key).cast("double").alias("temperature_2m_max"),
        F.min(key).cast("double").alias("temperature_2m_min"),
        F.round(F.avg(F.expr("o_orderkey % 100")), 6).alias("relative_humidity_2m_mean"))


def second_sql() -> str:
    return """
second AS (SELECT CAST(o_orderdate AS DATE) AS date, greatest(round(avg(CAST(round(o_totalprice) AS BIGINT)) / 10000 - 20, 6), 0e0) AS precipitation_sum,
    round(avg(o_custkey % 41), 6) AS temperature_2m_mean, max(o_custkey % 41) * 1e0 AS temperature_2m_max,
    min(o_custkey % 41) * 1e0 AS temperature_2m_min, round(avg(o_orderkey % 100), 6) AS relative_humidity_2m_mean FROM orders GROUP BY 1)"""
