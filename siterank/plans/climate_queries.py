"""Daily weather, product comparison and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions.columns import SEASON_DAYS, season, season_year, weather_flag
from siterank.operators import daily, trends
from siterank.operators.agreement import paired_agreement
from siterank.operators.lineage import materialise
from siterank.plans.bindings import (BASELINE_YEARS, SECOND, WEATHER, ranks_sql, second_product, second_sql, site_daily, site_sql,
                                     weather_daily, weather_sql)
from siterank.plans.registry import query, r, rounded, table
from siterank.plans.score_queries import UNIFORM_SQL

B0, B1 = BASELINE_YEARS
BASE_SQL = f"year(date) BETWEEN {B0} AND {B1}"


@query("a10_site_mean_and_spread", f"""WITH {weather_sql()}
SELECT date, {', '.join(f'{r(f"avg({c})", 9)} AS {c}, {r(f"stddev_pop({c})", 5)} AS {c}_spatial_sd' for c in WEATHER)} FROM wd GROUP BY date""")
def site_mean(spark, folder):
    sds = [f"{c}_spatial_sd" for c in WEATHER]
    out = daily.site_mean(weather_daily(spark, folder), WEATHER, spread=True)
    return rounded(out.withColumns({c: F.round(c, 5) for c in sds}), 9)


LIMIT_SQL = f"""
lim AS (SELECT quantile_cont(CASE WHEN precipitation_sum >= 1 THEN precipitation_sum END, 0.95) AS wet_day_p95_mm,
  quantile_cont(temperature_2m_max, 0.95) AS tmax_p95_c, quantile_cont(precipitation_sum, 0.99) AS precip_p99_mm FROM site WHERE {BASE_SQL})"""


@query("a11_baseline_thresholds", f"""WITH {site_sql()}, {LIMIT_SQL}
SELECT {', '.join(f'{r(c)} AS {c}' for c in ('wet_day_p95_mm', 'tmax_p95_c', 'precip_p99_mm'))} FROM lim""")
def thresholds(spark, folder):
    return rounded(daily.thresholds(site_daily(spark, folder), BASELINE_YEARS))


def metrics_sql(keys: str, source: str, threshold: str = "lim", extra_columns: int = 0) -> str:
    run = lambda flag: (f"CASE WHEN {flag} THEN rn - coalesce(max(CASE WHEN NOT {flag} THEN rn END) OVER (PARTITION BY {keys} ORDER BY date "
                        "ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END")
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in WEATHER)
    return f"""
m0 AS (SELECT s.*, l.*, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS rn, coalesce(precipitation_sum, 0) >= 1 AS wet,
    coalesce(precipitation_sum, 0) < 1 AS dry, coalesce(temperature_2m_max > tmax_p95_c, false) AS hot FROM {source} s, {threshold} l),
m1 AS (SELECT *, {run('wet')} AS rw, {run('dry')} AS rd, {run('hot')} AS rh,
    CASE WHEN count(precipitation_sum) OVER w5 = 5 THEN sum(precipitation_sum) OVER w5 END AS r5 FROM m0
    WINDOW w5 AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
met AS (SELECT {keys}, count(date) AS valid_days, CAST(sum({nulls}) AS BIGINT) AS missing_weather_values, coalesce(sum(precipitation_sum), 0) AS precipitation_sum_mm,
    avg(precipitation_sum) AS precipitation_mean_mm_day, max(precipitation_sum) AS rx1day_mm, max(r5) AS rx5day_mm,
    count(*) FILTER (precipitation_sum >= 1) AS wet_days_ge1mm, count(*) FILTER (precipitation_sum > wet_day_p95_mm) AS heavy_precipitation_days,
    max(rw) AS consecutive_wet_days, max(rd) AS consecutive_dry_days, avg(temperature_2m_mean) AS temperature_mean_c, avg(temperature_2m_max) AS tmax_mean_c,
    avg(temperature_2m_min) AS tmin_mean_c, max(temperature_2m_max) AS annual_or_period_max_tmax_c, count(*) FILTER (hot) AS hot_days, max(rh) AS heatwave_max_days,
    avg(relative_humidity_2m_mean) AS relative_humidity_mean_percent, avg(dew_point_2m_mean) AS dew_point_mean_c,
    avg(soil_moisture_0_to_7cm_mean) AS soil_moisture_mean_m3m3, sum(et0_fao_evapotranspiration_sum) AS et0_sum_mm FROM m1 GROUP BY {keys})"""


REALS = ["precipitation_sum_mm", "precipitation_mean_mm_day", "rx1day_mm", "rx5day_mm", "temperature_mean_c", "tmax_mean_c", "tmin_mean_c",
         "annual_or_period_max_tmax_c", "relative_humidity_mean_percent", "dew_point_mean_c", "soil_moisture_mean_m3m3", "et0_sum_mm"]
INTS = ["valid_days", "missing_weather_values", "wet_days_ge1mm", "heavy_precipitation_days", "consecutive_wet_days", "consecutive_dry_days",
        "hot_days", "heatwave_max_days"]
METRIC_SELECT = ", ".join([*INTS, *[f"{r(c)} AS {c}" for c in REALS]])


@query("a12_w5_w6_annual_metrics", f"""WITH {site_sql()}, sy AS (SELECT *, year(date) AS year FROM site), {LIMIT_SQL}, {metrics_sql('year', 'sy')}
SELECT year, {METRIC_SELECT} FROM met""")
def annual_metrics(spark, folder):
    site = site_daily(spark, folder)
    return rounded(daily.annual_metrics(site, daily.thresholds(site, BASELINE_YEARS)))


SEASON_SQL = """CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) = 6 THEN 'JJ'
  WHEN month(date) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Post-monsoon' END"""
# The calendar spans May and June apart from JJ, so June alone never completes a 61-day season; MAM has 92 days.
SEASONAL_SQL = f"""ss AS (SELECT *, {SEASON_SQL} AS season, year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END AS season_year FROM site)"""
COMPLETE_SQL = " OR ".join(f"(season = '{s}' AND valid_days BETWEEN {lo} AND {hi})" for s, (lo, hi) in SEASON_DAYS.items())


@query("a14_p11_seasonal_metrics", f"""WITH {site_sql()}, {SEASONAL_SQL}, {LIMIT_SQL}, {metrics_sql('season_year, season', 'ss')}
SELECT season_year, season, {METRIC_SELECT} FROM met WHERE {COMPLETE_SQL}""")
def seasonal_metrics(spark, folder):
    site = site_daily(spark, folder)
    return rounded(daily.seasonal_metrics(site, daily.thresholds(site, BASELINE_YEARS)))


@query("a41_seasonal_anomaly", f"""WITH {site_sql()}, {SEASONAL_SQL}, {LIMIT_SQL}, {metrics_sql('season_year, season', 'ss')},
ok AS (SELECT * FROM met WHERE {COMPLETE_SQL}),
b AS (SELECT season, avg(precipitation_sum_mm) AS m, stddev_samp(precipitation_sum_mm) AS s FROM ok WHERE season_year BETWEEN {B0} AND {B1} GROUP BY 1),
z AS (SELECT season_year, season, (precipitation_sum_mm - m) / nullif(s, 0) AS z FROM ok JOIN b USING (season))
SELECT season_year, {', '.join(f'''{r(f"max(CASE WHEN season = '{s}' THEN z END)")} AS "{s}"''' for s in SEASON_DAYS)} FROM z GROUP BY 1""")
def seasonal_anomaly(spark, folder):
    site = site_daily(spark, folder)
    seasonal = daily.seasonal_metrics(site, daily.thresholds(site, BASELINE_YEARS))
    out = daily.seasonal_anomaly(seasonal, BASELINE_YEARS, list(SEASON_DAYS))
    return out.select(F.col("season_year").cast("bigint").alias("season_year"), *[(F.round(F.col(f"`{s}`"), 6) + 0.0).alias(s) for s in SEASON_DAYS])


CLIM = {"precipitation_mean_mm_day": "precipitation_sum", "temperature_mean_c": "temperature_2m_mean", "tmax_mean_c": "temperature_2m_max",
        "tmin_mean_c": "temperature_2m_min", "relative_humidity_mean_percent": "relative_humidity_2m_mean", "soil_moisture_mean_m3m3": "soil_moisture_0_to_7cm_mean"}


@query("a15_monthly_climatology", f"""WITH {site_sql()}, d AS (SELECT *, year(date) AS y, month(date) AS month FROM site WHERE {BASE_SQL}),
t AS (SELECT month, avg(s) AS precipitation_monthly_mean_mm FROM (SELECT month, y, sum(precipitation_sum) AS s FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT month, {', '.join(f'{r(f"avg({c})")} AS {n}' for n, c in CLIM.items())}, {r('min(precipitation_monthly_mean_mm)')} AS precipitation_monthly_mean_mm
FROM d JOIN t USING (month) GROUP BY month""")
def climatology(spark, folder):
    return rounded(daily.monthly_climatology(site_daily(spark, folder), BASELINE_YEARS))


@query("a35_day_of_year_matrix", f"""WITH {site_sql()}
SELECT dayofyear(date) AS day_of_year, {', '.join(f'{r(f"avg(CASE WHEN year(date) = {y} THEN temperature_2m_mean END)")} AS y{y}' for y in range(1995, 2002))}
FROM site GROUP BY 1""")
def day_matrix(spark, folder):
    return rounded(daily.day_matrix(site_daily(spark, folder), "temperature_2m_mean", range(1995, 2002)))


def second_with_wind(spark, folder):
    return second_product(spark, folder).withColumn("wind", F.col("temperature_2m_mean") / 4)


SECOND_ANNUAL_SQL = f"""
s0 AS (SELECT *, temperature_2m_mean / 4 AS wind, year(date) AS year, temperature_2m_max - temperature_2m_min AS dtr, coalesce(precipitation_sum, 0) AS rain FROM second),
l2 AS (SELECT quantile_cont(CASE WHEN precipitation_sum >= 1 THEN precipitation_sum END, 0.95) AS wet95, quantile_cont(temperature_2m_max, 0.95) AS tx95,
    quantile_cont(dtr, 0.95) AS dtr95, quantile_cont(wind, 0.95) AS wind95 FROM s0 WHERE {BASE_SQL}),
s1 AS (SELECT s0.*, l2.*, row_number() OVER (PARTITION BY year ORDER BY date) AS rn, rain >= 1 AS wet, rain < 1 AS dry, coalesce(temperature_2m_max > tx95, false) AS hot FROM s0, l2),
s2 AS (SELECT *, {', '.join(f"CASE WHEN {f} THEN rn - coalesce(max(CASE WHEN NOT {f} THEN rn END) OVER (PARTITION BY year ORDER BY date ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS r_{f}" for f in ('wet', 'dry', 'hot'))},
    CASE WHEN count(*) OVER w5 = 5 THEN sum(rain) OVER w5 END AS r5 FROM s1 WINDOW w5 AS (PARTITION BY year ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
an AS (SELECT year, sum(rain) AS annual_rainfall_mm, sum(CASE WHEN month(date) BETWEEN 7 AND 9 THEN rain ELSE 0 END) AS monsoon_rainfall_mm, max(rain) AS rx1day_mm, max(r5) AS rx5day_mm,
    count(*) FILTER (rain > wet95) AS r95p_days, max(r_wet) AS cwd_days, max(r_dry) AS cdd_days, sum(CASE WHEN month(date) = 9 THEN rain ELSE 0 END) AS pre30_rainfall_mm,
    sum(CASE WHEN date >= make_date(year, 7, 3) AND date <= make_date(year, 9, 30) THEN rain ELSE 0 END) AS pre90_rainfall_mm, avg(temperature_2m_max) AS mean_tmax_c,
    max(temperature_2m_max) AS annual_max_tmax_c, count(*) FILTER (hot) AS tx95_days, max(r_hot) AS heatwave_max_days, avg(dtr) AS mean_dtr_c, count(*) FILTER (dtr > dtr95) AS high_dtr_days,
    avg(relative_humidity_2m_mean) AS mean_rh_percent, count(*) FILTER (wind > wind95) AS strong_wind_days FROM s2 GROUP BY year)"""
AN_REALS = ["annual_rainfall_mm", "monsoon_rainfall_mm", "rx1day_mm", "rx5day_mm", "pre30_rainfall_mm", "pre90_rainfall_mm", "mean_tmax_c", "annual_max_tmax_c",
            "mean_dtr_c", "mean_rh_percent"]
AN_INTS = ["r95p_days", "cwd_days", "cdd_days", "tx95_days", "heatwave_max_days", "high_dtr_days", "strong_wind_days"]


@query("a13_annual_metrics_second_product", f"""WITH {second_sql()}, {SECOND_ANNUAL_SQL}
SELECT year, {', '.join(AN_INTS)}, {', '.join(f'{r(c)} AS {c}' for c in AN_REALS)} FROM an""")
def annual_second(spark, folder):
    return rounded(daily.annual_metrics_second(second_with_wind(spark, folder), BASELINE_YEARS))


FACTORS = daily.EXTREME_FACTORS
SCORE_SQL = f"""
cs AS (SELECT a.*, {', '.join(f"(SELECT (count(*) FILTER (b.{f} < a.{f}) + 5e-1 * count(*) FILTER (b.{f} = a.{f})) / count(*) FROM an b WHERE b.year BETWEEN {B0} AND {B1}) AS {f}_percentile" for f in FACTORS)} FROM an a),
cx AS (SELECT *, ({' + '.join(f'{f}_percentile' for f in FACTORS)}) / 6 AS climate_extreme_score FROM cs)"""


@query("a16_climate_extreme_score", f"""WITH {second_sql()}, {SECOND_ANNUAL_SQL}, {SCORE_SQL}
SELECT year, {', '.join(f'{r(f"{f}_percentile")} AS {f}_percentile' for f in FACTORS)}, {r('climate_extreme_score')} AS climate_extreme_score FROM cx""")
def extreme_score(spark, folder):
    out = daily.climate_extreme_score(daily.annual_metrics_second(second_with_wind(spark, folder), BASELINE_YEARS), BASELINE_YEARS)
    return rounded(out.select("year", *[f"{f}_percentile" for f in FACTORS], "climate_extreme_score"))


WINDOWS = {"E1997": [1996, 1997, 1998], "E2000": [1999, 2000, 2001]}
Z = ["monsoon_rainfall_mm", "rx5day_mm", "r95p_days", "cdd_days", "annual_max_tmax_c", "tx95_days", "heatwave_max_days", "mean_dtr_c"]
_members = ", ".join(f"('{e}', {y})" for e, ys in WINDOWS.items() for y in ys)


@query("a17_j6_epoch_climate", f"""WITH {second_sql()}, {SECOND_ANNUAL_SQL}, {SCORE_SQL},
b AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s' for c in Z)} FROM an WHERE year BETWEEN {B0} AND {B1}),
e AS (SELECT epoch_id, avg(climate_extreme_score) AS climate_extreme_score, {', '.join(f'avg({c}) AS {c}' for c in Z)} FROM cx JOIN (VALUES {_members}) t(epoch_id, year) USING (year) GROUP BY 1)
SELECT epoch_id, {r('climate_extreme_score')} AS climate_extreme_score, {', '.join(f'{r(c)} AS {c}, {r(f"({c} - {c}_m) / nullif({c}_s, 0)")} AS {c}_z' for c in Z)} FROM e, b""")
def epoch_climate(spark, folder):
    annual = daily.climate_extreme_score(daily.annual_metrics_second(second_with_wind(spark, folder), BASELINE_YEARS), BASELINE_YEARS)
    out = daily.epoch_climate(annual, WINDOWS, BASELINE_YEARS, Z)
    return rounded(out.select("epoch_id", "climate_extreme_score", *Z, *[f"{c}_z" for c in Z]))


# --- quality -------------------------------------------------------------------------

FIRST, LAST = "1995-01-01", "2001-12-31"


@query("v3_weather_quality", f"""WITH {weather_sql()},
q AS (SELECT weather_cell_id, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, count(*) - count(DISTINCT date) AS duplicate_dates,
  date_diff('day', DATE '{FIRST}', DATE '{LAST}') + 1 - count(DISTINCT date) FILTER (date BETWEEN DATE '{FIRST}' AND DATE '{LAST}') AS missing_dates,
  CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in WEATHER)}) AS BIGINT) AS total_missing_values,
  count(*) FILTER (precipitation_sum < 0) AS negative_precipitation, count(*) FILTER (abs(temperature_2m_mean) > 70) AS temperature_outside_minus70_plus70,
  count(*) FILTER (relative_humidity_2m_mean NOT BETWEEN 0 AND 100) AS humidity_outside_0_100 FROM wd GROUP BY 1)
SELECT *, CASE WHEN duplicate_dates + missing_dates + negative_precipitation + temperature_outside_minus70_plus70 + humidity_outside_0_100 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM q""")
def weather_quality(spark, folder):
    return rounded(daily.weather_quality(weather_daily(spark, folder), FIRST, LAST, WEATHER))


@query("j10_u3_calendar_gaps", f"""WITH {weather_sql()}, cal AS (SELECT CAST(d AS DATE) AS date FROM range(TIMESTAMP '{FIRST}', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) t(d))
SELECT weather_cell_id, date FROM (SELECT DISTINCT weather_cell_id FROM wd) c, cal WHERE NOT EXISTS (SELECT 1 FROM wd WHERE wd.weather_cell_id = c.weather_cell_id AND wd.date = cal.date)""")
def gaps(spark, folder):
    return daily.calendar_gaps(weather_daily(spark, folder), FIRST, LAST)


@query("p10_weather_flags", f"""WITH {second_sql()}, f AS (SELECT *, precipitation_sum * 10 AS p, temperature_2m_mean * 4 - 20 AS t FROM second)
SELECT date, {r('p')} AS p, {r('t')} AS t, CASE WHEN p > 200 THEN 'EXTREME_PRECIPITATION_GT200MM_REQUIRES_STATION_CHECK' WHEN p < 0 THEN 'NEGATIVE_PRECIPITATION'
 ELSE 'IMPOSSIBLE_TEMPERATURE' END AS quality_flag FROM f WHERE p > 200 OR p < 0 OR abs(t) > 70""")
def flags(spark, folder):
    s = second_product(spark, folder).select("date", (F.col("precipitation_sum") * 10).alias("p"), (F.col("temperature_2m_mean") * 4 - 20).alias("t"))
    return rounded(s.withColumn("quality_flag", weather_flag("p", "t")).where(F.col("quality_flag").isNotNull()))


@query("p11_season_labels", f"""SELECT {SEASON_SQL.replace('date', 'o_orderdate')} AS season, year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END AS season_year, count(*) AS n
FROM orders GROUP BY ALL""")
def seasons(spark, folder):
    o = table(spark, folder, "orders")
    return rounded(o.groupBy(season("o_orderdate").alias("season"), season_year("o_orderdate").alias("season_year")).agg(F.count(F.lit(1)).alias("n")))


# --- products ------------------------------------------------------------------------

ALIGNED_SQL = "al AS (SELECT s.date, " + ", ".join(f"s.{v} AS {v}_open, n.{v} AS {v}_nasa" for v in SECOND) + " FROM site s JOIN second n USING (date))"
ANNUAL_AL_SQL = """aa AS (SELECT year(date) AS year, sum(precipitation_sum_open) AS precipitation_sum_open, sum(precipitation_sum_nasa) AS precipitation_sum_nasa,
  avg(temperature_2m_mean_open) AS temperature_2m_mean_open, avg(temperature_2m_mean_nasa) AS temperature_2m_mean_nasa,
  max(temperature_2m_max_open) AS temperature_2m_max_open, max(temperature_2m_max_nasa) AS temperature_2m_max_nasa FROM al GROUP BY 1)"""


def aligned(spark, folder):
    return daily.align_products(site_daily(spark, folder), second_product(spark, folder), SECOND)


@query("j2_aligned_products", f"WITH {site_sql()}, {second_sql()}, {ALIGNED_SQL} SELECT date, {', '.join(f'{r(f"{v}_{s}")} AS {v}_{s}' for v in SECOND for s in ('open', 'nasa'))} FROM al")
def aligned_products(spark, folder):
    return rounded(aligned(spark, folder))


_long = []
for _v in SECOND:
    _p = f"SELECT '{_v}' AS variable, {{s}} AS temporal_scale, '{{c}}' AS comparison_subset, {_v}_open AS a, {_v}_nasa AS b FROM al"
    _long += [_p.format(s="'daily'", c="full_record"), _p.format(s=f"'daily_' || {SEASON_SQL}", c="full_record"),
              _p.format(s="'daily'", c="early_period") + " WHERE year(date) <= 1998"]
    if _v == "precipitation_sum":
        _long.append(_p.format(s="'daily'", c="exclude_either_product_gt_limit") + " WHERE precipitation_sum_open <= 2 AND precipitation_sum_nasa <= 2")
for _v in daily.ANNUAL_RULES:
    _p = f"SELECT '{_v}', 'annual', '{{c}}', {_v}_open, {_v}_nasa FROM aa"
    _long += [_p.format(c="full_record"), _p.format(c="early_period") + " WHERE year <= 1998"]
PAIRS_SQL = "lg AS (" + " UNION ALL ".join(_long) + ")"
_PK = "variable, temporal_scale, comparison_subset"


def agreement_sql(keys: str, source: str) -> str:
    ok = lambda x, y: f"CASE WHEN count(*) > 2 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"
    return f"""SELECT {keys}, count(*) AS n, {r(ok('a', 'b'))} AS pearson_r, {r('avg(a - b)')} AS mean_bias, {r('sqrt(avg((a - b) * (a - b)))')} AS rmse,
  {r('avg(abs(a - b))')} AS mae, {r(ok('rx', 'ry'))} AS spearman_rho FROM ({ranks_sql(source, keys, 'a', 'b')}) GROUP BY {keys}"""


@query("a18_a19_product_agreement", f"WITH {site_sql()}, {second_sql()}, {ALIGNED_SQL}, {ANNUAL_AL_SQL}, {PAIRS_SQL} {agreement_sql(_PK, 'lg')}")
def product_agreement(spark, folder):
    return rounded(daily.product_comparison(aligned(spark, folder), SECOND, 1998, 2.0))


@query("a18_paired_agreement_lines", f"""WITH pr AS (SELECT l_returnflag, l_quantity / 50 AS a, l_tax * 10 AS b FROM lineitem)
{agreement_sql('l_returnflag', 'pr')}""")
def paired_lines(spark, folder):
    items = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("a"), (F.col("l_tax") * 10).alias("b"))
    return rounded(paired_agreement(items, ["l_returnflag"], "a", "b"))


@query("a20_extreme_agreement", f"""WITH {site_sql()}, {second_sql()}, {ALIGNED_SQL},
l AS ({' UNION ALL '.join(f"SELECT date, '{v}' AS variable, {v}_open AS a, {v}_nasa AS b FROM al" for v in ('precipitation_sum', 'temperature_2m_max'))}),
t AS (SELECT variable, quantile_cont(a, 0.95) AS ta, quantile_cont(b, 0.95) AS tb FROM l WHERE {BASE_SQL} GROUP BY 1),
c AS (SELECT variable, ta, tb, count(*) FILTER (a > ta) AS o, count(*) FILTER (b > tb) AS n, count(*) FILTER (a > ta AND b > tb) AS i, count(*) FILTER (a > ta OR b > tb) AS u FROM l JOIN t USING (variable) GROUP BY 1, 2, 3)
SELECT variable, {r('ta')} AS open_p95, {r('tb')} AS nasa_p95, o AS open_event_days, n AS nasa_event_days, i AS intersection_days,
  {r('i * 1e0 / nullif(u, 0)')} AS jaccard_agreement, {r('i * 1e0 / nullif(n, 0)')} AS open_event_recall_against_nasa FROM c""")
def extreme_agreement(spark, folder):
    return rounded(daily.extreme_agreement(aligned(spark, folder), BASELINE_YEARS))


@query("a21_trend_direction", f"""WITH {site_sql()}, {second_sql()}, {ALIGNED_SQL}, {ANNUAL_AL_SQL},
s AS ({' UNION ALL '.join(f"SELECT '{v}' AS variable, '{k}' AS side, median((b.{v}_{k} - a.{v}_{k}) / (b.year - a.year)) AS slope FROM aa a JOIN aa b ON b.year > a.year" for v in daily.ANNUAL_RULES for k in ('open', 'nasa'))}),
w AS (SELECT variable, max(CASE WHEN side = 'open' THEN slope END) AS o, max(CASE WHEN side = 'nasa' THEN slope END) AS n FROM s GROUP BY 1)
SELECT variable, {r('o', 9)} AS open_slope, {r('n', 9)} AS nasa_slope, sign(o) = sign(n) AS direction_agreement, {r('abs(o - n)', 9)} AS absolute_slope_difference FROM w""")
def trend_direction(spark, folder):
    return rounded(trends.trend_direction(daily.annual_products(aligned(spark, folder)), list(daily.ANNUAL_RULES)), 9)


# --- look-back -----------------------------------------------------------------------

LAGS, ALL_LAGS = [7, 30, 90], [7, 30, 90, 180, 365]


def lag_columns(lags):
    return [c for d in lags for c in (f"precipitation_preceding_{d}d_mm", f"temperature_mean_preceding_{d}d_c", f"tmax_max_preceding_{d}d_c",
                                      f"data_completeness_preceding_{d}d")] + ["humidity_mean_preceding_7d_percent", "soil_moisture_mean_preceding_7d_m3m3"]


LAG_COLUMNS = lag_columns(LAGS)


def scenes(spark, folder):
    """Suppliers' first shipping day of each year as acquisition dates."""
    items = table(spark, folder, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("item_id"), F.concat(F.lit("E"), F.year("l_shipdate").cast("string")).alias("epoch_id")).agg(
        F.to_date(F.min("l_shipdate")).alias("acquisition_date"))


def lag_sql(lags):
    features = ", ".join(f"""CASE WHEN count(precipitation_sum) FILTER (b <= {d}) >= {d} THEN sum(precipitation_sum) FILTER (b <= {d}) END AS precipitation_preceding_{d}d_mm,
  avg(temperature_2m_mean) FILTER (b <= {d}) AS temperature_mean_preceding_{d}d_c, max(temperature_2m_max) FILTER (b <= {d}) AS tmax_max_preceding_{d}d_c,
  coalesce(count(precipitation_sum) FILTER (b <= {d}) * 1e0 / nullif(count(*) FILTER (b <= {d}), 0), 0) AS data_completeness_preceding_{d}d""" for d in lags)
    return f"""
sc AS (SELECT l_suppkey AS item_id, 'E' || CAST(year(l_shipdate) AS VARCHAR) AS epoch_id, CAST(min(l_shipdate) AS DATE) AS acquisition_date FROM lineitem GROUP BY 1, 2),
dt AS (SELECT DISTINCT acquisition_date FROM sc),
bk AS (SELECT acquisition_date, date_diff('day', s.date, acquisition_date) AS b, s.* FROM dt JOIN site s ON s.date < acquisition_date AND date_diff('day', s.date, acquisition_date) <= {max(lags)}),
lf AS (SELECT acquisition_date, {features}, avg(relative_humidity_2m_mean) FILTER (b <= 7) AS humidity_mean_preceding_7d_percent,
  avg(soil_moisture_0_to_7cm_mean) FILTER (b <= 7) AS soil_moisture_mean_preceding_7d_m3m3 FROM bk GROUP BY 1),
fl AS (SELECT sc.*, lf.* EXCLUDE (acquisition_date) FROM sc LEFT JOIN lf USING (acquisition_date))"""


LAG_SQL = lag_sql(LAGS)


def lag_frame(spark, folder, lags=LAGS):
    return daily.lag_features(scenes(spark, folder), site_daily(spark, folder), ["item_id", "epoch_id"], lags=lags)


@query("j5_a22_lag_features", f"WITH {site_sql()}, {LAG_SQL} SELECT item_id, epoch_id, acquisition_date, {', '.join(f'{r(c, 11)} AS {c}' for c in LAG_COLUMNS)} FROM fl")
def lag_features(spark, folder):
    return rounded(lag_frame(spark, folder), 11)


@query("a23_lag_summary", f"""WITH {site_sql()}, {LAG_SQL}
SELECT epoch_id, {', '.join(f'{r(f"avg({c})", 9)} AS {c}_mean, {r(f"median({c})", 9)} AS {c}_median, {r(f"min({c})", 9)} AS {c}_min, {r(f"max({c})", 9)} AS {c}_max' for c in LAG_COLUMNS)} FROM fl GROUP BY 1""")
def lag_summary(spark, folder):
    return rounded(daily.lag_summary(lag_frame(spark, folder), ["epoch_id"], LAG_COLUMNS), 9)


@query("j5_a22_lag_features_all", f"WITH {site_sql()}, {lag_sql(ALL_LAGS)} SELECT item_id, epoch_id, acquisition_date, {', '.join(f'{r(c)} AS {c}' for c in lag_columns(ALL_LAGS))} FROM fl")
def all_lag_features(spark, folder):
    return rounded(lag_frame(spark, folder, ALL_LAGS))


@query("a23_lag_summary_all", f"""WITH {site_sql()}, {lag_sql(ALL_LAGS)}
SELECT epoch_id, {', '.join(f'{r(f"avg({c})")} AS {c}_mean, {r(f"median({c})")} AS {c}_median, {r(f"min({c})")} AS {c}_min, {r(f"max({c})")} AS {c}_max' for c in lag_columns(ALL_LAGS))} FROM fl GROUP BY 1""")
def all_lag_summary(spark, folder):
    return rounded(daily.lag_summary(lag_frame(spark, folder, ALL_LAGS), ["epoch_id"], lag_columns(ALL_LAGS)))


_loo_pairs = [("precipitation_preceding_30d_mm", "x1"), ("temperature_mean_preceding_30d_c", "x2"), ("humidity_mean_preceding_7d_percent", "x3")]


@query("a29_leave_one_out", f"""WITH {site_sql()}, {LAG_SQL},
ep AS (SELECT epoch_id, {', '.join(f'round(avg({c}), 9) AS {a}' for c, a in _loo_pairs)}, round(avg(tmax_max_preceding_7d_c), 9) AS y FROM fl GROUP BY 1),
lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS climate_metric, epoch_id, {a} AS x, y FROM ep" for c, a in _loo_pairs)}),
sm AS (SELECT l.*, o.epoch_id AS om FROM lg l JOIN ep o ON o.epoch_id <> l.epoch_id UNION ALL SELECT l.*, '' FROM lg l),
rh AS (SELECT climate_metric, om, count(*) AS n, round(CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 12) AS rho FROM ({ranks_sql('sm', 'climate_metric, om', 'x', 'y')}) GROUP BY 1, 2),
ff AS (SELECT climate_metric, n, rho FROM rh WHERE om = '')
SELECT climate_metric, min(ff.n) AS n, {r('min(ff.rho)')} AS spearman_rho, {r('min(rh.rho)')} AS leave_one_out_rho_min, {r('max(rh.rho)')} AS leave_one_out_rho_max,
  {r('avg(CASE WHEN sign(rh.rho) = sign(ff.rho) THEN 1 ELSE 0 END) FILTER (rh.rho <> 0)')} AS sign_stability
FROM ff JOIN rh USING (climate_metric) WHERE om <> '' GROUP BY 1""")
def leave_one_out(spark, folder):
    f = lag_frame(spark, folder)
    ep = f.groupBy("epoch_id").agg(*[F.round(F.avg(c), 9).alias(a) for c, a in _loo_pairs], F.round(F.avg("tmax_max_preceding_7d_c"), 9).alias("y"))
    long = ep.select("epoch_id", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("climate_metric"), F.col(a).alias("x")) for c, a in _loo_pairs])).alias("o")).select("epoch_id", "y", "o.*")
    return rounded(daily.leave_one_out(long, ["climate_metric"], "epoch_id", "x", "y"))


# --- trends --------------------------------------------------------------------------

TREND_METRICS = ["precipitation_sum_mm", "temperature_mean_c", "rx1day_mm", "consecutive_dry_days"]
HALF_SQL = f"""sh AS (SELECT *, year(date) + CASE WHEN month(date) > 6 THEN 5e-1 ELSE 0e0 END AS period FROM site)"""
TREND_LONG_SQL = "tl AS (" + " UNION ALL ".join(f"SELECT period AS x, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS y FROM met WHERE period < 2001.8" for m in TREND_METRICS) + ")"


def half_year_series(spark, folder):
    site = site_daily(spark, folder).withColumn("period", F.year("date") + F.when(F.month("date") > 6, 0.5).otherwise(0.0))
    met = daily.period_metrics(site, ["period"], daily.thresholds(site, BASELINE_YEARS))
    return met.select(F.col("period").alias("x"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("y")) for m in TREND_METRICS])).alias("o")).select("x", "o.*")


FIT_SQL = """
ps AS (SELECT a.metric, (b.y - a.y) / (b.x - a.x) AS s FROM tl a JOIN tl b ON a.metric = b.metric AND b.x > a.x),
sl AS (SELECT metric, median(s) AS slope, count(*) AS m FROM ps GROUP BY 1),
ft AS (SELECT metric, min(slope) AS slope, count(*) AS n, median(y) - min(slope) * median(x) AS intercept, min(m) AS m FROM tl JOIN sl USING (metric) GROUP BY 1),
of0 AS (SELECT metric, median(y - slope * x) AS off FROM tl JOIN ft USING (metric) GROUP BY 1),
rs AS (SELECT metric, x, y, row_number() OVER (PARTITION BY metric ORDER BY x) - 1 AS i, off + slope * x AS fit, y - (off + slope * x) AS res, n FROM tl JOIN ft USING (metric) JOIN of0 USING (metric)),
l1 AS (SELECT metric, corr(res, nx) AS lag1 FROM (SELECT metric, res, lead(res) OVER (PARTITION BY metric ORDER BY x) AS nx FROM rs) WHERE nx IS NOT NULL GROUP BY 1)"""
TIES_SQL = """
ty AS (SELECT metric, sum(k * (k - 1) * (2 * k + 5)) AS t FROM (SELECT metric, y, count(*) AS k FROM tl GROUP BY 1, 2) GROUP BY 1),
sg AS (SELECT metric, n, m, sqrt((n * (n - 1) * (2 * n + 5) - t) / 18e0) AS sd FROM ft JOIN ty USING (metric)),
so AS (SELECT metric, s, row_number() OVER (PARTITION BY metric ORDER BY s) - 1 AS i FROM ps),
ci AS (SELECT metric, max(CASE WHEN i = greatest(round_even((m - 1.959963984540054e0 * sd) / 2, 0) - 1, 0) THEN s END) AS lo,
    max(CASE WHEN i = least(round_even((m + 1.959963984540054e0 * sd) / 2, 0), m - 1) THEN s END) AS hi FROM so JOIN sg USING (metric) GROUP BY 1)"""


@query("a24_a26_theil_sen", f"""WITH {site_sql()}, {HALF_SQL}, {LIMIT_SQL}, {metrics_sql('period', 'sh')}, {TREND_LONG_SQL}, {FIT_SQL}, {TIES_SQL}
SELECT metric, n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('lo')} AS slope_low_95, {r('hi')} AS slope_high_95,
  {r('CASE WHEN isfinite(lag1) AND lag1 > -1 THEN least(greatest(n * (1 - lag1) / (1 + lag1), 2), n) ELSE n END')} AS effective_n FROM ft JOIN ci USING (metric) JOIN l1 USING (metric)""")
def theil_sen(spark, folder):
    return rounded(trends.theil_sen(half_year_series(spark, folder), ["metric"], "x", "y").select("metric", *trends.TREND_COLUMNS))


BOOT_DRAWS, BLOCK = 2000, 5
BOOT_SQL = f"""
st AS (SELECT metric, n, draw, k, CAST(floor({UNIFORM_SQL('block', 'metric', 'draw', 'k')} * (n - {BLOCK} + 1)) AS BIGINT) AS start
  FROM ft, range({BOOT_DRAWS}) d(draw), range(20) b(k) WHERE k < ceil(n / {BLOCK}e0)),
sm AS (SELECT p.metric, p.draw, o.i, o.x, o.fit + s.res AS y, s.res AS r FROM rs o JOIN st p ON p.metric = o.metric AND p.k = o.i // {BLOCK}
  JOIN rs s ON s.metric = o.metric AND s.i = p.start + o.i % {BLOCK}),
bs AS (SELECT a.metric, a.draw, median((b.y - a.y) / (b.x - a.x)) AS slope, median((b.r - a.r) / (b.x - a.x)) AS nul FROM sm a JOIN sm b ON a.metric = b.metric AND a.draw = b.draw AND b.i > a.i GROUP BY 1, 2),
bo AS (SELECT metric, quantile_cont(bs.slope, 0.025) AS block_low_95, quantile_cont(bs.slope, 0.975) AS block_high_95,
  (1 + count(*) FILTER (round(abs(nul), 9) >= round(abs(ft.slope), 9))) / ({BOOT_DRAWS} + 1e0) AS block_p FROM bs JOIN ft USING (metric) GROUP BY 1)"""


@query("m1_block_bootstrap", f"""WITH {site_sql()}, {HALF_SQL}, {LIMIT_SQL}, {metrics_sql('period', 'sh')}, {TREND_LONG_SQL}, {FIT_SQL}, {BOOT_SQL}
SELECT metric, {r('block_low_95')} AS block_low_95, {r('block_high_95')} AS block_high_95, {r('block_p')} AS block_p FROM bo""")
def block_bootstrap(spark, folder):
    series = materialise(half_year_series(spark, folder))
    fits = materialise(trends.theil_sen(series, ["metric"], "x", "y"))
    out = trends.bootstrap_interval(trends.block_bootstrap(fits, trends.series_points(series, ["metric"], "x", "y"), ["metric"], BOOT_DRAWS, BLOCK), ["metric"])
    return rounded(out.drop("draws"))


BH_SQL = """
vr AS (SELECT metric, count(*) >= 8 AND min(y) < max(y) AS ok FROM tl GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY block_p, metric) AS i, count(*) OVER () AS m FROM bo JOIN vr USING (metric) WHERE ok),
bh AS (SELECT *, least(min(block_p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS fdr FROM rk)"""
TAU_SQL = """
tk AS (SELECT a.metric, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.y = b.y THEN 0 ELSE 1 END) AS py, count(*) AS px
  FROM tl a JOIN tl b ON a.metric = b.metric AND a.x < b.x GROUP BY 1)"""


@query("m2_a25_a27_trend_table", f"""WITH {site_sql()}, {HALF_SQL}, {LIMIT_SQL}, {metrics_sql('period', 'sh')}, {TREND_LONG_SQL}, {FIT_SQL}, {BOOT_SQL}, {BH_SQL}, {TAU_SQL}
SELECT metric, n, {r('CASE WHEN vr.ok THEN slope END')} AS slope, {r('CASE WHEN vr.ok THEN s / sqrt(px * 1e0 * py) END')} AS kendall_tau, {r('block_p')} AS block_p, {r('fdr')} AS fdr_adjusted_block_p,
  CASE WHEN vr.ok THEN 'INFERENTIAL_WITH_BLOCK_BOOTSTRAP' ELSE 'INSUFFICIENT_OR_CONSTANT' END AS status FROM ft JOIN vr USING (metric) LEFT JOIN bh USING (metric) LEFT JOIN tk USING (metric)""")
def trend_table(spark, folder):
    out = trends.trend_table(half_year_series(spark, folder), ["metric"], "x", "y", BOOT_DRAWS, BLOCK)
    return rounded(out.select("metric", "n", "slope", "kendall_tau", "block_p", "fdr_adjusted_block_p", "status"))


@query("m2_baseline_window_sensitivity")
def window_sensitivity(spark, folder):
    series = half_year_series(spark, folder)
    windows = F.array(*[F.struct(F.lit(a).alias("start_year"), F.lit(b).alias("end_year")) for a, b in ((1995, 1999), (1997, 2001), (1995, 2001))])
    tagged = series.withColumn("w", F.explode(windows)).select("metric", "x", "y", "w.*").where(F.floor("x").between(F.col("start_year"), F.col("end_year")))
    return rounded(trends.trend_table(tagged, ["start_year", "end_year", "metric"], "x", "y", BOOT_DRAWS, BLOCK).drop("kendall_p_unadjusted"))


@query("a24_theil_sen_by_nation", f"""WITH q AS (SELECT n_name AS g, year(o_orderdate) * 4 + quarter(o_orderdate) AS x, sum(CAST(round(o_totalprice) AS BIGINT)) * 1e0 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
s AS (SELECT a.g, median((b.y - a.y) / (b.x - a.x)) AS slope FROM q a JOIN q b ON a.g = b.g AND b.x > a.x GROUP BY 1)
SELECT g AS n_name, count(*) AS n, {r('min(slope)')} AS slope, {r('median(y) - min(slope) * median(x)', 3)} AS intercept FROM q JOIN s USING (g) GROUP BY 1""")
def theil_sen_by_nation(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = o.groupBy("n_name", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("x")).agg(F.sum(F.expr("cast(round(o_totalprice) as bigint)")).alias("y"))
    return rounded(trends.theil_sen(q, ["n_name"], "x", "y").select("n_name", "n", "slope", F.round("intercept", 3).alias("intercept")))
