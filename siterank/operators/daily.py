"""Daily series: site means, thresholds, period indices, product comparison and look-back joins.

A daily series holds one row per calendar day and series, so windows ordered by date inside a
(series, period) are bounded by the calendar, whatever the volume the days were aggregated from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions.columns import season, season_is_complete, season_year
from siterank.operators.agreement import correlation, paired_agreement

LAG_DAYS = [7, 30, 90, 180, 365]


def site_mean(daily: DataFrame, columns: Sequence[str], spread: bool = False) -> DataFrame:
    """A10: mean over weather cells per date, with the population standard deviation on request."""
    sds = [F.stddev_pop(c).alias(f"{c}_spatial_sd") for c in columns] if spread else []
    return daily.groupBy("date").agg(*[F.avg(c).alias(c) for c in columns], *sds)


def in_years(years: tuple[int, int], date: str = "date") -> Column:
    return F.year(date).between(*years)


def thresholds(site: DataFrame, baseline: tuple[int, int], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row of baseline quantiles; ``extra`` adds further 95 % thresholds by name."""
    rain = F.col("precipitation_sum")
    at = lambda c, p: F.percentile(c, F.lit(p))
    return site.where(in_years(baseline)).agg(
        at(F.when(rain >= 1, rain), 0.95).alias("wet_day_p95_mm"), at(F.col("temperature_2m_max"), 0.95).alias("tmax_p95_c"),
        at(rain, 0.99).alias("precip_p99_mm"), *[at(c, 0.95).alias(n) for n, c in (extra or {}).items()])


def with_thresholds(site: DataFrame, values: DataFrame) -> DataFrame:
    """Attach the threshold row as a scalar subquery, so that no join is planned."""
    return site.withColumn("_limit", values.select(F.struct(*values.columns)).scalar())


def _run(flag: Column, window: W) -> Column:
    """Length of the run of true values that ends at this row (0 when false)."""
    last_false = F.max(F.when(~flag, F.col("_rn"))).over(window.rowsBetween(W.unboundedPreceding, 0))
    return F.when(flag, F.col("_rn") - F.coalesce(last_false, F.lit(0))).otherwise(0)


def with_runs(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Current run length of each flag within the keys, in date order; NULL flags count as false."""
    window = W.partitionBy(*keys).orderBy("date")
    out = df.withColumn("_rn", F.row_number().over(window))
    return out.withColumns({n: _run(F.coalesce(f, F.lit(False)), window) for n, f in flags.items()}).drop("_rn")


def rolling_total(keys: Sequence[str], value: Column, rows: int = 5) -> Column:
    """Trailing sum over full windows only, not crossing the keys."""
    window = W.partitionBy(*keys).orderBy("date").rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(window) == rows, F.sum(value).over(window))


def period_metrics(site: DataFrame, keys: Sequence[str], limits: DataFrame) -> DataFrame:
    """The twenty indices of each period."""
    keys = list(keys)
    rain, tmax = F.col("precipitation_sum"), F.col("temperature_2m_max")
    columns = [c for c in site.columns if c not in keys]
    hot = tmax > F.col("_limit.tmax_p95_c")
    filled = F.coalesce(rain, F.lit(0.0))
    daily = with_runs(with_thresholds(site, limits), keys, {"_wet": filled >= 1, "_dry": filled < 1, "_heat": hot})
    daily = daily.withColumn("_r5", rolling_total(keys, rain))
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    mean = lambda c: F.avg(c)
    return daily.groupBy(*keys).agg(
        F.count("date").alias("valid_days"), sum((count(F.col(c).isNull()) for c in columns), F.lit(0)).alias("missing_weather_values"),
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("precipitation_sum_mm"), mean(rain).alias("precipitation_mean_mm_day"),
        F.max(rain).alias("rx1day_mm"), F.max("_r5").alias("rx5day_mm"), count(rain >= 1).alias("wet_days_ge1mm"),
        count(rain > F.col("_limit.wet_day_p95_mm")).alias("heavy_precipitation_days"), F.max("_wet").alias("consecutive_wet_days"),
        F.max("_dry").alias("consecutive_dry_days"), mean("temperature_2m_mean").alias("temperature_mean_c"), mean(tmax).alias("tmax_mean_c"),
        mean("temperature_2m_min").alias("tmin_mean_c"), F.max(tmax).alias("annual_or_period_max_tmax_c"), count(hot).alias("hot_days"),
        F.max("_heat").alias("heatwave_max_days"), mean("relative_humidity_2m_mean").alias("relative_humidity_mean_percent"),
        mean("dew_point_2m_mean").alias("dew_point_mean_c"), mean("soil_moisture_0_to_7cm_mean").alias("soil_moisture_mean_m3m3"),
        F.sum("et0_fao_evapotranspiration_sum").alias("et0_sum_mm"))


def annual_metrics(site: DataFrame, limits: DataFrame) -> DataFrame:
    return period_metrics(site.withColumn("year", F.year("date")), ["year"], limits)


def seasonal_metrics(site: DataFrame, limits: DataFrame) -> DataFrame:
    """As the annual indices per season, complete seasons only."""
    tagged = site.withColumns({"season": season("date"), "season_year": season_year("date")})
    return period_metrics(tagged, ["season_year", "season"], limits).where(season_is_complete(F.col("season"), F.col("valid_days")))


def annual_metrics_second(frame: DataFrame, baseline: tuple[int, int]) -> DataFrame:
    """The second product's indices; missing rain counts as zero, wind is ``wind``."""
    dtr = F.col("temperature_2m_max") - F.col("temperature_2m_min")
    base = frame.withColumns({"year": F.year("date"), "dtr": dtr})
    limits = thresholds(base, baseline, {"dtr_p95_c": F.col("dtr"), "wind_p95_ms": F.col("wind")})
    rain, tmax = F.col("rain"), F.col("temperature_2m_max")
    hot = tmax > F.col("_limit.tmax_p95_c")
    daily = with_thresholds(base.withColumn("rain", F.coalesce("precipitation_sum", F.lit(0.0))), limits)
    daily = with_runs(daily, ["year"], {"_wet": rain >= 1, "_dry": rain < 1, "_heat": hot}).withColumn("_r5", rolling_total(["year"], rain))
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    total = lambda use: F.sum(F.when(use, rain).otherwise(0.0))
    month, day = F.month("date"), F.dayofmonth("date")
    monsoon = month.between(7, 9)
    return daily.groupBy("year").agg(
        F.sum(rain).alias("annual_rainfall_mm"), total(monsoon).alias("monsoon_rainfall_mm"), F.max(rain).alias("rx1day_mm"),
        F.max("_r5").alias("rx5day_mm"), count(rain > F.col("_limit.wet_day_p95_mm")).alias("r95p_days"), F.max("_wet").alias("cwd_days"),
        F.max("_dry").alias("cdd_days"), total(month == 9).alias("pre30_rainfall_mm"),
        total(monsoon & ((month > 7) | (day >= 3))).alias("pre90_rainfall_mm"), F.avg(tmax).alias("mean_tmax_c"), F.max(tmax).alias("annual_max_tmax_c"),
        count(hot).alias("tx95_days"), F.max("_heat").alias("heatwave_max_days"), F.avg("dtr").alias("mean_dtr_c"),
        count(F.col("dtr") > F.col("_limit.dtr_p95_c")).alias("high_dtr_days"), F.avg("relative_humidity_2m_mean").alias("mean_rh_percent"),
        count(F.col("wind") > F.col("_limit.wind_p95_ms")).alias("strong_wind_days"))


def monthly_climatology(site: DataFrame, baseline: tuple[int, int]) -> DataFrame:
    """Day means per month, and the mean over years of the monthly totals."""
    data = site.where(in_years(baseline)).withColumns({"year": F.year("date"), "month": F.month("date")})
    columns = {"precipitation_mean_mm_day": "precipitation_sum", "temperature_mean_c": "temperature_2m_mean", "tmax_mean_c": "temperature_2m_max",
               "tmin_mean_c": "temperature_2m_min", "relative_humidity_mean_percent": "relative_humidity_2m_mean",
               "soil_moisture_mean_m3m3": "soil_moisture_0_to_7cm_mean"}
    months = data.groupBy("month", "year").agg(
        F.coalesce(F.sum("precipitation_sum"), F.lit(0.0)).alias("_total"), *[F.sum(c).alias(f"_s_{n}") for n, c in columns.items()],
        *[F.count(c).alias(f"_c_{n}") for n, c in columns.items()])
    return months.groupBy("month").agg(
        *[F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")).alias(n) for n in columns], F.avg("_total").alias("precipitation_monthly_mean_mm"))


EXTREME_FACTORS = ["rx5day_mm", "r95p_days", "cdd_days", "tx95_days", "heatwave_max_days", "high_dtr_days"]


def climate_extreme_score(annual: DataFrame, baseline: tuple[int, int], factors: Sequence[str] = tuple(EXTREME_FACTORS)) -> DataFrame:
    """Percentile of score against the baseline years (half weight for ties), and the mean over factors."""
    inside = F.col("year").between(*baseline)
    size = F.sum(inside.cast("int")).over(W.partitionBy(F.lit(1)))
    out = annual
    for f in factors:
        order = W.partitionBy(F.lit(1)).orderBy(f)
        base = F.when(inside, F.lit(1)).otherwise(0)
        upto = F.sum(base).over(order.rangeBetween(W.unboundedPreceding, 0))
        equal = F.sum(base).over(W.partitionBy(F.col(f)))
        out = out.withColumn(f"{f}_percentile", (upto - equal + 0.5 * equal) / size)
    return out.withColumn("climate_extreme_score", sum((F.col(f"{f}_percentile") for f in factors), F.lit(0.0)) / len(factors))


def epoch_climate(annual: DataFrame, windows: dict[str, Sequence[int]], baseline: tuple[int, int], scored: Sequence[str]) -> DataFrame:
    """Epoch means over member years, and z against the baseline mean and sample deviation."""
    members = F.array(*[F.struct(F.lit(e).alias("epoch_id"), F.lit(int(y)).alias("year")) for e, years in windows.items() for y in years])
    measures = [c for c in annual.columns if c != "year"]
    mapped = annual.withColumn("_m", F.explode(F.filter(members, lambda m: m["year"] == F.col("year"))))
    epochs = mapped.groupBy(F.col("_m.epoch_id").alias("epoch_id")).agg(*[F.avg(c).alias(c) for c in measures])
    base = annual.where(F.col("year").between(*baseline)).agg(
        F.struct(*[F.avg(c).alias(f"{c}_m") for c in scored], *[F.stddev_samp(c).alias(f"{c}_s") for c in scored]).alias("b"))
    out = epochs.withColumn("_b", base.scalar())
    return out.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"_b.{c}_m"), F.col(f"_b.{c}_s")) for c in scored}).drop("_b")


def seasonal_anomaly(seasonal: DataFrame, baseline: tuple[int, int], seasons: Sequence[str]) -> DataFrame:
    """Season x year totals as z against the baseline, one column per season."""
    base = seasonal.where(F.col("season_year").between(*baseline)).groupBy("season").agg(
        F.avg("precipitation_sum_mm").alias("_m"), F.stddev_samp("precipitation_sum_mm").alias("_s"))
    z = seasonal.join(base, "season").withColumn("z", F.try_divide(F.col("precipitation_sum_mm") - F.col("_m"), F.col("_s")))
    return z.groupBy("season_year").pivot("season", list(seasons)).agg(F.max("z"))


def day_matrix(site: DataFrame, value: str, years: Sequence[int]) -> DataFrame:
    """Day of year x year."""
    tagged = site.select(F.dayofyear("date").alias("day_of_year"), F.year("date").alias("year"), value)
    out = tagged.groupBy("day_of_year").pivot("year", list(years)).agg(F.avg(value))
    return out.select("day_of_year", *[F.col(str(y)).alias(f"y{y}") for y in years])


# --- quality -------------------------------------------------------------------------

def calendar(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def weather_quality(daily: DataFrame, first: str, last: str, columns: Sequence[str]) -> DataFrame:
    """Completeness and impossible values per weather cell, and PASS or FAIL.

    Missing days are the calendar length less the distinct dates inside it.
    """
    span = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    per_day = daily.groupBy("weather_cell_id", "date").agg(
        F.count(F.lit(1)).alias("_n"), sum((count(F.col(c).isNull()) for c in columns), F.lit(0)).alias("_null"),
        count(F.col("precipitation_sum") < 0).alias("_neg"), count(F.abs("temperature_2m_mean") > 70).alias("_temp"),
        count(~F.col("relative_humidity_2m_mean").between(0, 100)).alias("_hum"))
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    out = per_day.groupBy("weather_cell_id").agg(
        F.sum("_n").alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_dates"), (span - F.sum(inside.cast("int"))).alias("missing_dates"),
        F.sum("_null").alias("total_missing_values"), F.sum("_neg").alias("negative_precipitation"),
        F.sum("_temp").alias("temperature_outside_minus70_plus70"), F.sum("_hum").alias("humidity_outside_0_100"))
    clean = sum((F.col(c) for c in ("duplicate_dates", "missing_dates", "negative_precipitation",
                                    "temperature_outside_minus70_plus70", "humidity_outside_0_100")), F.lit(0)) == 0
    return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))


def calendar_gaps(daily: DataFrame, first: str, last: str) -> DataFrame:
    """Expected days without an observation, per weather cell."""
    cells = daily.select("weather_cell_id").distinct()
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return cells.select("weather_cell_id", days.alias("date")).join(daily.select("weather_cell_id", "date"), ["weather_cell_id", "date"], "left_anti")


# --- products ------------------------------------------------------------------------

def align_products(left: DataFrame, right: DataFrame, variables: Sequence[str], names: tuple[str, str] = ("open", "nasa")) -> DataFrame:
    """Inner date join with suffixed columns."""
    side = lambda df, s: df.select("date", *[F.col(v).alias(f"{v}_{s}") for v in variables])
    return side(left, names[0]).join(side(right, names[1]), "date")


ANNUAL_RULES = {"precipitation_sum": "sum", "temperature_2m_mean": "mean", "temperature_2m_max": "max"}


def annual_products(aligned: DataFrame) -> DataFrame:
    rule = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.avg, "max": F.max}
    return aligned.groupBy(F.year("date").alias("year")).agg(
        *[rule[k](f"{v}_{s}").alias(f"{v}_{s}") for v, k in ANNUAL_RULES.items() for s in ("open", "nasa")])


def product_comparison(aligned: DataFrame, variables: Sequence[str], split_year: int, rain_limit: float = 200.0,
                       bounded: bool = True) -> DataFrame:
    """Agreement over the full record, seasons, annual values and two sensitivity subsets.

    Each aligned day is tagged with every subset it belongs to, so one aggregation serves all. Days are
    calendar-bounded, hence the bounded default.
    """
    def pairs(df, names):
        return F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_open").alias("a"), F.col(f"{v}_nasa").alias("b")) for v in names])

    def tag(scale, subset, keep=None):
        entry = F.struct(scale.alias("temporal_scale"), F.lit(subset).alias("comparison_subset"))
        return entry if keep is None else F.when(keep, entry)

    year = F.year("date")
    early = F.coalesce(year <= split_year, F.lit(False))
    rain = F.col("variable") == "precipitation_sum"
    clean = rain & (F.col("p_open") <= rain_limit) & (F.col("p_nasa") <= rain_limit)
    daily = aligned.select("date", F.col("precipitation_sum_open").alias("p_open"), F.col("precipitation_sum_nasa").alias("p_nasa"),
                           F.explode(pairs(aligned, variables)).alias("o")).select("*", "o.*")
    daily = daily.select("variable", "a", "b", F.explode(F.filter(F.array(
        tag(F.lit("daily"), "full_record"), tag(F.concat(F.lit("daily_"), season("date")), "full_record"),
        tag(F.lit("daily"), "exclude_either_product_gt_limit", clean), tag(F.lit("daily"), "early_period", early)), lambda t: t.isNotNull())).alias("t"))
    annual = annual_products(aligned)
    yearly = annual.select("year", F.explode(pairs(annual, list(ANNUAL_RULES))).alias("o")).select("year", "o.*")
    yearly = yearly.select("variable", "a", "b", F.explode(F.filter(F.array(
        tag(F.lit("annual"), "full_record"), tag(F.lit("annual"), "early_period", F.col("year") <= split_year)), lambda t: t.isNotNull())).alias("t"))
    long = daily.unionByName(yearly).select("variable", "t.*", "a", "b")
    return paired_agreement(long, ["variable", "temporal_scale", "comparison_subset"], "a", "b", bounded)


def extreme_agreement(aligned: DataFrame, baseline: tuple[int, int], variables: Sequence[str] = ("precipitation_sum", "temperature_2m_max")) -> DataFrame:
    """Events above each product's own baseline 95 % threshold, and how far they coincide."""
    long = aligned.select("date", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}_open").alias("a"), F.col(f"{v}_nasa").alias("b")) for v in variables])).alias("o")).select("date", "o.*")
    limits = long.where(in_years(baseline)).groupBy("variable").agg(
        F.percentile("a", F.lit(0.95)).alias("open_p95"), F.percentile("b", F.lit(0.95)).alias("nasa_p95"))
    ea, eb = F.coalesce(F.col("a") > F.col("open_p95"), F.lit(False)), F.coalesce(F.col("b") > F.col("nasa_p95"), F.lit(False))
    out = long.join(limits, "variable").groupBy("variable", "open_p95", "nasa_p95").agg(
        F.count_if(ea).alias("open_event_days"), F.count_if(eb).alias("nasa_event_days"), F.count_if(ea & eb).alias("intersection_days"),
        F.count_if(ea | eb).alias("_union"))
    return out.withColumns({"jaccard_agreement": F.try_divide("intersection_days", "_union"),
                            "open_event_recall_against_nasa": F.try_divide("intersection_days", "nasa_event_days")}).drop("_union")


# --- look-back join ------------------------------------------------------------------

def lag_features(scenes: DataFrame, daily: DataFrame, scene_keys: Sequence[str], series_keys: Sequence[str] = (),
                 lags: Sequence[int] = tuple(LAG_DAYS)) -> DataFrame:
    """Weather of the days before each scene (the scene day excluded).

    Scene dates are distinct calendar days, so features are computed once per date by an equi join on
    the exploded look-back days and then joined to the scenes. A sum is NULL unless all days are there.
    """
    scene_keys, series_keys = list(scene_keys), list(series_keys)
    longest = max(lags)
    dates = scenes.select("acquisition_date").distinct()
    back = dates.select("acquisition_date", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("back")).withColumn(
        "date", F.date_sub(F.col("acquisition_date"), F.col("back")))
    joined = back.join(daily, "date")
    rain = F.col("precipitation_sum")
    aggregates = []
    for d in lags:
        near = F.col("back") <= d
        pick = lambda c: F.when(near, F.col(c))
        aggregates += [
            F.when(F.count(pick("precipitation_sum")) >= d, F.sum(F.when(near, rain))).alias(f"precipitation_preceding_{d}d_mm"),
            F.avg(pick("temperature_2m_mean")).alias(f"temperature_mean_preceding_{d}d_c"),
            F.max(pick("temperature_2m_max")).alias(f"tmax_max_preceding_{d}d_c"),
            F.coalesce(F.try_divide(F.count(pick("precipitation_sum")), F.count_if(near)), F.lit(0.0)).alias(f"data_completeness_preceding_{d}d")]
    week = F.col("back") <= 7
    aggregates.append(F.avg(F.when(week, F.col("relative_humidity_2m_mean"))).alias("humidity_mean_preceding_7d_percent"))
    if "soil_moisture_0_to_7cm_mean" in daily.columns:
        aggregates.append(F.avg(F.when(week, F.col("soil_moisture_0_to_7cm_mean"))).alias("soil_moisture_mean_preceding_7d_m3m3"))
    features = joined.groupBy(*series_keys, "acquisition_date").agg(*aggregates)
    return scenes.select(*scene_keys, "acquisition_date").join(features, "acquisition_date", "left")


def lag_summary(features: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, median, minimum and maximum of every feature per epoch and provider."""
    return features.groupBy(*keys).agg(*[x for c in columns for x in (
        F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


# --- leave-one-out -------------------------------------------------------------------

def leave_one_out(series: DataFrame, keys: Sequence[str], unit: str, x: str, y: str) -> DataFrame:
    """Spearman of (x, y) over epochs, its range when one epoch is left out, and sign stability.

    Each row goes to every leave-out sample but its own; epochs are few by design.
    """
    keys = list(keys)
    units = series.groupBy(*keys).agg(F.array_sort(F.collect_set(unit)).alias("_units"))
    wide = series.join(units, keys) if keys else series.withColumn("_units", units.scalar())
    samples = F.concat(F.array(F.lit(None).cast("string")), F.col("_units"))
    long = wide.withColumn("_omitted", F.explode(samples)).where(F.col("_omitted").isNull() | (F.col("_omitted") != F.col(unit)))
    group = [*keys, "_omitted"]
    ranked = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for s, c in (("_rx", x), ("_ry", y)):
        w = W.partitionBy(*group)
        ranked = ranked.withColumn(s, F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*group, c)) - 1) / 2)
    rho = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(correlation("_rx", "_ry"), 12).alias("rho"))
    full = F.col("_omitted").isNull()
    out = rho.groupBy(*keys).agg(
        F.max(F.when(full, F.col("n"))).alias("n"), F.max(F.when(full, F.col("rho"))).alias("spearman_rho"),
        F.min(F.when(~full, F.col("rho"))).alias("leave_one_out_rho_min"), F.max(F.when(~full, F.col("rho"))).alias("leave_one_out_rho_max"),
        F.collect_list(F.when(~full & (F.col("rho") != 0), F.signum("rho"))).alias("_signs"))
    same = F.size(F.filter("_signs", lambda s: s == F.signum("spearman_rho")))
    return out.withColumn("sign_stability", F.try_divide(same, F.size("_signs"))).drop("_signs")
