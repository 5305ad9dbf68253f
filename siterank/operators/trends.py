"""Robust trends: Theil-Sen, its rank interval, residual moving-block bootstrap and false-discovery control.

The slopes of a long series are never listed: the k-th of them is found by counting how many lie below trial slopes, and a pair
has a slope below theta exactly if y - theta x inverts it. Series of at most ``SMALL`` points list their slopes in the task that holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions import keyed
from siterank.operators.agreement import BUCKET, NORMAL_975, correlation, count_inversions, rank_agreement
from siterank.operators.lineage import materialise
from siterank.operators.order import quantiles_wide, with_ranks

SMALL = 512
TRIALS = 7
ROUNDS = 100


def _slopes(rows: pa.Table) -> np.ndarray:
    """All slopes between points of different x, ascending."""
    x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
    run, rise = x[:, None] - x, y[:, None] - y
    return np.sort(rise[run > 0] / run[run > 0])


def _listed(keys: Sequence[str]):
    def run(rows: pa.Table) -> pa.Table:
        slopes = _slopes(rows)
        at = [k for k in rows.column("ks")[0].as_py() if 0 <= k < len(slopes)]
        return pa.table([*[rows.column(k).slice(0, 1) for k in keys], pa.array([slopes[at].tolist() if len(slopes) else []], pa.list_(pa.float64()))], names=[*keys, "slopes"])

    return run


def _first_trials(keys: Sequence[str]):
    """Slopes of sampled points at and around the wanted shares."""

    def run(rows: pa.Table) -> pa.Table:
        slopes = _slopes(rows)
        wanted = np.asarray(rows.column("shares")[0].as_py())[:, None] + np.array([-0.2, -0.05, -0.01, 0.0, 0.01, 0.05, 0.2])
        found = np.unique(np.quantile(slopes, np.clip(wanted, 0, 1))) if len(slopes) else np.zeros(1)
        return pa.table([*[rows.column(k).slice(0, 1) for k in keys], pa.array([found.tolist()], pa.list_(pa.float64()))], names=[*keys, "thetas"])

    return run


def _head(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def slopes_below(points: DataFrame, trials: DataFrame, keys: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """keys, theta, below: the number of slopes less than each of ``thetas``.

    Points (pos, x, y) are numbered by x and then y, so points of equal x keep their order under every theta and are never inverted.
    """
    keys = list(keys)
    long = points.join(trials, keys).select(*keys, "pos", F.posexplode("thetas").alias("trial", "theta"), "x", "y").withColumn("by", F.col("y") - F.col("theta") * F.col("x"))
    group = [*keys, "trial", "theta"]
    placed = long.repartitionByRange(*group, "by", "pos").withColumn("yb", F.spark_partition_id().cast("bigint"))
    rows = placed.select(*group, F.lit(1.0).alias("w"), F.col("pos").alias("bx"), "by", F.floor(F.col("pos") / bucket).cast("bigint").alias("xb"), "yb", F.lit(False).alias("hx"), F.lit(True).alias("twice"))
    return count_inversions(rows, group).select(*keys, "theta", F.col("d").alias("below"))


def _searched(points: DataFrame, wanted: DataFrame, keys: list[str], tolerance: float, bucket: int) -> DataFrame:
    """The wanted order statistics of the slopes of long series, by narrowing [low, high) around each in rounds."""
    numbered = materialise(with_ranks(points, keys, "x", "pos", "ordinal", descending=False, tie="y"))
    sample = numbered.join(wanted, keys).where(F.pmod(F.xxhash64("pos"), F.ceil(F.col("n") / (0.75 * SMALL))) == 0)
    shares = sample.withColumn("shares", F.transform("ks", lambda k: k / (F.col("pairs") - 1)))
    trials = shares.groupBy(*keys).applyInArrow(_first_trials(keys), f"{_head(points, keys)}, thetas array<double>")
    infinite = F.lit(float("inf"))
    run, rise = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    sizes = numbered.groupBy(*keys).agg(F.coalesce(F.nullif(rise / run, F.lit(0.0)), F.lit(1.0)).alias("_size"))
    state = materialise(wanted.join(sizes, keys).select(*keys, "_size", F.posexplode("ks").alias("_r", "_k"), (-infinite).alias("_low"), infinite.alias("_high")))
    for _ in range(ROUNDS):
        below = slopes_below(numbered, trials, keys, bucket)
        narrowed = state.join(below, keys, "left").groupBy(*keys, "_size", "_r", "_k").agg(
            F.greatest(F.first("_low"), F.max(F.when(F.col("below") <= F.col("_k"), F.col("theta")))).alias("_low"),
            F.least(F.first("_high"), F.min(F.when(F.col("below") > F.col("_k"), F.col("theta")))).alias("_high"))
        state = materialise(narrowed)
        size = F.abs("_low") + F.abs("_high") + F.col("_size")
        middle = (F.col("_low") + F.col("_high")) / 2
        open_ = state.where((F.col("_low") == -infinite) | (F.col("_high") == infinite) | (F.col("_high") - F.col("_low") > tolerance * size))
        if open_.isEmpty():
            return state.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.when(F.abs(middle) <= tolerance * size, 0.0).otherwise(middle).alias("s")))), lambda e: e.s).alias("slopes"))
        steps = F.sequence(F.lit(1), F.lit(TRIALS))
        far = lambda i: F.pow(F.lit(8.0), i.cast("double")) * F.greatest(F.abs(F.coalesce(F.when(F.col("_low") > -infinite, F.col("_low")), F.when(F.col("_high") < infinite, F.col("_high")), F.lit(1.0))), F.lit(1e-6))
        inside = F.transform(steps, lambda i: F.when(F.col("_low") == -infinite, F.when(F.col("_high") == infinite, F.when(i % 2 == 0, far(i)).otherwise(-far(i))).otherwise(F.col("_high") - far(i)))
                             .when(F.col("_high") == infinite, F.col("_low") + far(i)).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * i / (TRIALS + 1)))
        trials = open_.select(*keys, F.explode(inside).alias("_t")).groupBy(*keys).agg(F.array_sort(F.collect_set("_t")).alias("thetas"))
    raise RuntimeError("slopes did not settle")


def order_slopes(points: DataFrame, wanted: DataFrame, keys: Sequence[str], tolerance: float = 1e-14, bucket: int = BUCKET) -> DataFrame:
    """keys, slopes: the ``ks``-th smallest (from 0) of the ``pairs`` slopes between the ``n`` points (x, y) of each series."""
    keys = list(keys)
    asked = wanted.where("pairs > 0").select(*keys, "n", "pairs", "ks")
    short = points.join(asked.where(F.col("n") <= SMALL), keys).select(*keys, "x", "y", "ks")
    listed = short.groupBy(*keys).applyInArrow(_listed(keys), f"{_head(points, keys)}, slopes array<double>")
    long = asked.where(F.col("n") > SMALL)
    if long.isEmpty():
        return listed
    return listed.unionByName(_searched(points.join(long.select(*keys), keys), long, keys, tolerance, bucket))


def series_points(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Complete (x, y) of each series."""
    return df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _ties(points: DataFrame, keys: list[str], side: str) -> DataFrame:
    c = F.col("c").cast("double")
    return points.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(c * (c - 1) / 2).alias("same"), F.sum(c * (c - 1) * (2 * c + 5)).alias(f"v{side}"), F.min(side).alias("least"), F.max(side).alias("most"))


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, tolerance: float = 1e-14, bucket: int = BUCKET) -> DataFrame:
    """Slope, both intercepts, Sen's 95 % interval, the effective sample size and whether y varies, per series."""
    keys = list(keys)
    points = materialise(series_points(df, keys, x, y))
    by_y = _ties(points, keys, "y").select(*keys, "vy", (F.col("least") < F.col("most")).alias("varies"))
    stats = _ties(points, keys, "x").drop("least", "most").join(by_y, keys).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("bigint"))
    n, m = F.col("n").cast("double"), F.col("pairs").cast("double")
    spread = F.sqrt(F.greatest((n * (n - 1) * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18, F.lit(0.0))) * NORMAL_975
    last = F.rint((m + spread) / 2)
    ks = F.array(F.floor((m - 1) / 2), F.floor(m / 2), F.greatest(F.rint((m - spread) / 2) - 1, F.lit(0.0)), F.least(last, m - 1))
    stats = materialise(stats.withColumn("ks", F.transform(ks, lambda k: k.cast("bigint"))))
    found = order_slopes(points, stats, keys, tolerance, bucket)
    at = quantiles_wide(points, keys, {"x": "x", "y": "y"}, {"median": 0.5}).select(*keys, "x_median", "y_median")
    slope = (F.col("slopes")[0] + F.col("slopes")[1]) / 2
    fits = stats.join(found, keys, "left").join(at, keys).select(
        *keys, "n", "pairs", "varies", slope.alias("slope"), (F.col("y_median") - slope * F.col("x_median")).alias("intercept"),
        F.col("slopes")[2].alias("slope_low_95"), F.col("slopes")[3].alias("slope_high_95"))
    fits = materialise(fits)
    level = points.join(fits.select(*keys, "slope"), keys).withColumn("rest", F.col("y") - F.col("slope") * F.col("x"))
    offset = quantiles_wide(level, keys, {"rest": "rest"}, {"median": 0.5}).select(*keys, F.col("rest_median").alias("residual_offset"))
    placed = materialise(with_ranks(level.join(offset, keys), keys, "x", "pos", "ordinal", descending=False, tie="y").select(*keys, "pos", (F.col("y") - F.col("residual_offset") - F.col("slope") * F.col("x")).alias("a")))
    lagged = placed.join(placed.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("a").alias("b")), [*keys, "pos"]).groupBy(*keys).agg(correlation("a", "b").alias("lag1"))
    out = fits.join(offset, keys, "left").join(lagged, keys, "left")
    size, lag1 = F.col("n").cast("double"), F.col("lag1")
    reduced = F.least(F.greatest(size * (1 - lag1) / F.nullif(1 + lag1, F.lit(0.0)), F.lit(2.0)), size)
    return out.withColumn("effective_n", F.when(lag1 > -1, reduced).otherwise(size))  # all n without a lag correlation; greatest passes over NULL


TREND_COLUMNS = ["n", "slope", "intercept", "slope_low_95", "slope_high_95", "effective_n"]


def block_bootstrap(fits: DataFrame, points: DataFrame, keys: Sequence[str], draws: int = 2000, block: int = 5, seed: int = keyed.SEED) -> DataFrame:
    """M1: residual moving-block draws; one row per (series, draw) with the fitted and the centred-null slope.

    Every place of a draw takes the residual of the place its keyed block start points at, by an equi-join. Adding a constant does not move a
    slope, so the null slope is that of the resampled residuals alone.
    """
    keys = list(keys)
    usable = fits.where((F.col("n") >= 8) & (F.col("n") >= block)).select(*keys, "n", "pairs", "slope", "residual_offset")
    fit = F.col("residual_offset") + F.col("slope") * F.col("x")
    placed = with_ranks(points, keys, "x", "pos", "ordinal", descending=False, tie="y").join(usable, keys).select(
        *keys, (F.col("pos") - 1).alias("i"), "n", "x", fit.alias("fit"), (F.col("y") - fit).alias("res"))
    placed = materialise(placed)
    start = keyed.pick(F.col("n") - block + 1, "block", *keys, "draw", F.floor(F.col("i") / block), seed=seed)
    drawn = placed.drop("res").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("from", start + F.col("i") % block)
    sampled = drawn.join(placed.select(*keys, F.col("i").alias("from"), "res"), [*keys, "from"])
    sides = F.array(F.struct(F.lit("slope").alias("side"), (F.col("fit") + F.col("res")).alias("y")), F.struct(F.lit("null_slope").alias("side"), F.col("res").alias("y")))
    series = [*keys, "draw", "side"]
    again = sampled.select(*keys, "draw", "x", F.explode(sides).alias("_s")).select(*series[:-1], "_s.side", "x", "_s.y")
    middle = F.array(F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2))
    each = usable.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("side", F.explode(F.array(F.lit("slope"), F.lit("null_slope")))).withColumn("ks", middle)
    found = order_slopes(again, each, series).withColumn("s", (F.col("slopes")[0] + F.col("slopes")[1]) / 2)
    wide = found.groupBy(*keys, "draw").agg(*[F.max(F.when(F.col("side") == side, F.col("s"))).alias(side) for side in ("slope", "null_slope")])
    return wide.join(usable.select(*keys, F.col("slope").alias("observed")), keys).select(*keys, "draw", "observed", "slope", "null_slope")


def bootstrap_interval(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """95 % interval of the slope and the +1 corrected two-sided p of the null."""
    q = F.percentile("slope", F.array(F.lit(0.025), F.lit(0.975)))
    hits = F.count_if(F.abs("null_slope") >= F.abs("observed"))
    out = draws.groupBy(*keys).agg(q.alias("_q"), ((1 + hits) / (F.count(F.lit(1)) + 1)).alias("block_p"), F.count(F.lit(1)).alias("draws"))
    return out.select(*keys, F.col("_q")[0].alias("block_low_95"), F.col("_q")[1].alias("block_high_95"), "block_p", "draws")


def benjamini_hochberg(df: DataFrame, p: str, output: str, family: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p within a family of tests; NULL stays NULL and is not counted."""
    part = W.partitionBy(*family, F.col(p).isNull()) if family else W.partitionBy(F.col(p).isNull())
    order = [F.col(p), *[F.col(t) for t in tie]]
    ranked = df.withColumns({"_i": F.row_number().over(part.orderBy(*order)), "_m": F.count(p).over(part)})
    raw = F.col(p) * F.col("_m") / F.col("_i")
    lowest = F.min(raw).over(part.orderBy("_i").rowsBetween(0, W.unboundedFollowing))
    return ranked.withColumn(output, F.when(F.col(p).isNotNull(), F.least(lowest, F.lit(1.0)))).drop("_i", "_m")


def trend_table(long: DataFrame, keys: Sequence[str], x: str, y: str, draws: int = 2000, block: int = 5,
                family: Sequence[str] = (), seed: int = keyed.SEED) -> DataFrame:
    """M2: the full trend record of every series, with short or constant series marked and not tested."""
    keys = list(keys)
    fits = materialise(theil_sen(long, keys, x, y))
    usable = (F.col("n") >= 8) & F.col("varies")
    boot = bootstrap_interval(block_bootstrap(fits.where(usable), series_points(long, keys, x, y), keys, draws, block, seed), keys)
    tau = rank_agreement(long, keys, x, y, bounded=True).select(*keys, F.col("tau").alias("kendall_tau"), F.col("p").alias("kendall_p_unadjusted"))
    out = fits.withColumn("_ok", usable).join(boot, keys, "left").join(tau, keys, "left")
    keep = [c for c in TREND_COLUMNS if c != "n"] + ["kendall_tau", "kendall_p_unadjusted"]
    out = out.select(*keys, "n", *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in keep], "block_low_95", "block_high_95", "block_p",
                     F.when(F.col("_ok"), "INFERENTIAL_WITH_BLOCK_BOOTSTRAP").otherwise("INSUFFICIENT_OR_CONSTANT").alias("status"))
    return benjamini_hochberg(out, "block_p", "fdr_adjusted_block_p", family, keys)


def trend_direction(annual: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Slopes of two products per variable and whether their signs agree."""
    long = annual.select("year", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.lit(s).alias("side"), F.col(f"{v}_{s}").alias("y")) for v in variables for s in ("open", "nasa")])).alias("o")).select("year", "o.*")
    fits = theil_sen(long, ["variable", "side"], "year", "y")
    wide = fits.groupBy("variable").agg(*[F.max(F.when(F.col("side") == s, F.col("slope"))).alias(f"{s}_slope") for s in ("open", "nasa")])
    return wide.withColumns({"direction_agreement": F.signum("open_slope") == F.signum("nasa_slope"),
                             "absolute_slope_difference": F.abs(F.col("open_slope") - F.col("nasa_slope"))})
