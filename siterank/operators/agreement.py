"""Agreement of rankings and of paired measurements."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.operators.order import by_rows, value_positions

NORMAL_975 = 1.959963984540054


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs, NULL for a constant side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    left, right = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))


def average_ranks(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """Complete pairs of (keys, x, y) with multiplicity ``w`` and, per side, rows before (b), ties (m) and average rank (r).

    In the unbounded form equal pairs are merged first, so the work follows the number of distinct pairs.
    """
    keys = list(keys)
    pairs = (
        df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    if bounded:
        group = W.partitionBy(*keys)
        pairs = pairs.withColumns({
            "w": F.lit(1), "total": F.count(F.lit(1)).over(group),
            **{f"b{s}": F.rank().over(group.orderBy(s)) - 1 for s in ("x", "y")},
            **{f"m{s}": F.count(F.lit(1)).over(W.partitionBy(*keys, s)) for s in ("x", "y")}})
    else:
        pairs = pairs.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w"))
        for side in ("x", "y"):
            positions = value_positions(pairs, keys, side, "w").select(
                *keys, F.col("value").alias(side), F.col("before").alias(f"b{side}"), F.col("n").alias(f"m{side}"),
                *([F.col("total")] if side == "x" else []))
            pairs = pairs.join(by_rows(positions), [*keys, side])
    return pairs.withColumns({f"r{s}": F.col(f"b{s}") + (F.col(f"m{s}") + 1) / F.lit(2.0) for s in ("x", "y")})


def _moments() -> list[Column]:
    w, centre = F.col("w"), (F.col("total") + 1) / F.lit(2.0)
    dx, dy = F.col("rx") - centre, F.col("ry") - centre
    return [(w * dx * dy).alias("_xy"), (w * dx * dx).alias("_xx"), (w * dy * dy).alias("_yy")]


RHO = "CASE WHEN _xx > 0 AND _yy > 0 THEN _xy / sqrt(_xx * _yy) END"


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False) -> DataFrame:
    """keys, n, rho. Weighted moments of the ranks, NULL when one side is constant."""
    ranked = average_ranks(df, keys, x, y, bounded).select(*keys, "w", *_moments())
    sums = ranked.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.sum(c).alias(c) for c in ("_xy", "_xx", "_yy")])
    return sums.select(*keys, "n", F.expr(RHO).alias("rho"))


#: Positions of one side that are counted in one task.
BUCKET = 1 << 18
_SUMS = ("w", "_xy", "_xx", "_yy", "tx", "vx", "ux", "ty", "vy", "uy", "txy")


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weight of the pairs with x_i < x_j and y_i > y_j, one bit of y's rank at a time.

    Rows that share the higher bits stand together in order of x; those with the bit set that come before those without it are inverted.
    """
    if not len(w):
        return 0.0
    order = np.lexsort((y, x))  # equal x by ascending y, which inverts nothing
    rank = np.unique(y, return_inverse=True)[1][order]
    w, total = w[order].astype(float), 0.0
    for bit in range(max(1, int(rank.max(initial=0)).bit_length()) - 1, -1, -1):
        high, one = rank >> (bit + 1), (rank >> bit) & 1
        head = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        passed = np.cumsum(w * one)
        passed -= np.repeat((passed - w * one)[head], np.diff(np.append(head, len(w))))
        total += float(np.dot(w * (1 - one), passed))
        turn = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[turn], w[turn]
    return total


def _bucket_inversions(keys: Sequence[str], sums_of: Sequence[str]):
    """One bucket of x (side 0) or of y (side 1) to its inverted weight, and for side 0 the sums and the weight per bucket of y."""

    def run(rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_numpy()
        first = rows.column("side")[0].as_py() == 0
        d = inversions(get("gx"), get("by"), get("w"))
        cells, at = np.unique(get("yb"), return_inverse=True)
        sums = [float(get(c).sum()) if first else 0.0 for c in sums_of]
        made = [pa.array([d]), pa.array([rows.column("xb")[0].as_py()], pa.int64()), pa.array([cells if first else []], pa.list_(pa.int64())),
                pa.array([np.bincount(at, get("w")) if first else []], pa.list_(pa.float64()))]
        return pa.table([*[rows.column(k).slice(0, 1) for k in keys], *made, *[pa.array([x]) for x in sums]], names=[*keys, "d", "xb", "cells", "cell_w", *sums_of])

    return run


def _total_inversions(keys: Sequence[str], sums_of: Sequence[str]):
    """All buckets of one group: their inverted weights and sums, and the pairs that differ in both buckets by the table of cells."""

    def run(rows: pa.Table) -> pa.Table:
        cells = [(np.full(len(c), x), np.asarray(c), np.asarray(w)) for x, c, w in zip(*(rows.column(n).to_pylist() for n in ("xb", "cells", "cell_w"))) if c]
        d = float(rows.column("d").to_numpy().sum()) + inversions(*(np.concatenate(x) for x in zip(*cells)))
        return pa.table([*[rows.column(k).slice(0, 1) for k in keys], pa.array([d]), *[pa.array([float(rows.column(c).to_numpy().sum())]) for c in sums_of]], names=[*keys, "d", *sums_of])

    return run


def count_inversions(rows: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """keys, d (weight of the pairs with x before and y above), and the sums of further columns.

    ``rows`` has the order on both sides (bx, by), weight w, their buckets (xb, yb), whether a row's x has a bucket of its own (hx) and whether it
    may be inverted with rows of other x buckets in its y bucket (twice). A row moves once or twice, and a task holds one bucket.
    """
    by_x = F.struct(F.lit(0).alias("side"), F.col("xb").alias("b"), F.when(F.col("hx"), F.col("yb")).otherwise(0).cast("bigint").alias("sub"), F.col("bx").alias("gx"))
    by_y = F.struct(F.lit(1).alias("side"), F.col("yb").alias("b"), F.lit(0).cast("bigint").alias("sub"), F.col("xb").alias("gx"))
    dealt = rows.select("*", F.explode(F.when(F.col("twice"), F.array(by_x, by_y)).otherwise(F.array(by_x))).alias("_d")).select("*", "_d.*").drop("_d", "bx", "hx", "twice")
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    head, tail = ", ".join(f"`{k}` {kinds[k]}" for k in keys), "".join(f", {c} double" for c in sums)
    parts = dealt.groupBy(*keys, "side", "b", "sub").applyInArrow(_bucket_inversions(keys, sums), f"{head}, d double, xb bigint, cells array<bigint>, cell_w array<double>{tail}")
    return parts.groupBy(*keys).applyInArrow(_total_inversions(keys, sums), f"{head}, d double{tail}")


def rank_agreement(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False, bucket: int = BUCKET) -> DataFrame:
    """keys, n, rho, tau-b with its score S and a normal-approximation p, without forming pairs.

    Discordant pairs are inversions. Rows are dealt by ranges of their x position, where a task counts the inversions among
    them; dealt again by ranges of y, those of different x ranges; and pairs that differ in both ranges come from the table of weights
    per (x range, y range), which has (n / bucket)^2 cells. A value that fills more than a range has one of its own: its rows are not
    inverted among themselves and are spread by the other side. A row moves twice.
    """
    if not keys:
        return rank_agreement(df.withColumn("_all", F.lit(1)), ["_all"], x, y, bounded, bucket).drop("_all")
    keys = list(keys)
    tie = lambda s: [
        (F.col("w") * (F.col(f"m{s}") - 1) / 2).alias(f"t{s}"),
        (F.col("w") * (F.col(f"m{s}") - 1).cast("double") * (2 * F.col(f"m{s}") + 5)).alias(f"v{s}"),
        (F.col("w") * (F.col(f"m{s}") - 1).cast("double") * (F.col(f"m{s}") - 2)).alias(f"u{s}"),
    ]
    ranked = average_ranks(df, keys, x, y, bounded)
    same = F.count(F.lit(1)).over(W.partitionBy(*keys, "x", "y")) if bounded else F.col("w")
    heavy = lambda s: F.col(f"m{s}") > bucket
    bucketed = ranked.select(
        *keys, F.col("w").cast("double").alias("w"), "bx", "by", *[c.cast("double").alias(n) for c, n in zip(_moments(), ("_xy", "_xx", "_yy"))], *tie("x"), *tie("y"),
        (F.col("w") * (same - 1) / 2).alias("txy"), *[(2 * F.floor(F.col(f"b{s}") / bucket) + heavy(s).cast("int")).cast("bigint").alias(f"{s}b") for s in ("x", "y")],
        heavy("x").alias("hx"), (~heavy("y") & (F.col("total") > bucket)).alias("twice"))
    out = count_inversions(bucketed, keys, _SUMS)
    n = F.col("w")
    pairs = n * (n - 1) / 2
    score = pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    denominator = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    variance = (
        (n * (n - 1) * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18
        + F.try_divide(2 * F.col("tx") * F.col("ty"), n * (n - 1))
        + F.try_divide(F.col("ux") * F.col("uy"), 9 * n * (n - 1) * (n - 2))
    )
    z = F.abs(score) / F.sqrt(variance)
    return out.select(*keys, n.cast("bigint").alias("n"), F.expr(RHO).alias("rho"), score.alias("s"), F.when(denominator > 0, score / denominator).alias("tau"),
                      F.when((n > 2) & (variance > 0), two_sided(z)).alias("p"))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail by the Abramowitz-Stegun 7.1.26 polynomial (error below 1.5e-7)."""
    a = z / F.lit(1.4142135623730951)
    t = 1 / (1 + F.lit(0.3275911) * a)
    series = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741)
             + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return series * F.exp(-a * a)


def rank_change(df: DataFrame, keys: Sequence[str], reference: str, other: str, name: str, bounded: bool = False) -> DataFrame:
    """Rho, tau, top-3/5 overlap, mean and maximum shift, shifts of three or more, and the new leader."""
    keys = list(keys)
    shift = F.abs(F.col(reference) - F.col(other))
    both = lambda k: F.sum(((F.col(reference) <= k) & (F.col(other) <= k)).cast("int"))
    summary = df.groupBy(*keys).agg(
        both(3).alias("top3_overlap"), both(5).alias("top5_overlap"),
        F.avg(shift).alias("mean_absolute_rank_shift"), F.max(shift).alias("maximum_absolute_rank_shift"),
        F.sum((shift >= 3).cast("int")).alias("shifts_ge3"),
        F.min(F.struct(F.col(other), F.col(name).alias("leader")))["leader"].alias("_leader"),
        (F.min(other) < F.max(other)).alias("_varies"),
    )
    ranks = rank_agreement(df, keys, reference, other, bounded).select(
        *keys, F.col("rho").alias("spearman_rho"), F.col("tau").alias("kendall_tau"))
    out = summary.join(ranks, keys, "left")
    null_if_tied = lambda c: F.when(F.col("_varies"), F.col(c)).alias(c)
    return out.select(
        *keys, null_if_tied("spearman_rho"), null_if_tied("kendall_tau"), "top3_overlap", "top5_overlap",
        null_if_tied("mean_absolute_rank_shift"), null_if_tied("maximum_absolute_rank_shift"), null_if_tied("shifts_ge3"),
        F.when(F.col("_varies"), F.col("_leader")).otherwise("All components tied").alias("rank_1_component"),
    )


def paired_agreement(df: DataFrame, keys: Sequence[str], left: str, right: str, bounded: bool = False) -> DataFrame:
    """N, Pearson, Spearman, mean bias, RMSE and MAE over complete pairs."""
    keys = list(keys)
    d = F.col(left) - F.col(right)
    n = F.count(d)
    base = df.groupBy(*keys).agg(
        n.alias("n"), F.when(n > 2, correlation(left, right)).alias("pearson_r"), F.avg(d).alias("mean_bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
    )
    rho = spearman(df, keys, left, right, bounded).select(*keys, F.when(F.col("n") > 2, F.col("rho")).alias("spearman_rho"))
    return base.join(rho, keys, "left")


def spearman_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    """Bonett-Wright 95 % interval."""
    r = F.least(F.greatest(rho, F.lit(-0.999999)), F.lit(0.999999))
    half = F.lit(NORMAL_975) * F.sqrt((1 + r * r / 2) / (n - 3))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)
