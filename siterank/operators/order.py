"""Exact order statistics and ranks that never hold one group in one task.

``value_positions`` is the shared primitive. Rows are first reduced to counts per
(group, value), which combine map-side and spread a hot group over all tasks. A
monotone bucket of the value then splits the group: bucket totals give the offset of
each bucket and a window inside one (group, bucket) gives the offset of each value.
Quantiles read the rows twice instead: counts per coarse bucket tell which buckets hold
the wanted places, and only values of these are counted, so rows are hardly moved.
Where groups overlap, ``quantiles_of_cells`` counts every row once in the finest cell it lies in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.operators.lineage import materialise

# log1p is semi-monotonic on the JVM, so the bucket order always follows the value order.
BUCKETS_PER_UNIT = 8192.0
COARSE_BUCKETS_PER_UNIT = 64.0
MAGNITUDE_SCALE = 1048576.0
#: Buckets of a value in a cell: few enough that a task counts them without many partial rows, narrow enough that few values are wanted.
CELL_BUCKETS_PER_UNIT = 32.0
CELL_BUCKET_LIMIT = (1 << 15) - 2
#: Rows of one key from which on its groups are no longer left to one task.
LARGE = 1 << 16


def _bucket(value: Column, per_unit: float = BUCKETS_PER_UNIT) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * MAGNITUDE_SCALE) * per_unit)


def by_rows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: sorted and merged. Statistics see the bytes of a compressed file below an
    explode or a count, so such a side passes for small and would be sent to the driver whole."""
    return df.hint("merge")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_positions(
    df: DataFrame, keys: Sequence[str], value: str | Column, weight: str | Column | None = None
) -> DataFrame:
    """Per distinct (keys, value): ``n`` rows equal, ``before`` rows smaller, ``total`` rows in the group.

    NULL values take no position. ``weight`` is an integer multiplicity.
    """
    keys = list(keys)
    amount = F.lit(1) if weight is None else _col(weight)
    counted = (
        df.select(*keys, (_col(value).cast("double") + F.lit(0.0)).alias("value"), amount.cast("bigint").alias("_w"))
        .where(F.col("value").isNotNull() & (F.col("_w") > 0))
        .groupBy(*keys, "value")
        .agg(F.sum("_w").alias("n"))
        .withColumn("_b", _bucket(F.col("value")))
    )
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("n").alias("_bn"))
        .withColumn("total", F.sum("_bn").over(group))
        .withColumn("_start", F.sum("_bn").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_bn"))
        .drop("_bn")
    )
    renamed = buckets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "total", "_start")
    same = F.col("_b") == F.col("_kb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = counted.join(by_rows(renamed), same).drop("_kb", *[f"_k_{k}" for k in keys])
    inside = W.partitionBy(*keys, "_b").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *keys, "value", "n", (F.col("_start") + F.sum("n").over(inside) - F.col("n")).alias("before"), "total"
    )


def numbered(df: DataFrame, order: Sequence[str | Column], output: str, sums: dict[str, str | Column] | None = None) -> DataFrame:
    """Rows with their dense place from 0 in the order given, and running sums up to and including each row.

    Rows are sorted by ranges over all tasks. The ranges' sizes and sums, one row each, are added up on the driver and give every
    range its offset, so no window runs over all rows.
    """
    sums = {k: _col(c) for k, c in (sums or {}).items()}
    keys = [_col(c) for c in order]
    placed = materialise(df.withColumns({f"_s_{k}": c for k, c in sums.items()}).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{k}").alias(f"_o_{k}") for k in sums]).collect()
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    wide = {k: kinds[f"_s_{k}"] in ("double", "float") for k in sums}
    before, rows = [0, *[0.0 if wide[k] else 0 for k in sums]], []
    for r in sorted(ranges):
        rows.append((r[0], *before))
        before = [b + (x or 0) for b, x in zip(before, r[1:])]
    schema = "_range bigint, _n bigint" + "".join(f", _o_{k} {'double' if wide[k] else 'bigint'}" for k in sums)
    offsets = df.sparkSession.createDataFrame(rows, schema)
    inside = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(offsets, "_range").withColumn(output, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_n"))
    out = out.withColumns({k: F.col(f"_o_{k}") + F.sum(f"_s_{k}").over(inside) for k in sums})
    return out.select(*df.columns, output, *sums)


def _places(probability: float | Column) -> tuple[Column, Column, Column]:
    """The two places a quantile lies between and its share of the way."""
    h = (F.col("total") - 1) * (probability if isinstance(probability, Column) else F.lit(float(probability)))
    return F.floor(h), F.ceil(h), h - F.floor(h)


def _covers(place: Column) -> Column:
    return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))


def _at(probability: float | Column) -> tuple[Column, Column, Column]:
    low, high, share = _places(probability)
    return (
        F.max(F.when(_covers(low), F.col("value"))),
        F.max(F.when(_covers(high), F.col("value"))),
        F.max(share),
    )


def _wanted_buckets(long: DataFrame, group: Sequence[str], probabilities) -> DataFrame:
    """Coarse buckets that hold a wanted place, with the rows before them and in the group; written, so that its size is known."""
    counts = long.groupBy(*group, "_c").agg(F.sum("_w").alias("n"))
    window = W.partitionBy(*group)
    placed = counts.withColumns({
        "total": F.sum("n").over(window),
        "before": F.sum("n").over(window.orderBy("_c").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")})
    wanted = F.lit(False)
    for p in probabilities:
        for place in _places(p)[:2]:
            wanted = wanted | _covers(place)
    return materialise(placed.where(wanted).select(
        *[F.col(k).alias(f"_k_{k}") for k in [*group, "_c"]], F.col("before").alias("_first"), F.col("total").alias("_total")))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, str | Column],
    probabilities: dict[str, float],
    weight: str | Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles per group in long form: keys, ``measure``, ``n`` and one column per probability.

    Two passes over the rows serve all measures; the result is exact at any group size. The first counts rows per coarse bucket,
    the second the values of the buckets that hold a wanted place, so ``df`` should be cheap to read again. ``bounded`` says
    that the design bounds every group to what fits one aggregation buffer, so the built-in aggregate will do.
    """
    keys = list(keys)
    if bounded:
        wide = _builtin_quantiles(df, keys, measures, probabilities, weight)
        entries = F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(f"{m}_n").alias("n"), *[F.col(f"{m}_{p}").alias(p) for p in probabilities])
            for m in measures])
        return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*").where(F.col("n") > 0)
    parts = [
        F.struct(F.lit(name).alias("measure"), _col(c).cast("double").alias("value")) for name, c in measures.items()
    ]
    group = [*keys, "measure"]
    amount = F.lit(1) if weight is None else _col(weight)
    long = df.select(*keys, amount.cast("bigint").alias("_w"), F.explode(F.array(*parts)).alias("_m")).select(
        *keys, "_w", "_m.measure", (F.col("_m.value") + F.lit(0.0)).alias("value"))
    long = long.where(F.col("value").isNotNull() & (F.col("_w") > 0)).withColumn("_c", _bucket(F.col("value"), COARSE_BUCKETS_PER_UNIT))
    near = long.join(_wanted_buckets(long, group, probabilities.values()), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*group, "_c"]])
    inside = [*group, "_c", "_first", "_total"]
    positions = value_positions(near, inside, "value", "_w").select(
        *group, "value", "n", (F.col("_first") + F.col("before")).alias("before"), F.col("_total").alias("total"))
    aggregates = [F.max("total").alias("n")]
    for name, p in probabilities.items():
        low, high, share = _at(p)
        aggregates += [low.alias(f"_lo_{name}"), high.alias(f"_hi_{name}"), share.alias(f"_t_{name}")]
    out = positions.groupBy(*keys, "measure").agg(*aggregates)
    final = [
        (F.col(f"_lo_{p}") * (1 - F.col(f"_t_{p}")) + F.col(f"_hi_{p}") * F.col(f"_t_{p}")).alias(p)
        for p in probabilities
    ]
    return out.select(*keys, "measure", "n", *final)


def quantiles_wide(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, str | Column],
    probabilities: dict[str, float],
    weight: str | Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """As ``quantiles`` with one column ``<measure>_<probability>`` each and ``<measure>_n``."""
    if bounded:
        return _builtin_quantiles(df, list(keys), measures, probabilities, weight)
    long = quantiles(df, keys, measures, probabilities, weight)
    aggregates = []
    for m in measures:
        hit = F.col("measure") == m
        aggregates += [F.max(F.when(hit, F.col(p))).alias(f"{m}_{p}") for p in probabilities]
        aggregates.append(F.coalesce(F.max(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{m}_n"))
    return long.groupBy(*keys).agg(*aggregates) if keys else long.agg(*aggregates)


def _cell_key(cell: Column, measure: Column, bucket: Column) -> Column:
    """Cell (below 2**40), measure (below 2**7) and bucket as one number, so that counting and joining hash a long."""
    return F.shiftleft(F.shiftleft(cell.cast("bigint"), 7) + measure, 16) + bucket + F.lit(CELL_BUCKET_LIMIT + 1)


def quantiles_of_cells(rows: DataFrame, measures: dict[str, str | Column], groups: DataFrame, keys: Sequence[str],
                       wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear-interpolation quantiles of groups that overlap, each a union of cells: the keys and one column per output.

    ``rows`` have a whole number ``cell``, and ``groups`` lists (cell, *keys, outputs): the outputs a group asks for, the same for all its
    cells; the others are NULL. ``wanted`` maps an output to (measure, probability). A row is counted once in its cell, however many groups hold that, and counts are added up to groups. ``rows`` are read twice: counts per
    bucket tell which buckets hold the wanted places, then values of these are counted. The result is exact at any group size;
    a measure without a value gives NULL. Cells and groups are few beside the rows and are broadcast.
    """
    keys, number = list(keys), {m: i for i, m in enumerate(measures)}
    limit = F.lit(CELL_BUCKET_LIMIT).cast("bigint")
    bucket = lambda v: F.when(F.isnan(v), limit + 1).otherwise(F.greatest(-limit, F.least(limit, _bucket(v, CELL_BUCKETS_PER_UNIT))))
    wide = rows.select("cell", *[(_col(c).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(measures.values())])
    wide = wide.select("*", *[_cell_key(F.col("cell"), F.lit(i).cast("bigint"), bucket(F.col(f"v{i}"))).alias(f"k{i}") for i in range(len(measures))])
    # unpivoted rows need no array of structs for each line, as an explode does
    pairs = ", ".join(f"(k{i}, v{i})" for i in range(len(measures)))
    keyed = rows.sparkSession.sql(f"SELECT _key, value FROM {{wide}} UNPIVOT ((_key, value) FOR _of IN ({pairs}))", wide=wide).where(F.col("value").isNotNull())
    parts = {"_c": F.shiftright("_key", 23), "_m": F.shiftright("_key", 16).bitwiseAND(F.lit(127)), "_b": F.col("_key").bitwiseAND(F.lit(65535))}

    counts = materialise(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_w"))).withColumns(parts)
    requests = F.array(*[F.struct(F.lit(o).alias("_o"), F.lit(number[m]).cast("bigint").alias("_m"), F.lit(float(p)).alias("_p")) for o, (m, p) in wanted.items()])
    asked = groups.select(F.col("cell").cast("bigint").alias("_c"), F.struct(*keys).alias("_g"), "outputs", F.explode(requests).alias("_r")).select("_c", "_g", "outputs", "_r.*")
    asked = materialise(asked.where(F.array_contains("outputs", F.col("_o"))).drop("outputs"))
    per_group = counts.join(F.broadcast(asked), ["_c", "_m"]).groupBy("_g", "_o", "_m", "_p", "_b").agg(F.sum("_w").alias("n"))
    window = W.partitionBy("_g", "_o")
    placed = per_group.withColumns({
        "total": F.sum("n").over(window),
        "before": F.sum("n").over(window.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")})
    low, high, _ = _places(F.col("_p"))
    held = materialise(placed.where(_covers(low) | _covers(high)).select(
        F.monotonically_increasing_id().alias("_q"), "_g", "_o", "_m", "_p", "_b", F.col("before").alias("_first"), F.col("total").alias("_total")))

    near = asked.join(F.broadcast(held), ["_g", "_o", "_m", "_p"]).select("_c", "_m", "_b", "_q")
    keep = materialise(near.select(_cell_key(F.col("_c"), F.col("_m"), F.col("_b") - F.lit(CELL_BUCKET_LIMIT + 1)).alias("_key")).distinct())
    values = materialise(keyed.join(F.broadcast(keep), "_key").groupBy("_key", "value").agg(F.count(F.lit(1)).alias("_w"))).withColumns(parts)
    positions = value_positions(values.join(F.broadcast(near), ["_c", "_m", "_b"]), ["_q"], "value", "_w").drop("total")
    positions = positions.join(F.broadcast(held), "_q").select(
        "_g", "_o", "_p", "value", "n", (F.col("_first") + F.col("before")).alias("before"), F.col("_total").alias("total"))
    below, above, share = _at(F.col("_p"))
    found = positions.groupBy("_g", "_o").agg(below.alias("_lo"), above.alias("_hi"), share.alias("_t")).select(
        "_g", "_o", (F.col("_lo") * (1 - F.col("_t")) + F.col("_hi") * F.col("_t")).alias("q"))
    wide = asked.select("_g", "_o").distinct().join(found, ["_g", "_o"], "left").groupBy("_g").agg(
        *[F.max(F.when(F.col("_o") == o, F.col("q"))).alias(o) for o in wanted])
    return wide.select("_g.*", *wanted)


def by_size(df: DataFrame, key: str, summarise: Callable[[DataFrame, bool], DataFrame], large: int = LARGE) -> DataFrame:
    """``summarise(rows, bounded)`` of the rows of small keys, dealt by key, and of the keys with more than ``large`` rows.

    Groups within a small key fit an aggregation buffer and need no further exchange; those of a large key are spread.
    """
    big = materialise(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(F.col(key).alias("_big")))
    same = F.col(key).eqNullSafe(F.col("_big"))
    small = summarise(df.join(big, same, "left_anti").repartition(key), True)
    return small if big.isEmpty() else small.unionByName(summarise(df.join(big, same, "left_semi"), False))


def _builtin_quantiles(df, keys, measures, probabilities, weight) -> DataFrame:
    amount = F.lit(1) if weight is None else _col(weight)
    points = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    value = lambda c: _col(c).cast("double") + F.lit(0.0)
    found = df.groupBy(*keys).agg(
        *[F.percentile(value(c), points, amount).alias(f"_q_{m}") for m, c in measures.items()],
        *[F.coalesce(F.sum(F.when(_col(c).isNotNull(), amount)), F.lit(0)).cast("bigint").alias(f"{m}_n") for m, c in measures.items()])
    return found.select(*keys, *[x for m in measures for x in (
        *[F.col(f"_q_{m}")[i].alias(f"{m}_{p}") for i, p in enumerate(probabilities)], F.col(f"{m}_n"))])


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, output: str, method: str = "average",
               descending: bool = True, tie: str | None = None, bounded: bool = False) -> DataFrame:
    """Attach a rank within the keys; NULL values keep a NULL rank.

    ``average`` and ``min`` share a rank among ties; ``ordinal`` orders ties by ``tie``.
    ``bounded`` declares that the design bounds the population of a key, whatever the input; it is never measured.
    """
    keys = list(keys)
    if bounded:
        return df.withColumn(output, F.when(F.col(value).isNotNull(), inventory_rank(keys, value, method, tie, descending)))
    oriented = -F.col(value) if descending else F.col(value)
    base = df.withColumn("_v", oriented.cast("double") + F.lit(0.0))
    positions = value_positions(base, keys, "_v").withColumnRenamed("value", "_v").drop("total")
    joined = base.join(by_rows(positions), [*keys, "_v"], "left")
    if method == "average":
        rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    elif method == "min":
        rank = F.col("before") + 1
    elif method == "ordinal":
        within = F.row_number().over(W.partitionBy(*keys, "_v").orderBy(tie))
        rank = F.when(F.col("before").isNotNull(), F.col("before") + within)
    else:
        raise ValueError(f"unknown tie rule {method}")
    return joined.withColumn(output, rank).select(*[c for c in df.columns if c != output], output)


def with_percentile(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, bool]], ids: Sequence[str],
                    bounded: bool = False) -> DataFrame:
    """Oriented mid-rank percentiles ``(average rank - 0.5) / valid`` for several columns at once.

    ``measures`` maps an output name to (column, adverse_high). ``ids`` with ``keys`` identify a row.
    """
    keys, ids = list(keys), list(ids)
    if bounded:
        return df.withColumns({out: inventory_percentile(keys, c, high) for out, (c, high) in measures.items()})
    parts = [
        F.struct(F.lit(out).alias("measure"),
                 ((F.col(c) if high else -F.col(c)).cast("double") + F.lit(0.0)).alias("value"))
        for out, (c, high) in measures.items()
    ]
    long = df.select(*keys, *ids, F.explode(F.array(*parts)).alias("_m")).select(*keys, *ids, "_m.*")
    positions = value_positions(long, [*keys, "measure"], "value")
    scored = long.join(by_rows(positions), [*keys, "measure", "value"]).withColumn(
        "p", (F.col("before") + F.col("n") / F.lit(2.0)) / F.col("total")
    )
    wide = scored.groupBy(*keys, *ids).agg(
        *[F.max(F.when(F.col("measure") == out, F.col("p"))).alias(out) for out in measures]
    )
    return df.join(by_rows(wide), [*keys, *ids], "left")


# Rules for populations bounded by the design (the inventory inside one draw or scenario).

def inventory_rank(partition: Sequence[str], value: str | Column, method: str, tie: str | None = None,
                   descending: bool = True) -> Column:
    """Rank inside one draw or scenario, whose population is the component inventory."""
    v = _col(value)
    order = v.desc() if descending else v.asc()
    window = W.partitionBy(*partition)
    if method == "ordinal":
        return F.row_number().over(window.orderBy(order, tie))
    lowest = F.rank().over(window.orderBy(order))
    if method == "min":
        return lowest
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, v))
    return lowest + (ties - 1) / F.lit(2.0)


def inventory_percentile(partition: Sequence[str], value: str | Column, adverse_high: bool = True) -> Column:
    """Oriented mid-rank percentile inside one draw; NULL stays NULL and takes no place."""
    v = _col(value)
    order = v.asc_nulls_last() if adverse_high else v.desc_nulls_last()
    window = W.partitionBy(*partition)
    lowest = F.rank().over(window.orderBy(order))
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, v))
    return F.when(v.isNotNull(), (lowest + (ties - 1) / F.lit(2.0) - 0.5) / F.count(v).over(window))
