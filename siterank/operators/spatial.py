"""Points, polygons, envelopes and point-to-cell mapping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.functions.geodesy import circle_overlap
from siterank.operators.order import numbered
from siterank.operators.raster import around

EDGE_TOLERANCE = 1e-10


def envelope(points: DataFrame, margin: float = 5000.0, step: float = 30.0) -> DataFrame:
    """Bounding box grown by a margin and snapped outwards to the grid step."""
    down = lambda c: F.floor((F.min(c) - margin) / step) * step
    up = lambda c: F.ceil((F.max(c) + margin) / step) * step
    box = points.agg(down("x").alias("xmin"), down("y").alias("ymin"), up("x").alias("xmax"), up("y").alias("ymax"))
    return box.withColumns({"width": F.round((F.col("xmax") - F.col("xmin")) / step).cast("bigint"),
                            "height": F.round((F.col("ymax") - F.col("ymin")) / step).cast("bigint")})


def ring_edges(polygons: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """Edges of (polygon part, ring) from an array of parts, each an array of rings of [x, y] points."""
    parts = polygons.select(*keys, F.posexplode(rings).alias("part", "_rings"))
    ringed = parts.select(*keys, "part", F.posexplode("_rings").alias("ring", "_pts"))
    edges = ringed.select(*keys, "part", "ring", F.explode(F.zip_with(
        F.concat(F.slice("_pts", -1, 1), F.slice("_pts", F.lit(1), F.size("_pts") - 1)), "_pts",
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))).alias("e"))
    return edges.select(*keys, "part", "ring", "e.*")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_keys: Sequence[str], polygon_keys: Sequence[str], cell: float) -> DataFrame:
    """(point, polygon) with ``inside`` for the points in the tiles of a polygon's box; boundary points count as inside, holes are excluded.

    A tile of side ``cell`` that no edge touches lies wholly inside or outside, which its centre tells once; points there are settled by
    an equi join with the tile. Only points in tiles with edges meet edges, those of the same polygon in their row of tiles, and a ray is cast by the
    parity of crossings per ring. A polygon has about (box / cell)^2 tiles, so ``cell`` belongs near the size of the polygons.
    """
    parts = [*polygon_keys, "part"]
    low, high = lambda c: F.floor((F.col(c) - EDGE_TOLERANCE) / cell), lambda c: F.floor((F.col(c) + EDGE_TOLERANCE) / cell)

    def tiled(df: DataFrame) -> DataFrame:
        return df.withColumn("_ty", F.explode(F.sequence(low("ymin"), high("ymax")))).withColumn("_tx", F.explode(F.sequence(low("xmin"), high("xmax"))))

    edges = ring_edges(polygons, polygon_keys).withColumns({"xmin": F.least("x1", "x2"), "xmax": F.greatest("x1", "x2"), "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2")})
    boxes = edges.groupBy(*parts).agg(*[f(c).alias(c) for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))])
    touched = tiled(edges).select(*parts, "_tx", "_ty").distinct().withColumn("_touched", F.lit(True))
    tiles = tiled(boxes).select(*parts, "_tx", "_ty").join(touched, [*parts, "_tx", "_ty"], "left")
    centres = tiles.where(F.col("_touched").isNull()).select(*parts, "_tx", "_ty", ((F.col("_tx") + 0.5) * cell).alias("x"), ((F.col("_ty") + 0.5) * cell).alias("y"))
    plain = _cast_rays(centres, edges, ["_tx", "_ty"], parts, cell).withColumnRenamed("_in", "_whole")
    known = tiles.join(plain, [*parts, "_tx", "_ty"], "left")
    placed = points.select(*point_keys, "x", "y", F.floor(F.col("x") / cell).alias("_tx"), F.floor(F.col("y") / cell).alias("_ty")).join(known, ["_tx", "_ty"])
    settled = placed.where(F.col("_touched").isNull()).select(*point_keys, *parts, F.coalesce("_whole", F.lit(False)).alias("_in"))
    met = _cast_rays(placed.where("_touched").select(*point_keys, *parts, "x", "y"), edges, point_keys, parts, cell)
    return settled.unionByName(met).groupBy(*point_keys, *polygon_keys).agg(F.bool_or("_in").alias("inside"))


def _cast_rays(points: DataFrame, edges: DataFrame, point_keys: Sequence[str], parts: Sequence[str], cell: float) -> DataFrame:
    """Whether each point lies in the polygon part it is paired with, by the edges in its row of tiles."""
    rows = edges.withColumn("_t", F.explode(F.sequence(F.floor((F.col("ymin") - EDGE_TOLERANCE) / cell), F.floor((F.col("ymax") + EDGE_TOLERANCE) / cell))))
    met = points.withColumn("_t", F.floor(F.col("y") / cell)).join(rows.select(*parts, "ring", "_t", "x1", "y1", "x2", "y2"), [*parts, "_t"])
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    run, rise = x2 - x1, y2 - y1
    between = lambda v, a, b: (v >= F.least(a, b) - EDGE_TOLERANCE) & (v <= F.greatest(a, b) + EDGE_TOLERANCE)
    touches = (F.abs(run * (y - y1) - rise * (x - x1)) < EDGE_TOLERANCE) & between(x, x1, x2) & between(y, y1, y2)
    right_of = ((y1 <= y) != (y2 <= y)) & (x - x1 <= F.try_divide(run * (y - y1), rise))
    rings = met.groupBy(*point_keys, *parts, "ring").agg((F.bool_or(touches) | (F.count_if(right_of) % 2 == 1)).alias("_in"))
    return rings.groupBy(*point_keys, *parts).agg(
        (F.bool_or((F.col("ring") == 0) & F.col("_in")) & ~F.bool_or((F.col("ring") > 0) & F.col("_in"))).alias("_in"))


def covers_box(polygons: DataFrame, box: tuple[float, float, float, float], keys: Sequence[str], cell: float) -> DataFrame:
    """Whether all four corners of a box lie in each footprint."""
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    number = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("corner")
    points = polygons.limit(1).select(number).select("corner", F.when(F.col("corner") < 2, xmin).otherwise(xmax).alias("x"), F.when(F.col("corner") % 2 == 0, ymin).otherwise(ymax).alias("y"))
    inside = points_in_polygons(points, polygons, ["corner"], keys, cell).where("inside")
    found = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return polygons.select(*keys).join(found, list(keys), "left").select(*keys, (F.coalesce("_n", F.lit(0)) == 4).alias("full_coverage"))


def accepted_scenes(catalogue: DataFrame, levels: Sequence[str], assets: Sequence[str], cloud_limit: float = 80.0) -> DataFrame:
    """Catalogue rows once per epoch and id with the first failing reason (NULL when accepted)."""
    first = F.row_number().over(W.partitionBy("epoch_id", "item_id").orderBy("cloud", "platform"))
    once = catalogue.withColumn("_i", first).where(F.col("_i") == 1).drop("_i")
    needed = F.array(*[F.lit(a) for a in assets])
    reason = (F.when(F.col("cloud").isNull() | (F.col("cloud") > cloud_limit), "cloud_threshold")
              .when(~F.coalesce(F.col("level").isin(*levels), F.lit(False)), "processing_level")
              .when(F.size(F.array_except(needed, F.col("assets"))) > 0, "asset_completeness")
              .when(~F.col("full_coverage"), "full_aoi_coverage"))
    return once.withColumn("rejection", reason)


def weather_cells(responses: DataFrame, order: str) -> DataFrame:
    """Component to weather cell by the returned coordinate at six decimals, numbered by first appearance."""
    keyed = responses.withColumns({"returned_latitude": F.round("latitude", 6), "returned_longitude": F.round("longitude", 6)})
    key = ["returned_latitude", "returned_longitude"]
    first = keyed.groupBy(*key).agg(F.min(order).alias("_first"))
    number = numbered(first, ["_first", *key], "_i").withColumn("_i", F.col("_i") + 1)
    label = F.concat(F.lit("OM_"), F.lpad(F.col("_i").cast("string"), 2, "0"))
    long_label = F.when(F.col("_i") > 99, F.concat(F.lit("OM_"), F.col("_i").cast("string"))).otherwise(label)
    return keyed.join(number.select(*key, long_label.alias("weather_cell_id")), key)


def support_overlap(points: DataFrame, radii: Sequence[int]) -> DataFrame:
    """Lens area and Jaccard share of equal circles around every pair of components.

    Only pairs closer than two radii can overlap, and the rest are zero by definition; a tile of that
    width turns the search into an equi join on neighbouring tiles, so far pairs are never formed.
    """
    located = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("component_id", "x", "y")
    sized = located.withColumn("radius_m", F.explode(F.array(*[F.lit(int(r)) for r in radii])))
    tile = lambda c: F.floor(F.col(c) / (2 * F.col("radius_m")))
    near = F.sequence(F.lit(-1), F.lit(1))
    a = sized.select("radius_m", F.col("component_id").alias("component_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), tile("x").alias("_tx"), tile("y").alias("_ty"))
    b = sized.select("radius_m", F.col("component_id").alias("component_b"), F.col("x").alias("xb"), F.col("y").alias("yb"),
                     around(tile("x"), near).alias("_tx"), tile("y").alias("_y0")).select(
        "radius_m", "component_b", "xb", "yb", "_tx", around(F.col("_y0"), near).alias("_ty"))
    pairs = a.join(b, ["radius_m", "_tx", "_ty"]).where(F.col("component_a") < F.col("component_b"))
    distance = F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")))
    pairs = pairs.withColumn("distance_m", distance).where(F.col("distance_m") < 2 * F.col("radius_m"))
    area, share = circle_overlap(F.col("distance_m"), F.col("radius_m").cast("double"))
    return pairs.select("radius_m", "component_a", "component_b", "distance_m", area.alias("intersection_area_m2"), share.alias("jaccard_overlap"),
                        ((F.col("radius_m") == 500) & (share >= 0.25)).alias("flag_cluster_aware"))


def nearest_on_grid(sources: DataFrame, targets: DataFrame, keys: Sequence[str], scale_row: float = 1.0, scale_col: float = 1.0) -> DataFrame:
    """Exact distance from every source cell to its nearest target cell on an integer grid; NULL without targets.

    Two passes. Along a column the targets divide the grid rows among themselves at their midpoints, which gives each (row, column)
    the distance to its nearest target in that column. Along a row these are parabolas over the columns, and their lower
    envelope is the squared distance. However the targets lie, a cell of the grid moves once per pass, and a task
    holds one column's targets or one row's cells.
    """
    goal = targets.select("row", "col").distinct()
    cells = sources.select("row", "col").distinct()
    extent = cells.agg(F.struct(F.min("row").alias("low"), F.max("row").alias("high")))
    column_ = W.partitionBy("col").orderBy("row")
    middle = lambda a, b: F.floor((a + b) / 2)
    reach = goal.withColumn("_e", extent.scalar()).select("row", "col", *[
        f("_e." + c, F.coalesce(other, F.col("_e." + c))).alias(c) for c, f, other in (
            ("low", F.greatest, middle(F.lag("row").over(column_), F.col("row")) + 1), ("high", F.least, middle(F.col("row"), F.lead("row").over(column_))))])
    up = (F.col("at") - F.col("row")) * F.lit(float(scale_row))
    parabolas = reach.where("low <= high").withColumn("at", F.explode(F.sequence("low", "high"))).select(
        F.col("at").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), (up * up).alias("height"))
    both = parabolas.unionByName(cells.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.lit(None).cast("double").alias("height")))
    away = both.repartition("row").sortWithinPartitions("row", "col").mapInArrow(_row_envelopes(float(scale_col)), "row long, col long, distance double")
    if not keys:
        return away
    return sources.select(*keys, "row", "col").distinct().join(away, ["row", "col"]).select(*keys, "row", "col", "distance")


def _row_envelopes(scale: float):
    """Cells sorted by row to distances, one grid row at a time; cells without height ask, those with one answer."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            rows = batch.column(0).to_numpy()
            if not len(rows):
                continue
            turns = np.append(np.flatnonzero(np.diff(rows)) + 1, len(rows))
            start = 0
            if kept and kept[-1].column(0)[0].as_py() != rows[0]:
                yield _solved(kept, scale)
                kept = []
            for stop in turns:
                kept.append(batch.slice(start, stop - start))
                if stop < len(rows):
                    yield _solved(kept, scale)
                    kept = []
                start = stop
        if kept:
            yield _solved(kept, scale)

    return run


def _solved(parts: list, scale: float) -> pa.RecordBatch:
    row = pa.Table.from_batches(parts).combine_chunks()
    col, height = row.column("col").to_numpy(), row.column("height").to_numpy(zero_copy_only=False)
    asks = np.isnan(height)
    distance = lower_envelope(col[~asks].astype(float), height[~asks], col[asks].astype(float), scale)
    return pa.RecordBatch.from_arrays([pa.array(row.column("row").to_numpy()[asks]), pa.array(col[asks]), pa.array(distance, from_pandas=True)], names=["row", "col", "distance"])


def lower_envelope(at: np.ndarray, height: np.ndarray, x: np.ndarray, scale: float) -> np.ndarray:
    """sqrt of the least height + (scale (x - at))^2 for every x; ``at`` ascends. NaN without parabolas."""
    if not len(at):
        return np.full(len(x), np.nan)
    kept, cuts = [0], [-np.inf]  # parabola kept[i] is lowest from cuts[i] on
    places, heights = at.tolist(), (height / (scale * scale)).tolist()
    for j in range(1, len(places)):
        while True:
            i = kept[-1]
            cut = (places[i] + places[j]) / 2 + (heights[j] - heights[i]) / (2 * (places[j] - places[i]))
            if cut > cuts[-1]:
                break
            kept.pop()
            cuts.pop()
        kept.append(j)
        cuts.append(cut)
    found = np.searchsorted(cuts, x, side="right") - 1
    best = np.full(len(x), np.inf)
    for shift in (-1, 0, 1):  # neighbours too, so rounding of a cut cannot decide
        k = np.asarray(kept)[np.clip(found + shift, 0, len(kept) - 1)]
        best = np.minimum(best, height[k] + np.square(scale * (x - at[k])))
    return np.sqrt(best)
