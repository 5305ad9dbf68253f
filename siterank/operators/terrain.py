"""Elevation grids: focal statistics, slope, flow routing, wetness, drainage distance and support summaries.

Grids are (row, col, elev) cells, of which some may be missing. Neighbourhoods are found by position inside tiles that receive the border cells of
their neighbours; flow accumulation is rounds of equi joins with written tables, and distances take two passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siterank.operators.lineage import materialise
from siterank.operators.order import quantiles_wide
from siterank.operators.spatial import nearest_on_grid

# Neighbour order that decides between equal steepest slopes.
DIRECTIONS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


TILE = 128


class Tile:
    """A square of the grid with a rim of its neighbours' cells: elevations by position, NaN where no cell is."""

    def __init__(self, cells: pa.Table, tile_row: int, tile_col: int, side: int, halo: int):
        rows, cols = (cells.column(c).to_numpy() for c in ("row", "col"))
        own = (rows // side == tile_row) & (cols // side == tile_col)
        i, j = rows - tile_row * side + halo, cols - tile_col * side + halo
        self.grid = np.full((side + 2 * halo,) * 2, np.nan)
        self.grid[i, j] = cells.column("elev").cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.cells, self.i, self.j, self.halo = cells.filter(pa.array(own)), i[own], j[own], halo
        edge = cells.column("_extent")[0].as_py()
        at = np.arange(side + 2 * halo)
        self.inside = tuple(np.clip(at, edge[f"{c}_low"] - t * side + halo, edge[f"{c}_high"] - t * side + halo) for c, t in (("row", tile_row), ("col", tile_col)))

    def beside(self, dr: int, dc: int) -> np.ndarray:
        """The neighbour of each own cell in one direction."""
        return self.grid[self.i + dr, self.j + dc]

    def focal_sum(self, values: np.ndarray, size: int) -> np.ndarray:
        """Sum of the square around each own cell, edge cells repeated outside the grid; NaN if a cell in reach is missing."""
        edged = values[np.ix_(np.clip(self.inside[0], 0, len(values) - 1), np.clip(self.inside[1], 0, len(values) - 1))]
        sums = []
        for part in (np.nan_to_num(edged), np.isfinite(edged).astype(float)):
            for axis in (0, 1):
                run = np.cumsum(np.insert(part, 0, 0.0, axis=axis), axis=axis)
                part = np.take(run, range(size, run.shape[axis]), axis=axis) - np.take(run, range(run.shape[axis] - size), axis=axis)
            sums.append(part[self.i - size // 2, self.j - size // 2])
        return np.where(sums[1] == size * size, sums[0], np.nan)


def by_tiles(cells: DataFrame, halo: int, outputs: dict[str, str], compute: Callable[[Tile], dict[str, np.ndarray]], side: int = TILE) -> DataFrame:
    """``cells`` with columns computed from each cell's neighbours by position.

    Tiles receive the border cells of their neighbours, so a cell near a border moves up to four times and no row or column of the grid meets in one task.
    """
    ends = cells.agg(F.struct(*[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))]))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    dealt = cells.withColumn("_extent", ends.scalar()).withColumn("_tr", reach("row")).withColumn("_tc", reach("col"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tile = Tile(rows, key[0].as_py(), key[1].as_py(), side, halo)
        out = tile.cells.drop_columns(["_extent", "_tr", "_tc"])
        if out.num_rows:
            made = compute(tile)
        for name, kind in outputs.items():
            kind_ = pa.float64() if kind == "double" else pa.int64()
            out = out.append_column(name, pa.array(made[name], kind_, from_pandas=True) if out.num_rows else pa.array([], kind_))
        return out

    schema = T.StructType([*cells.schema.fields, *[T.StructField(n, T.DoubleType() if k == "double" else T.LongType()) for n, k in outputs.items()]])
    return dealt.groupBy("_tr", "_tc").applyInArrow(run, schema)


def roughness(cells: DataFrame, tri_size: int = 3, tpi_size: int = 33, side: int = TILE) -> DataFrame:
    """G1: TRI (focal standard deviation) and TPI (elevation less focal mean); NULL where a cell in reach is missing."""
    def compute(tile: Tile) -> dict[str, np.ndarray]:
        n, m = tri_size * tri_size, tpi_size * tpi_size
        mean = tile.focal_sum(tile.grid, tri_size) / n
        spread = tile.focal_sum(tile.grid * tile.grid, tri_size) / n - mean * mean
        return {"tri": np.sqrt(np.maximum(spread, 0.0)), "tpi": tile.beside(0, 0) - tile.focal_sum(tile.grid, tpi_size) / m}

    return by_tiles(cells, max(tri_size, tpi_size) // 2, {"tri": "double", "tpi": "double"}, compute, side)


def slope(cells: DataFrame, cell_y: float, cell_x: float, side: int = TILE) -> DataFrame:
    """Central differences, one-sided at the edges and beside missing cells, in degrees; NULL for a cell alone on an axis."""
    def gradient(back: np.ndarray, here: np.ndarray, ahead: np.ndarray, step: float) -> np.ndarray:
        central = (ahead - back) / (2 * step)
        return np.where(np.isfinite(central), central, np.where(np.isfinite(ahead), (ahead - here) / step, (here - back) / step))

    def compute(tile: Tile) -> dict[str, np.ndarray]:
        here = tile.beside(0, 0)
        down, across = gradient(tile.beside(-1, 0), here, tile.beside(1, 0), cell_y), gradient(tile.beside(0, -1), here, tile.beside(0, 1), cell_x)
        return {"slope_deg": np.degrees(np.arctan(np.hypot(down, across)))}

    return by_tiles(cells, 1, {"slope_deg": "double"}, compute, side)


def d8_receiver(cells: DataFrame, cell_y: float, cell_x: float, side: int = TILE) -> DataFrame:
    """The strictly steepest lower neighbour in single precision; the first direction wins a tie, a missing neighbour receives nothing."""
    def compute(tile: Tile) -> dict[str, np.ndarray]:
        here = tile.beside(0, 0)
        falls = np.stack([((here - tile.beside(dr, dc)) / math.hypot(cell_y * dr, cell_x * dc)).astype(np.float32) for dr, dc in DIRECTIONS])
        falls = np.where(falls > 0, falls, np.float32(0))
        best = falls.argmax(0)
        moves = np.array(DIRECTIONS)[best]
        flat = falls.max(0) <= 0
        rows, cols = (tile.cells.column(c).to_numpy().astype(float) for c in ("row", "col"))
        return {"to_row": np.where(flat, np.nan, rows + moves[:, 0]), "to_col": np.where(flat, np.nan, cols + moves[:, 1])}

    return by_tiles(cells, 1, {"to_row": "bigint", "to_col": "bigint"}, compute, side)


def flow_accumulation(receivers: DataFrame, width: int) -> DataFrame:
    """Cells draining through each cell (itself included), by pointer doubling.

    After k rounds a cell knows everything within 2^k steps upstream, so the number of rounds is the
    logarithm of the longest path. A pointer that outlives log2(cells) rounds lies on a cycle.
    """
    node = F.col("row") * width + F.col("col")
    state = materialise(receivers.select(node.cast("bigint").alias("node"), (F.col("to_row") * width + F.col("to_col")).cast("bigint").alias("to"), F.lit(1).cast("bigint").alias("flow")))
    limit = math.ceil(math.log2(max(2, state.count()))) + 2
    for _ in range(limit):
        moving = state.where(F.col("to").isNotNull())
        if moving.isEmpty():
            break
        inflow = moving.groupBy(F.col("to").alias("node")).agg(F.sum("flow").alias("_in"))
        target = state.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        state = materialise(state.join(inflow, "node", "left").join(target, "to", "left").select(
            "node", F.col("_next").alias("to"), (F.col("flow") + F.coalesce("_in", F.lit(0))).alias("flow")))
    else:
        if not state.where(F.col("to").isNotNull()).isEmpty():
            raise RuntimeError("the receiver graph has a cycle")
    return state.select(F.floor(F.col("node") / width).cast("bigint").alias("row"), (F.col("node") % width).alias("col"), "flow")


def wetness(flow: Column, slope_deg: Column, cell_y: float, cell_x: float) -> Column:
    """ln((A + 1) sqrt(cell area)) - ln(tan(max(slope, 0.05 deg)) + 0.01)."""
    steep = F.radians(F.greatest(slope_deg, F.lit(0.05)))
    return F.log((flow + 1.0) * math.sqrt(cell_x * cell_y)) - F.log(F.tan(steep) + 0.01)


def drainage_distance(flow: DataFrame, cell_y: float, cell_x: float, quantile: float = 0.99, bounded: bool = False) -> DataFrame:
    """Metres from each cell to the nearest cell at or above the flow quantile."""
    limit = quantiles_wide(flow, [], {"flow": "flow"}, {"q": quantile}, bounded=bounded)
    marked = flow.withColumn("_limit", limit.select("flow_q").scalar())
    drains = marked.where(F.col("flow") >= F.col("_limit")).select("row", "col")
    return nearest_on_grid(flow.select("row", "col"), drains, [], cell_y, cell_x)


def terrain_layers(cells: DataFrame, width: int, cell_y: float, cell_x: float, bounded: bool = False, tpi_size: int = 33) -> DataFrame:
    """All terrain layers of a cropped grid in one table."""
    base = materialise(slope(roughness(cells, 3, tpi_size), cell_y, cell_x))
    flow = flow_accumulation(d8_receiver(cells, cell_y, cell_x), width)
    away = drainage_distance(flow, cell_y, cell_x, bounded=bounded).withColumnRenamed("distance", "drainage_distance")
    out = base.join(flow, ["row", "col"]).join(away, ["row", "col"])
    return out.withColumn("wetness", wetness(F.col("flow"), F.col("slope_deg"), cell_y, cell_x))


def support_summary(joined: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Terrain of every point and radius from the cells of its disc."""
    at = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    layers = ["elev", "slope_deg", "tri", "tpi", "flow", "wetness", "drainage_distance"]
    q = quantiles_wide(joined, keys, {c: c for c in layers}, at, bounded=bounded)
    return q.select(
        *keys, F.col("elev_n").alias("terrain_cells"), F.col("elev_median").alias("elevation_median_m"), F.col("elev_p10").alias("elevation_p10_m"),
        F.col("elev_p90").alias("elevation_p90_m"), F.col("slope_deg_median").alias("slope_median_deg"), F.col("slope_deg_p90").alias("slope_p90_deg"),
        F.col("tri_median").alias("tri_median_m"), F.col("tpi_median").alias("tpi500_median_m"), F.col("flow_p90").alias("flow_accumulation_p90_cells"),
        F.col("wetness_p90").alias("twi_proxy_p90"), F.col("drainage_distance_median").alias("drainage_distance_median_m"))
