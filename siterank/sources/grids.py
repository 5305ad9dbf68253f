"""Raw grids as cell tables through the Python data source API.

``spark.dataSource.register(RawGrid)`` then ``spark.read.format("raw_grid")`` with the options path, dtype,
width, height, bands (comma-separated names) and nodata. Files are row-major with interleaved bands. A
partition is a band of rows read by seeking, so a grid of any size is read in parallel; a gzip file cannot
be cut and is one partition. Paths must be reachable by every executor.
"""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION, ROWS_PER_BATCH = 256, 64


class RowBand(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class RawGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_grid"

    def schema(self) -> str:
        names = self.options["bands"].split(",")
        return ", ".join(["row int", "col int", *[f"{n} double" for n in names]])

    def reader(self, schema):
        return RawGridReader(dict(self.options))


class RawGridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], np.dtype(options["dtype"])
        self.width, self.height = int(options["width"]), int(options["height"])
        self.names = options["bands"].split(",")
        self.nodata = float(options.get("nodata", "-9000"))
        self.step = int(options.get("rowsperpartition", options.get("rowsPerPartition", ROWS_PER_PARTITION)))
        self.packed = self.path.endswith(".gz")

    def partitions(self):
        step = self.height if self.packed else self.step
        return [RowBand(r, min(r + step, self.height)) for r in range(0, self.height, step)]

    def read(self, band):
        line = self.width * len(self.names) * self.dtype.itemsize
        with (gzip.open if self.packed else open)(self.path, "rb") as stream:
            stream.seek(band.first * line)
            for first in range(band.first, band.last, ROWS_PER_BATCH):
                count = min(ROWS_PER_BATCH, band.last - first)
                yield self._batch(stream.read(count * line), first, count)

    def _batch(self, data: bytes, first: int, count: int) -> pa.RecordBatch:
        values = np.frombuffer(data, dtype=self.dtype).astype("float64").reshape(count * self.width, len(self.names))
        columns = [pa.array(np.repeat(np.arange(first, first + count, dtype="int32"), self.width)), pa.array(np.tile(np.arange(self.width, dtype="int32"), count))]
        for i in range(len(self.names)):
            v = values[:, i]
            columns.append(pa.array(v, mask=~(v > self.nodata)))
        return pa.RecordBatch.from_arrays(columns, names=["row", "col", *self.names])


def read_grid(spark: SparkSession, path: str, dtype: str, width: int, height: int, bands: list[str], nodata: float = -9000.0,
              rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    spark.dataSource.register(RawGrid)
    return (spark.read.format("raw_grid").option("path", path).option("dtype", dtype).option("width", width).option("height", height)
            .option("bands", ",".join(bands)).option("nodata", nodata).option("rowsPerPartition", rows_per_partition).load())


def read_elevation(spark: SparkSession, path: str, north: float, west: float, side: int = 3601) -> DataFrame:
    """A (gzip) big-endian elevation tile with void as NULL and the longitude and latitude of every cell."""
    cells = read_grid(spark, path, ">i2", side, side, ["elev"], -32768.0)
    return cells.withColumns({"latitude": F.lit(north) - F.col("row") / F.lit(float(side - 1)), "longitude": F.lit(west) + F.col("col") / F.lit(float(side - 1))})
