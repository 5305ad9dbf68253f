"""What the operators of this package share: projections, written tables, and hashes of words in Arrow batches.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Their hashes are
polynomials over 64-bit values of bytes, taken from running sums of a whole batch, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siterank.operators.lineage import shared_folder

NO_ID = np.iinfo(np.int64).max
U = np.uint64
_rng = np.random.default_rng(20250211)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept by the worker process."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of where the span lies."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, up, out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + U(0x2545F4914F6CDD1D) * (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive word hashes."""
    n = max(0, len(words) - width + 1)
    at = np.arange(n)
    return spans(words, at, at + width)


class Words:
    """Words of a batch of texts: byte spans, hashes, and for each text the range of its words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets, self.data = raw(texts)
        n = len(self.data)
        solid = ~IS_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.hashes = spans((LOWER_VALUES if lower else BYTE_VALUES)[self.data], self.starts, self.ends)
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a binary or string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    if len(texts) == 0 or where is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], bytes_[offsets[0] : offsets[-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Batches gathered, or cut between rows, to about ``size`` bytes of text; one row is never cut."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        offsets, _ = raw(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size - total, side="right")) - 1
            stop = min(batch.num_rows, max(stop, start + (not held)))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                total += int(offsets[stop] - offsets[start])
                start = stop
            if start < batch.num_rows or total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)
        held = []
    trim()


def trim() -> None:
    """Hands freed memory back to the system: worker processes outlive their tasks, and those of one stage stand beside the next one's."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def ids(table: pa.Table, name: str = "id") -> np.ndarray:
    """Ids as int64; a null id counts as larger than every other."""
    return column(table, name).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def text_bytes(text: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """64-bit hash of id and text: names a row also where ids are null or repeat."""
    return F.xxhash64(F.col(id_column).cast("long"), text_bytes(text_column))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from which numbers of buckets are derived."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def crc_mod(name: str, base: int) -> Column:
    """crc32 of the id as text, modulo base; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(base))


#: Files of an execution's exchanges go when it ends; else they stay until the driver happens to collect its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables below spark.checkpoint.dir that cut lineage; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        before = self.spark.conf.get(FILE_CLEANUP, None)
        self.spark.conf.set(FILE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(FILE_CLEANUP) if before is None else self.spark.conf.set(FILE_CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        found.scratch_path = path
        return found

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if path := getattr(df, "scratch_path", None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
