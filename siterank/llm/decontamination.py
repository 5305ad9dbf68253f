"""Benchmark passages inside documents by a prefix-filtered set join.

A benchmark window is the set of its shingles of ``shingle`` words (a shorter item is one shingle). A document that contains a
window contains all its shingles, so of a window's shingles, ordered by how often documents hold them, the first is
a sufficient prefix: only it is joined. Its place in the window bounds where the window can start in the document (positional
bound) and the window must fit (length bound); the words around are then compared one by one.

Documents are read once. A Bloom filter of the benchmark's shingles, of at most ``MOST_BITS`` bits however large the benchmark,
is broadcast; a document leaves its task with the places that pass it and the words around them. What passes by
chance is dropped by the join, so the filter's size changes the work and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siterank.llm.common import NO_ID, Scratch, U, Words, column, mix, pieces, raw, spans, text_bytes

MOST_BITS = 1 << 28
BITS_EACH = 32
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: Bytes of words, A-Z lower-cased; every other byte separates.
WORD_BYTES = np.full(256, 32, np.uint8)
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    WORD_BYTES[_low : _high + 1] = np.arange(_low, _high + 1)
WORD_BYTES[65:91] = np.arange(97, 123)


class Spans(Words):
    """Words of letters, digits and bytes above 127 in a batch of texts."""

    def __init__(self, texts: pa.Array):
        offsets, data = raw(texts)
        self.plain = WORD_BYTES[data]
        super().__init__(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.plain)]))

    def text(self, start: int, stop: int) -> bytes:
        """The words start..stop, one space between two."""
        return b" ".join(self.plain[self.starts[start] : self.ends[stop - 1]].tobytes().split())

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and place in the batch of every ``width`` consecutive words of one text."""
        free = np.maximum(self.counts - width + 1, 0)
        text = np.repeat(np.arange(len(self.counts)), free)
        at = np.arange(free.sum()) - np.repeat(np.cumsum(free) - free, free) + self.at[:-1][text]
        return spans(self.hashes, at, at + width), text, at


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for salt in _SALTS:
        yield mix(hashes ^ U(salt)) & U(bits - 1)


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` that the filter may hold."""
    left = np.arange(len(hashes))
    for salt in _SALTS:
        bit = mix(hashes[left] ^ U(salt)) & U(64 * len(filter_) - 1)
        left = left[(filter_[bit >> U(6)] >> (bit & U(63))) & U(1) == 1]
    return left


WINDOWS = pa.schema([("item", pa.int64()), ("window", pa.string()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])


def item_windows(width: int, shingle: int, piece_bytes: int):
    """Items to windows, each with the hashes of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            words, out = Spans(column(table, "text")), []
            for k, item in enumerate(column(table, "id").to_pylist()):
                n = int(words.counts[k])
                size = min(n, width)
                part = min(size, shingle)
                for i in range(words.at[k], words.at[k] + n - size + 1 if n else words.at[k]):
                    at = np.arange(i, i + size - part + 1)
                    out.append((item, words.text(i, i + size).decode(), size, _span_hashes(words, at, part)))
                if len(out) > 20_000:
                    yield _batch(out, WINDOWS)
                    out = []
            yield _batch(out, WINDOWS)

    return run


def _span_hashes(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    return spans(words.hashes, at, at + width).view(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)


def filter_words(bits: int):
    """Shingle hashes to (word of the filter, bits set in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            bit = np.concatenate(list(probes(hashes, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int64)), pa.array((U(1) << (bit & U(63))).view(np.int64))], names=["word", "bits"])

    return run


CANDIDATE = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.string())])
PLACES = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(CANDIDATE))])


def document_places(filter_, widths: list[int], width: int, piece_bytes: int):
    """Documents to their number of words and the places whose shingle the filter passes, with up to ``width`` words on each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for table in pieces(batches, "text", piece_bytes):
            words = Spans(column(table, "text"))
            found: dict[int, list] = {}
            for part in widths:
                hashes, text, at = words.shingles(part)
                for i in passes(bits, hashes).tolist():
                    k, w = int(text[i]), int(at[i])
                    low, high = max(int(words.at[k]), w - width + part), min(int(words.at[k + 1]), w + width)
                    found.setdefault(k, []).append((int(hashes[i].view(np.int64)), w - int(words.at[k]), w - low, words.text(low, high).decode()))
            names = ("shingle", "at", "left", "around")
            places = [[dict(zip(names, x)) for x in found.get(k, ())] for k in range(table.num_rows)]
            yield pa.RecordBatch.from_arrays([column(table, "id"), column(table, "tag"), pa.array(words.counts, pa.int64()), pa.array(places, pa.list_(CANDIDATE))], schema=PLACES)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text",
                  width: int = 10, shingle: int = 5, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside an occurrence of a window), n_items and items (sorted
    array of the ids, as text, of the items with a window in the document).

    Words are runs of a-z, 0-9 and characters above 127, with A-Z lower-cased. A window is ``width`` consecutive words of an item, or
    the whole item where it is shorter; items without words have none. Null text has no words; texts of any length are read
    whole. Rows that share an item id are one item; an item without id makes words count as hit and is not listed. Rows of
    documents are told apart by id and a 64-bit hash of the text, so null and repeated ids are allowed and equal rows get
    equal results. Other columns are ignored. An empty benchmark hits nothing; an empty table of documents gives none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = items.select(F.col(item_column).cast("long").alias("id"), text_bytes(text_column).alias("text"))
    of_items = scratch.write(texts.mapInArrow(item_windows(width, shingle, piece_bytes), "item long, window string, size int, shingles array<long>"))
    windows = scratch.write(of_items.groupBy("window").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")))
    hashes = scratch.write(windows.select(F.explode("shingles").alias("shingle")).distinct())
    filter_ = spark.sparkContext.broadcast(bloom(hashes))
    widths = sorted({r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().toLocalIterator()})  # at most ``shingle`` values

    base = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("tag"), text_bytes(text_column).alias("text"))
    seen = scratch.write(base.mapInArrow(document_places(filter_, widths, width, piece_bytes), "id long, tag long, n_words long, places array<struct<shingle:long,at:int,left:int,around:string>>"))
    rows = F.coalesce("id", F.lit(NO_ID)).alias("key")
    places = seen.select(rows, "tag", "n_words", F.explode("places").alias("p")).select("key", "tag", "n_words", "p.*")

    # rarity over all documents; a window with a shingle that no document holds cannot occur
    common = places.groupBy("shingle").agg(F.count("*").alias("times"))
    ordered = windows.select("window", "size", F.posexplode("shingles").alias("offset", "shingle")).join(common, "shingle", "left")
    prefix = ordered.groupBy("window", "size").agg(F.min(F.struct("times", "shingle", "offset")).alias("first"), F.bool_and(F.col("times").isNotNull()).alias("possible"))
    prefix = scratch.write(prefix.filter("possible").select("window", "size", "first.shingle", "first.offset"))

    start = F.col("at") - F.col("offset")
    joined = places.join(prefix, "shingle").filter((F.col("left") >= F.col("offset")) & (start + F.col("size") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("left") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    hits = scratch.write(joined.filter(same).select("key", "tag", start.cast("long").alias("start"), (start + F.col("size")).cast("long").alias("stop"), "window").distinct())

    line = W.partitionBy("key", "tag").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    fresh = hits.select("key", "tag", F.greatest("start", F.coalesce(F.max("stop").over(line), F.lit(0))).alias("from"), "stop")
    covered = fresh.groupBy("key", "tag").agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("n_hit"))
    owners = of_items.select("window", F.col("item").cast("string").alias("item")).filter("item IS NOT NULL").distinct()
    listed = hits.select("key", "tag", "window").distinct().join(owners, "window").groupBy("key", "tag").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(listed, ["key", "tag"], "left")
    none = F.array().cast("array<string>")
    out = seen.select("id", rows, "tag", "n_words").join(found, ["key", "tag"], "left")
    return out.select(F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def bloom(hashes: DataFrame) -> np.ndarray:
    """Filter of the hashes as 64-bit words; BITS_EACH bits a hash, rounded up to a power of two, MOST_BITS at most."""
    wanted = max(64, min(MOST_BITS, BITS_EACH * hashes.count()))
    bits = 1 << (wanted - 1).bit_length()
    made = hashes.mapInArrow(filter_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[column(made, "word").to_numpy()] = column(made, "bits").to_numpy().view(np.uint64)
    return out
