"""Removal of passages that earlier documents hold: Rabin-Karp hashes of every window of words, counted in Spark.

A map task hashes all windows of its texts and packs them by hash bucket; within its texts it already settles which windows
an earlier document of the task holds. Settled windows need no comparison and go to the bucket of their document, so a
passage in a third of all documents reaches the bucket of its hash once for each piece of text. A bucket holds about ``per_bucket`` windows
however large the input is. Up to ``fan`` buckets are dealt out at once; beyond that the packs of a bucket are gathered, settled again and dealt
out anew, level by level, so that a pack never shrinks to a few windows. A bucket's task finds, for each hash, the smallest document, and sends the other
positions to the documents' parts, where covered words are taken out and overlapping windows merge into maximal intervals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import NO_ID, U, Words, column, ids, mix, pieces, text_bytes, total_bytes, windows

PACK = "bucket long, hashes binary, docs binary, tags binary, runs binary, starts binary, known binary"
HASH_BYTES = 7
SLOTS = 1_048_573


def _zip(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def digit(values: np.ndarray, level: int, fan: int) -> np.ndarray:
    """Number below ``fan`` that a hash has at a level; the levels' numbers are independent of each other."""
    bits = values if level == 0 else mix(values ^ (U(level) << U(56)))
    return (((bits >> U(40)) * U(fan)) >> U(24)).astype(np.int64)


def repeated(base: DataFrame) -> np.ndarray:
    """Bits by id modulo SLOTS: set for every id of several rows, and for the ids that share its slot."""
    twice = base.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL").select(F.pmod("id", F.lit(SLOTS)).alias("slot")).distinct()
    bits = np.zeros(SLOTS, bool)
    bits[twice.toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)


def tags_of(table: pa.Table, repeats: np.ndarray | None) -> np.ndarray:
    """Tags of the rows whose id is null or may repeat; of others 0, as the id alone names them and a tag would be a third of a pack."""
    tags, docs = column(table, "tag").to_numpy(), ids(table)
    if repeats is None:
        return tags
    at = docs % SLOTS
    return np.where((docs == NO_ID) | (repeats[at >> 3] >> (7 - (at & 7)) & 1 > 0), tags, 0)


def owner(docs: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Hash of the document a window belongs to."""
    return mix(docs.astype(np.uint64) ^ mix(tags.astype(np.uint64)))


def settle(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows a smaller document among these holds too."""
    gone = np.zeros(len(h), bool)
    if len(h):
        order = np.argsort(h)
        first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        mine = docs[order]
        gone[order] = mine > np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(h))))
    return gone


def pack(bucket: np.ndarray, h: np.ndarray, docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with its windows; only those not yet known keep their hashes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    rows = []
    for i, j in zip(edges[:-1], edges[1:]):
        mine = order[i:j]
        d, t, k = docs[mine], tags[mine], known[mine]
        turn = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        rows.append((int(bucket[mine[0]]), h[mine[~k]].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes(), _zip(np.diff(d[turn], prepend=0)), _zip(t[turn]),
                     _zip(np.diff(np.append(turn, len(d))).astype(np.int32)), _zip(np.diff(starts[mine], prepend=0).astype(np.int32)), _zip(np.packbits(k))))
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, [pa.int64(), *[pa.binary()] * 6])], names=["bucket", "hashes", "docs", "tags", "runs", "starts", "known"])


def unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows that are not known, and documents, tags, positions and known flags of all."""
    hashes, docs, tags, starts, known = [], [], [], [], []
    for row in rows:
        runs = _unzip(row["runs"], np.int32)
        docs.append(np.repeat(np.cumsum(_unzip(row["docs"], np.int64)), runs))
        tags.append(np.repeat(_unzip(row["tags"], np.int64), runs))
        starts.append(np.cumsum(_unzip(row["starts"], np.int32)))
        known.append(np.unpackbits(_unzip(row["known"], np.uint8), count=len(docs[-1])).astype(bool))
        wide = np.zeros((len(row["hashes"]) // HASH_BYTES, 8), np.uint8)
        wide[:, :HASH_BYTES] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, HASH_BYTES)
        hashes.append(wide.reshape(-1).view(np.uint64))
    return tuple(np.concatenate(x) for x in (hashes, docs, tags, starts, known))


def window_packs(width: int, fan: int, piece_bytes: int, repeats: np.ndarray | None = None):
    """Texts to packed windows, by the first digit of the hash, or of the document where a smaller one of the piece holds the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            table = table.take(pa.array(np.argsort(ids(table), kind="stable")))
            doc_ids, tags = ids(table), tags_of(table, repeats)
            words = Words(column(table, "text"))
            free = np.maximum(words.counts - width + 1, 0)
            doc = np.repeat(np.arange(len(doc_ids)), free)
            start = np.arange(free.sum()) - np.repeat(np.cumsum(free) - free, free)
            if not len(doc):
                continue
            h = windows(words.hashes, width)[start + words.at[doc]]
            known = settle(h, doc_ids[doc])
            bucket = np.where(known, digit(owner(doc_ids, tags), 0, fan)[doc], digit(h, 0, fan))
            yield pack(bucket, h, doc_ids[doc], tags[doc], start, known)

    return run


def repack(level: int, fan: int, chunk: int):
    """Packs in order of bucket: those of one bucket, up to about ``chunk`` windows at a time, are settled among themselves and dealt out by the next digit."""

    def deal(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        open_h, docs, tags, starts, known = unpack(rows)
        h = np.zeros(len(docs), np.uint64)
        h[~known] = open_h
        known[np.flatnonzero(~known)[settle(open_h, docs[~known])]] = True
        return pack(bucket * fan + digit(np.where(known, owner(docs, tags), h), level, fan), h, docs, tags, starts, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and (size >= chunk or row["bucket"] != held[0]["bucket"]):
                    yield deal(held[0]["bucket"], held)
                    held, size = [], 0
                held.append(row)
                size += int.from_bytes(row["known"][:8], "little") * 8
        if held:
            yield deal(held[0]["bucket"], held)

    return run


ANSWER = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("starts", pa.binary())])


def judge(parts: int):
    """One bucket: the windows that a smaller document holds too, by part of the document."""

    def run(table: pa.Table) -> pa.Table:
        h, docs, tags, starts, gone = unpack(table.to_pylist())
        gone[np.flatnonzero(~gone)[settle(h, docs[~gone])]] = True
        docs, tags, starts = docs[gone], tags[gone], starts[gone]
        part = part_of(docs, tags, parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        cut = [(int(p), order[edges[p] : edges[p + 1]]) for p in np.flatnonzero(np.diff(edges))]
        return pa.table([pa.array([p for p, _ in cut], pa.int32()), pa.array([_zip(docs[i]) for _, i in cut], pa.binary()), pa.array([_zip(tags[i]) for _, i in cut], pa.binary()),
                         pa.array([_zip(starts[i].astype(np.int32)) for _, i in cut], pa.binary())], schema=ANSWER)

    return run


def part_of(docs: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    return (owner(docs, tags) % U(parts)).astype(np.int32)


def add_part(parts: int, repeats: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            tags = tags_of(table, repeats)
            yield batch.set_column(batch.schema.get_field_index("tag"), "tag", pa.array(tags)).append_column("part", pa.array(part_of(ids(table), tags, parts)))

    return run


KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string())])


def take_out(width: int, carry: bool):
    """One part: its documents with the answers of all buckets."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        where: dict[tuple[int, int], list] = {}
        if answers.num_rows:
            docs, tags, starts = (np.concatenate([_unzip(x, kind) for x in column(answers, name).to_pylist()]) for name, kind in (("docs", np.int64), ("tags", np.int64), ("starts", np.int32)))
            order = np.lexsort((starts, tags, docs))
            docs, tags, starts = docs[order], tags[order], starts[order]
            turn = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))
            for i, j in zip(turn, np.append(turn[1:], len(docs))):
                where[docs[i], tags[i]] = starts[i:j]
        out = []
        for id_, key, tag, text in zip(column(texts, "id").to_pylist(), ids(texts).tolist(), column(texts, "tag").to_pylist(), column(texts, "text").to_pylist()):
            words = text.split()
            n, spans_ = len(words), []
            if (found := where.get((key, tag))) is not None:
                heads = np.flatnonzero(np.append(True, np.diff(found) > width))
                spans_ = [(int(found[i]), int(found[j - 1]) + width) for i, j in zip(heads, np.append(heads[1:], len(found)))]
                keep = np.ones(n, bool)
                for i, j in spans_:
                    keep[i:j] = False
                words = list(compress(words, keep))
            out.append((id_, n, n - len(words), [{"start": i, "stop": j} for i, j in spans_], b" ".join(words).decode()))
        made = pa.table([pa.array([x[i] for x in out], KEPT.field(i).type) for i in range(5)], schema=KEPT)
        return made.append_column("row", texts.column("row")) if carry else made

    return run


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 13, carry: tuple[str, ...] = (), per_bucket: int = 1 << 21, part_bytes: int = 8 << 20, piece_bytes: int = 2 << 20, fan: int = 4096) -> DataFrame:
    """One row per input row: id, n_words, n_removed, intervals (maximal removed word ranges), kept_text; with ``carry``
    also ``row``, a struct of the columns named there.

    A window of ``width`` words is removed when its words also start somewhere in a document with a smaller id; windows are
    judged on the input. Null or empty text has no words. A null id counts as larger than all others, and rows that share an
    id never remove words from each other; rows are told apart by id and a 64-bit hash of the text. Other columns are not read; an empty table gives none.
    Windows are equal when 56 bits of their hash and the first level's bucket number, made of the 24 bits above 40, agree. ``fan`` buckets at most are dealt out in
    one level; the result does not depend on the number of levels.
    """
    size = total_bytes(docs, text_column)
    buckets, parts = (max(64, 1 + size // x) for x in (6 * per_bucket, part_bytes))
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("tag"), text_bytes(text_column).alias("text"), *[F.struct(*[docs[c] for c in carry]).alias("row")] * bool(carry))
    levels = max(1, math.ceil(math.log(buckets, fan)))
    split = math.ceil(buckets ** (1 / levels))
    repeats = repeated(base.select("id"))
    packs = base.select("id", "tag", "text").mapInArrow(window_packs(width, split, piece_bytes, repeats), PACK)
    for level in range(1, levels):
        packs = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repack(level, split, per_bucket), PACK)
    row = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    answers = packs.groupBy("bucket").applyInArrow(judge(parts), "part int, docs binary, tags binary, starts binary")
    placed = base.mapInArrow(add_part(parts, repeats), "id long, tag long, text binary" + row + ", part int")
    kept = placed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(take_out(width, bool(carry)), "id long, n_words long, n_removed long, intervals array<struct<start:long,stop:long>>, kept_text string" + row)
    return kept.withColumnRenamed("id", id_column)
