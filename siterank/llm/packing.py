"""Packing of token sequences into fixed lengths by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest configurations that cover
the histogram. It is solved by multiplicative weights: every length has a price, a knapsack dynamic program finds the
configuration of the greatest worth, and prices fall where it covers. The fractional counts are rounded: configurations are taken
as often as the lengths left allow, and what is left is packed by best fit. Only the histogram, which has no more
entries than a sequence has tokens, is solved on the driver. Documents are numbered within their length by Spark and find
their sequence by this number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from siterank.llm.byte_bpe import encode_texts, worker_state
from siterank.llm.common import Scratch, column, pieces

Plan = list[tuple[tuple[int, ...], int]]


def dearest(prices: np.ndarray, capacity: int, sizes: np.ndarray, limits: np.ndarray) -> Counter:
    """The configuration of the greatest total price: an unbounded knapsack over ``sizes`` (ascending)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(int(sizes[0]), capacity + 1):
        k = int(np.searchsorted(sizes, room, side="right"))
        worth = best[room - sizes[:k]] + prices[:k]
        i = int(worth.argmax())
        if worth[i] > best[room - 1]:
            best[room], choice[room] = worth[i], i + 1
        else:
            best[room] = best[room - 1]
    found: Counter = Counter()
    room = capacity
    while room > 0:
        if not choice[room]:
            room -= 1
            continue
        i = int(choice[room]) - 1
        if found[i] < limits[i]:
            found[i] += 1
        room -= int(sizes[i])
    return found


def configurations(histogram: dict[int, int], capacity: int, rounds: int, step: float) -> list[tuple[Counter, float]]:
    """Fractional numbers of configurations that cover the histogram."""
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[s] for s in sizes.tolist()], float)
    weight = np.log(sizes / capacity / need.sum() + 1e-12)  # prices start in proportion to length
    covered, used = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        price = np.exp(weight - weight.max())
        found = dearest(price, capacity, sizes, need)
        if not found:
            break
        at = np.fromiter(found, np.int64)
        many = np.array([found[i] for i in at.tolist()], float)
        amount = float((need[at] / many).min())  # as often as the scarcest of its lengths allows
        key = tuple(sorted(found.items()))
        used[key] = used.get(key, 0.0) + amount
        gain = amount * many / need[at]
        covered[at] += gain
        weight[at] -= step * gain
    scale = max(covered.mean(), 1e-9)
    return [(Counter({int(sizes[i]): n for i, n in key}), x / scale) for key, x in used.items()]


def best_fit(left: Counter, capacity: int) -> Plan:
    """Best fit of the longest first, by length and count: equal sequences are kept once with their number."""
    rooms: list[int] = []
    open_: dict[int, list[list[int]]] = {}
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            i = bisect_left(rooms, size)
            if i == len(rooms):
                items, room = [], capacity
            else:
                room = rooms[i]
                items = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            items.append(size)
            room -= size
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(items)
    return list(Counter(tuple(items) for many in open_.values() for items in many).items())


def rounded(found: list[tuple[Counter, float]], need: Counter, capacity: int, extra: bool) -> Plan:
    """Whole numbers of configurations, with ``extra`` also one more of each full one that still fits; the rest by best fit."""
    left, plan = Counter(need), []
    fill = lambda c: sum(s * n for s, n in c.items())
    for whole in (True, False)[: 1 + extra]:
        for config, x in sorted(found, key=lambda f: (-fill(f[0]), -f[1])):
            n = min([int(x) if whole else 1, *[left[s] // k for s, k in config.items()]])
            if n > 0 and (whole or fill(config) == capacity):
                plan.append((tuple(sorted(config.elements(), reverse=True)), n))
                left.subtract({s: k * n for s, k in config.items()})
    left = +left
    while left and (share := max(left.values()) // 4096) > 0:  # many of the same lengths: pack one share of them and repeat it
        part = Counter({s: n // share for s, n in left.items() if n >= share})
        plan += [(items, n * share) for items, n in best_fit(part, capacity)]
        left = +(left - Counter({s: n * share for s, n in part.items()}))
    return plan + best_fit(left, capacity)


def plan_sequences(histogram: dict[int, int], capacity: int, rounds: int = 400, step: float = 0.5) -> Plan:
    """(lengths of a sequence, number of such sequences): every length of the histogram exactly once.

    An empty histogram gives an empty plan. Lengths must lie between 1 and the capacity.
    """
    left = Counter({s: n for s, n in histogram.items() if n})
    plan: Plan = []
    if full := left.pop(capacity, 0):
        plan.append(((capacity,), full))
    if left:
        found = configurations(dict(left), capacity, rounds, step)
        tries = [rounded(found, left, capacity, extra) for extra in (False, True)]
        plan += min(tries, key=lambda p: sum(n for _, n in p))
    return plan


PIECE = "id long, piece int, start long, length long, ids_crc32 long, task int, turn long"


def piece_batches(path: str, definition, capacity: int, end: int, special: tuple[str, ...], piece_bytes: int):
    """Pieces of each document with their number among those of the same length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = worker_state(path, definition)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for table in pieces(batches, "text", piece_bytes):
            ids, at = encode_texts(column(table, "text").to_pylist(), tokenizer, cache, special)
            counts = np.diff(at) + 1
            firsts = np.where(counts % capacity, counts % capacity, capacity)
            many = (counts - firsts) // capacity + 1
            doc = np.repeat(np.arange(len(counts)), many)
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            length = np.where(piece == 0, firsts[doc], capacity)
            start = np.where(piece == 0, 0, firsts[doc] + (piece - 1) * capacity)
            blob = np.insert(ids, at[1:], end).astype("<u4")
            base = at[:-1] + np.arange(len(counts))
            crc = [zlib.crc32(blob[i : i + n]) for i, n in zip((base[doc] + start).tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            turn = np.empty(len(order), np.int64)
            group = np.flatnonzero(np.append(True, np.diff(length[order]) > 0)) if len(order) else order
            turn[order] = np.arange(len(order)) - np.repeat(group, np.diff(np.append(group, len(order))))
            turn += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([column(table, "id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                                              pa.array(np.full(len(doc), task, np.int32)), pa.array(turn)], names=["id", "piece", "start", "length", "ids_crc32", "task", "turn"])

    return run


def places(plan: Plan) -> dict[str, np.ndarray]:
    """For each length in turn: from which number on its pieces go into which run of equal sequences, and where in it."""
    rows, used, sequence = [], Counter(), 0
    for items, n in plan:
        offset = 0
        for size, k in sorted(Counter(items).items(), reverse=True):
            rows.append((size, used[size], k, sequence, offset))
            used[size] += k * n
            offset += size * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "low", "each", "sequence", "offset"), table.T))


def place_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        step = int(p["low"].max(initial=0)) + 1
        keys = p["size"].astype(float) * step + p["low"]
        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, size.astype(float) * step + np.minimum(number, step - 1), side="right") - 1
            within = number - p["low"][at]
            out = batch.drop_columns(["number"])
            out = out.append_column("sequence_id", pa.array(p["sequence"][at] + within // p["each"][at]))
            yield out.append_column("offset", pa.array(p["offset"][at] + within % p["each"][at] * size))

    return run


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end: int = 0, rounds: int = 400, piece_bytes: int = 1 << 20) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end``. One longer than the capacity is cut into full pieces behind a first shorter one. Null
    counts as empty text, whose only id is ``end``. Rows that repeat are packed as often as they come; null ids are kept;
    other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    definition = spark.sparkContext.broadcast(tokenizer.to_str())
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = scratch.write(base.mapInArrow(piece_batches(path, definition, capacity, end, special, piece_bytes), PIECE))
    each = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(places(plan_sequences(histogram, capacity, rounds)))
    numbered = found.join(before, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("number"))
    out = numbered.mapInArrow(place_batches(shared), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
