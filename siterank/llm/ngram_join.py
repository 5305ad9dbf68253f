"""Jaccard self-join of word n-gram sets by parity sketches.

The sketch of a set has one bit for every 64-bit shingle hash: the parity of the shingles that fall there. Two sketches
differ in at most as many bits as the sets have shingles apart, and a set pair of similarity t or more, with the smaller set
of size a, is at most a * (1 - t) / t apart. The sketch is cut into more bands than that, so linked sets agree in at least
one band; a band is named by the XOR of the mixed hashes of its set bits. Bands without a shingle agree by chance, so
``spare`` bands are added: a set with at most ``spare`` empty bands leaves them out, and a set with more sends its bands
again under another hash, so that two such sets meet there (the last hash keeps its empty bands). No link is lost.

Equal sets are one class from the start. The classes of a band are first tested against its hub, the class whose bands are
the most shared, which is the original of a group of near copies; linked classes merge. Only bands that still hold several
components go on: small ones as pairs across components, larger ones in blocks whose sketches are compared in arrays. Pairs
within one component are never formed, and of the others only those whose sketches are near enough leave a block.

The bands are several times the text, so they are made and sent once. Whole sets are spelled only for classes of pairs whose bit
sketches, of a fixed length, do not rule out a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siterank.llm.common import Scratch, U, Words, column, mix, pieces, row_key, text_bytes, windows
from siterank.llm.components import components

SEEDS = 8
STEP = 1.5
SKETCH_BITS = 1024


def shingle_sets(table: pa.Table, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text in ascending order; a text shorter than a shingle has one, without words none."""
    words = Words(column(table, "text"), lower=True)
    whole = windows(words.hashes, width)
    for start, n in zip(words.at[:-1].tolist(), words.counts.tolist()):
        if n >= width:
            found = np.sort(whole[start : start + n - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif n:
            yield windows(words.hashes[start : start + n], n)
        else:
            yield np.zeros(0, np.uint64)


def class_of(found: np.ndarray) -> np.int64:
    """Name of a set: two sums over its hashes, mixed to 64 bits."""
    if not len(found):
        return np.int64(0)
    both = np.array([mix(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found ^ U(0xA5A5A5A5A5A5A5A5)))], np.uint64)
    return mix(both[:1] * U(3) + mix(both[1:] + U(len(found))))[0].astype(np.int64)


def size_bands(n: int, threshold: float) -> list[tuple[int, int]]:
    """(band, bands of the sketch) in which a set of n shingles takes part: its own size band, and the one below if it may
    be the larger partner of a set there. Band k holds sizes of floor(STEP**k) or more and less than those of k + 1."""
    k = 0
    while int(STEP ** (k + 1)) <= n:
        k += 1
    out = []
    for band in (k, k - 1):
        top = int(STEP ** (band + 1)) - 1  # largest smaller partner
        if band >= 0 and top >= int(STEP**band) and n * threshold <= top + 1e-9 * n:
            apart = int(top * (1 - threshold) / threshold + 1e-9)
            out.append((band, apart + 1 + spare(apart)))
    return out


def spare(apart: int) -> int:
    return 1 + apart // 12


def band_keys(found: np.ndarray, threshold: float) -> np.ndarray:
    keys = []
    for band, bands in size_bands(len(found), threshold):
        for seed in range(SEEDS):
            h = mix(found + U((0x51ED2701 * (seed + 1)) << 7))
            place = ((h >> U(32)) * U(bands) >> U(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            turn = np.flatnonzero(np.append(True, np.diff(place[order]) > 0))
            names, full = np.bitwise_xor.reduceat(mix(h)[order], turn), place[order][turn]
            if seed == SEEDS - 1 and len(full) < bands - spare_of(bands):
                empty = np.setdiff1d(np.arange(bands), full)
                names, full = np.append(names, np.zeros(len(empty), np.uint64)), np.append(full, empty)
            keys.append(mix(names ^ mix(full.astype(np.uint64) + U((band * SEEDS + seed) << 40))))
            if bands - len(full) <= spare_of(bands):
                break
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def spare_of(bands: int) -> int:
    """The spare bands among ``bands``: inverts apart + 1 + spare(apart)."""
    apart = bands - 2
    while apart + 1 + spare(apart) > bands:
        apart -= 1
    return spare(apart)


def bit_sketch(found: np.ndarray) -> bytes:
    """Parity sketch of fixed length, for a first test of a pair."""
    return np.packbits((np.bincount((mix(found) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def name_sets(width: int, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            sets = [(len(s), class_of(s), bit_sketch(s)) for s in shingle_sets(table, width)]
            n, classes, sketches = (pa.array([x[i] for x in sets], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))
            yield pa.RecordBatch.from_arrays([column(table, "id"), column(table, "row"), n, classes, sketches], names=["id", "row", "n", "class", "sketch"])

    return run


def sketch_bands(width: int, threshold: float, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            named: dict[int, np.ndarray] = {}
            for found in shingle_sets(table, width):
                if len(found) and (c := int(class_of(found))) not in named:
                    named[c] = band_keys(found, threshold)
            if named:
                keys = np.concatenate(list(named.values())).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(np.array(list(named), np.int64), [len(k) for k in named.values()]))], names=["key", "class"])

    return run


def spell_sets(width: int, piece_bytes: int):
    """Whole sets of candidate classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            spelled = pa.array([s.astype(np.int64) for s in shingle_sets(table, width)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(table, "class"), spelled], names=["class", "shingles"])

    return run


def near_blocks(percent: int):
    """One block of a band: pairs across components whose sizes and sketches do not rule out a link."""

    def run(table: pa.Table) -> pa.Table:
        side, names, labels, sizes = (column(table, c).to_numpy(zero_copy_only=False) for c in ("side", "class", "label", "size"))
        sketches = np.frombuffer(b"".join(column(table, "sketch").to_pylist()), np.uint64).reshape(len(names), -1)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        us, vs = [], []
        for i in left:
            apart = np.bitwise_count(sketches[right] ^ sketches[i]).sum(1, dtype=np.int64)
            small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
            ok = (labels[right] != labels[i]) & (small * 100 >= large * percent) & (apart * (100 + percent) <= (small + large) * (100 - percent))
            found = names[right[ok]]
            us.append(np.minimum(found, names[i]))
            vs.append(np.maximum(found, names[i]))
        return pa.table({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

    return run


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose sizes and sketches do not rule out a link."""
    left = sets.select(F.col("class").alias("u"), F.col("size").alias("a"), F.col("sketch").alias("p"))
    right = sets.select(F.col("class").alias("v"), F.col("size").alias("b"), F.col("sketch").alias("q"))
    small, large = F.least("a", "b"), F.greatest("a", "b")
    word = lambda s, k: F.conv(F.hex(F.substring(s, k, 7)), 16, 10).cast("long")
    apart = reduce(lambda x, y: x + y, [F.bit_count(word("p", k).bitwiseXOR(word("q", k))) for k in range(1, SKETCH_BITS // 8 + 1, 7)])
    ok: Column = (small * 100 >= large * percent) & (apart * (100 + percent) <= (small + large) * (100 - percent))
    return pairs.join(right, "v").join(left, "u").filter(ok).select("u", "v")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(right, "v").join(left, "u").withColumn("shared", shared).filter(F.col("shared") * 100 >= (F.size("a") + F.size("b") - F.col("shared")) * percent).select("u", "v")


def shared_bands(bands: DataFrame) -> DataFrame:
    """Distinct (key, class) of the keys that two classes or more have, by one exchange of the bands."""
    of = Window.partitionBy("key")
    return bands.select("key", "class", F.min("class").over(of).alias("lo"), F.max("class").over(of).alias("hi")).filter("lo <> hi").select("key", "class").distinct()


def band_hubs(groups: DataFrame) -> DataFrame:
    """Per key its number of classes and its hub: the class whose keys are the most shared, the smaller name on ties."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"))
    weights = groups.join(sizes, "key").groupBy("class").agg(F.sum("n").alias("weight"))
    return groups.join(weights, "class").groupBy("key").agg(F.count("*").alias("n"), F.max_by("class", F.struct("weight", -F.col("class"))).alias("hub"))


def open_pairs(rows: DataFrame, sets: DataFrame, percent: int, few: int, block: int) -> DataFrame:
    """Pairs across the components of each key: all of them in keys of ``few`` classes, near ones of blocks in larger keys.

    A pair has at least one end outside the hub's component, so such rows meet all rows, block by block.
    """
    small = rows.filter(F.col("n") <= few)
    other = small.select("key", F.col("class").alias("v"), F.col("label").alias("other"))
    inside = small.select("key", F.col("class").alias("u"), "label").join(other, "key").filter("u < v and label <> other").select("u", "v").distinct()
    large = rows.filter(F.col("n") > few).join(sets.select("class", "size", "sketch"), "class")
    blocks = F.ceil(F.col("n") / block).cast("int")
    at = F.pmod(F.xxhash64("class"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(at.alias("i"), k.alias("j")))
    turned = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(k.alias("i"), at.alias("j")))
    keep = ["key", "class", "label", "size", "sketch"]
    lefts = large.filter("label <> hub_label").select(*keep, F.lit(True).alias("side"), F.explode(cells).alias("cell"))
    rights = large.select(*keep, F.lit(False).alias("side"), F.explode(turned).alias("cell"))
    met = lefts.unionAll(rights).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")}).drop("cell")
    return inside.unionAll(met.groupBy("key", "i", "j").applyInArrow(near_blocks(percent), "u long, v long").distinct())


def linked_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 85, few: int = 32, block: int = 512, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, row (hash of id and text), n (shingles), class (name of its set), node (name of its component; means
    nothing where n is 0).

    The text of a class is fetched by the row hash of one of its rows, so ids may be null or repeat.
    """
    scratch, threshold = Scratch(docs.sparkSession), percent / 100
    base = docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column, text_column).alias("row"), text_bytes(text_column).alias("text"))
    members = scratch.write(base.mapInArrow(name_sets(width, piece_bytes), "id long, row long, n long, class long, sketch binary"))
    bands = base.select("text").mapInArrow(sketch_bands(width, threshold, piece_bytes), "key long, class long")
    groups = scratch.write(shared_bands(bands))
    named = members.groupBy("class").agg(F.min("row").alias("row"), F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    sets = scratch.write(named.join(groups.select("class").distinct(), "class", "left_semi"))

    def links(pairs: DataFrame) -> DataFrame:
        close = scratch.write(near(pairs, sets, percent))
        ends = close.select(F.col("u").alias("class")).unionAll(close.select("v")).distinct()
        firsts = sets.select("class", "row").join(ends, "class", "left_semi")
        texts = base.select("row", "text").join(firsts, "row").dropDuplicates(["row", "class"])
        spelled = scratch.write(texts.select("class", "text").mapInArrow(spell_sets(width, piece_bytes), "class long, shingles array<long>"))
        found = scratch.write(linked(close, spelled, percent))
        scratch.drop(close, spelled)
        return found

    hubs = scratch.write(band_hubs(groups))
    stars = scratch.write(groups.join(hubs, "key").filter("class <> hub").select(F.least("class", "hub").alias("u"), F.greatest("class", "hub").alias("v")).distinct())
    edges = links(stars)
    labels = scratch.write(components(edges, scratch))
    name = labels.withColumnRenamed("node", "class")
    labelled = groups.join(name, "class", "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    center = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key").join(hubs, "key")
    open_ = open_.join(center, "hub", "left").select("key", "n", F.coalesce("hub_label", "hub").alias("hub_label"))
    rows = scratch.write(labelled.join(open_, "key"))
    rest = open_pairs(rows, sets, percent, few, block).join(stars, ["u", "v"], "left_anti").distinct()
    more = links(rest)
    labels = scratch.write(components(edges.unionAll(more), scratch)).withColumnRenamed("node", "class")
    scratch.drop(groups, sets, hubs, stars, rows)
    return members.join(labels, "class", "left").select("id", "row", "n", "class", F.coalesce("label", "class").alias("node"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 85, few: int = 32, block: int = 512, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), class (name of its set).

    Words are lower-cased by A-Z. Null or empty text has an empty set, is linked with nothing and keeps its own id. Rows that
    share an id are linked through it only if their sets are. A null id loses every comparison; a component of null ids
    has a null component_id. Columns other than the two named are not read; an empty table gives none. Classes are named by 64-bit
    hashes.
    """
    joined = linked_rows(docs, id_column, text_column, width, percent, few, block, piece_bytes)
    firsts = joined.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    out = joined.filter("n > 0").join(firsts, "node").select("id", "n", "class", "first").unionAll(joined.filter("n = 0").select("id", "n", "class", F.col("id").alias("first")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), "class")
