"""How the word use of each source differs from that of the other sources of its language.

Counts of terms are kept as sparse arrays, sorted by term id, of one (language, source, block of ids). A pair task co-groups
the arrays of two sources for one block: the shorter array's ids are found in the longer one by galloping search, which splits both into
terms that the sides share and terms of one side only, and each is priced with the other side's probability of an absent term. Terms absent from
both cost the same each, so they enter once per pair as a product. The language as a whole is a side of its own.

Everything is integer arithmetic. A block holds about ``block_terms`` ids however large the vocabulary is.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.llm.common import Scratch, column

SCALE = 1_000_000_000
EXTRA = 5  # added to every count
STEP = 1 << 20  # bytes of a text cut into terms at a time
HELD = 200_000  # distinct (group, term) entries a task holds before it sends them

#: Terms are runs of letters and bytes above 127; A-Z become a-z and every other byte separates.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch at a time, never cut within a term."""
    plain, start = text.translate(TERM_BYTES), 0
    while start < len(plain):
        stop = plain.find(b" ", start + STEP) if start + STEP < len(plain) else -1
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to counts by (language, source, term), summed within the task as far as HELD entries go."""
    times: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in times.items():
            terms, within = list(found), docs[lang, source]
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array([t.decode(errors="replace") for t in part], pa.string()),
                                                  pa.array([found[t] for t in part], pa.int64()), pa.array([within[t] for t in part], pa.int64())], schema=COUNTS)
        times.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            mine, seen = times[lang, source], set()
            held -= len(mine)
            for terms in _terms(text):
                mine.update(terms)
                seen.update(terms)
            held += len(mine)
            docs[lang, source].update(seen)
            if held > HELD:
                yield from sent()
                held = 0
    yield from sent()


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * kept)) in whole numbers; null without kept terms."""
    over = (F.lit(SCALE).cast("decimal(38,0)") * (count + EXTRA).cast("decimal(20,0)")).cast("decimal(38,0)")
    under = F.nullif(total + EXTRA * kept, F.lit(0)).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, under)


def gallop(needles: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of the ids that both hold."""
    if len(needles) > len(ids):
        there, here = gallop(ids, needles)
        return here, there
    at = np.searchsorted(ids, needles)
    hit = np.flatnonzero(at < len(ids))
    hit = hit[ids[at[hit]] == needles[hit]]
    return hit, at[hit]


def _arrays(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and probabilities of the one row a side has; none where a side holds no term of the block."""
    if not side.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(column(side, c)[0].values.to_numpy().astype(np.int64) for c in ("ids", "ps"))


PRICES = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("whole", pa.bool_()), ("block", pa.int64()), ("excess", pa.int64()), ("ids", pa.list_(pa.int64())), ("fs", pa.list_(pa.int64()))])


def price(top: int):
    """One pair and block: the sum over their terms of |p - q| above |p0 - q0|, and against the language the ``top`` terms with p > q."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ia, pa_), (ib, pb) = _arrays(left), _arrays(right)
        known = left if left.num_rows else right
        a0, b0 = (column(known, c)[0].as_py() for c in ("a0", "b0"))
        both_a, both_b = gallop(ia, ib)
        only_a, only_b = np.ones(len(ia), bool), np.ones(len(ib), bool)
        only_a[both_a] = only_b[both_b] = False
        fall = pa_[both_a] - pb[both_b]
        excess = np.abs(fall).sum() + np.abs(pa_[only_a] - b0).sum() + np.abs(a0 - pb[only_b]).sum() - abs(a0 - b0) * (len(fall) + only_a.sum() + only_b.sum())
        ids, fs = [], []
        if key[3].as_py():
            up = np.flatnonzero(fall > 0)
            up = up[np.lexsort((ia[both_a][up], -fall[up]))][:top]
            ids, fs = ia[both_a][up], fall[up]
        return pa.table([pa.array([k.as_py()], PRICES.field(i).type) for i, k in enumerate(key)] + [pa.array([int(excess)], pa.int64()), pa.array([ids], PRICES.field(6).type), pa.array([fs], PRICES.field(7).type)], schema=PRICES)

    return run


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, block_terms: int = 1 << 15) -> DataFrame:
    """Rows lang, source, part, item, value, rank. ``pair``: the summed difference to every other source of the language;
    ``term``: the up to ``top`` terms that the source has more often than the language, by difference. Ranks start at 1, by value
    descending and then by item.

    Reads text, lang and source; null counts as empty, other columns (ids too) are ignored, equal rows count each. A language keeps
    the terms that at least ``min_docs`` of its documents hold. A source without terms still takes part; a language that keeps no term has pairs
    of value 0, and one with a single source has no pairs. Texts are read whole, a stretch at a time. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text"))
    counts = scratch.write(base.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = scratch.write(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all"))

    # ids: a block by the term's hash, and the place in the block by the term
    sized = kept.join(langs.select("lang", F.ceil(F.col("v") / block_terms).alias("blocks")), "lang")
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).drop("blocks").repartition("lang", "block")  # not by language alone
    terms = scratch.write(blocked.withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")).cast("long")))
    used = scratch.write(counts.drop("docs").join(terms.select("lang", "term", "block", "id"), ["lang", "term"]).drop("term"))

    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = base.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v", "all"), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all")])
    groups = scratch.write(groups.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("v"))))

    side = F.struct(F.lit(False).alias("whole"), "source", "total", "p0")
    lang_side = F.struct(F.lit(True).alias("whole"), F.lit("").alias("source"), F.col("all").alias("total"), probability(F.lit(0), F.col("all"), F.col("v")).alias("p0"))
    others = groups.select("lang", side.alias("right")).unionByName(groups.select("lang", lang_side.alias("right")).distinct())
    pairs = groups.join(others, "lang").filter(F.col("right.whole") | (F.col("source") < F.col("right.source")))
    pairs = scratch.write(pairs.select("lang", F.col("source").alias("a"), F.col("right.source").alias("b"), F.col("right.whole").alias("whole"), "v", F.col("p0").alias("a0"), F.col("right.p0").alias("b0")))

    def arrays(rows: DataFrame, totals: DataFrame, by: list[str], n: str) -> DataFrame:
        found = rows.join(totals, by).withColumn("p", probability(F.col(n), F.col("total"), F.col("v")))
        packed = found.groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("s"))
        return packed.select(*by, "block", F.col("s.id").cast("array<int>").alias("ids"), F.col("s.p").cast("array<int>").alias("ps"))

    of_sources = scratch.write(arrays(used, groups.select("lang", "source", "total", "v"), ["lang", "source"], "n"))
    of_langs = arrays(terms, langs.select("lang", F.col("all").alias("total"), "v"), ["lang"], "all")
    key = ["lang", "a", "b", "whole", "block"]
    columns = [F.col(c).alias(c) for c in (*key, "a0", "b0", "ids", "ps")]  # named anew, as both sides come from the same tables
    left = pairs.join(of_sources.withColumnRenamed("source", "a"), ["lang", "a"]).select(columns)
    right = pairs.filter("not whole").join(of_sources.withColumnRenamed("source", "b"), ["lang", "b"]).select(columns).unionByName(pairs.filter("whole").join(of_langs, "lang").select(columns)).select(columns)
    priced = scratch.write(left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(price(top), "lang string, a string, b string, whole boolean, block long, excess long, ids array<long>, fs array<long>"))

    excess = priced.filter("not whole").groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess"))
    absent = F.coalesce(F.col("v") * F.abs(F.col("a0") - F.col("b0")), F.lit(0))
    values = pairs.filter("not whole").join(excess, ["lang", "a", "b"], "left").select("lang", "a", "b", (absent + F.coalesce("excess", F.lit(0))).cast("long").alias("value"))
    both = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(values.select("lang", "b", "a", "value"))

    best = priced.filter("whole").select("lang", F.col("a").alias("source"), "block", F.explode(F.arrays_zip("ids", "fs")).alias("t")).select("lang", "source", "block", F.col("t.ids").alias("id"), F.col("t.fs").alias("value"))
    named = best.join(terms.select("lang", "block", "id", F.col("term").alias("item")), ["lang", "block", "id"]).select("lang", "source", "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [x.withColumn("part", F.lit(part)).withColumn("rank", rank) for x, part in ((both, "pair"), (named, "term"))]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
