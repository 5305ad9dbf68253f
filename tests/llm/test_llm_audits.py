"""Source divergence, benchmark decontamination and the Merkle manifest against brute force on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siterank.llm.common import crc_mod
from siterank.llm.decontamination import bloom, decontaminate
from siterank.llm.merkle_manifest import merkle_manifest, positions
from siterank.llm.common import Scratch
from siterank.llm.source_divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key int, n long, pos string, tag string, row int, id int, item string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def frame(spark, rows, parts=5):
    """Rows of (doc_id, text, lang, source, n_chars) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4, "z") for r in rows], SCHEMA).repartition(parts)


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, a source with a third of all rows."""
    words = "alpha Beta GAMMA delta épsilon zeta eta theta 12 iota-kappa lambda ΜΥ".split()
    rows = [(i, " ".join(words[(i * k) % 12] for k in range(1, 4 + i % 19)), ("en", "de", None, "")[i % 4], ("hot", f"s{i % 7}", "hot")[i % 3], i) for i in range(150)]
    rows += [(None, "ALPHA beta", "en", None, None), (None, "Alpha BETA", "en", None, None), (7, None, None, None, 3), (8, "", "xx", "hot", 0), (9, "\t ,\n", "en", "bare", 1), (3, "Twice A", "en", "hot", 1), (3, "Twice A", "en", "hot", 1)]
    return rows + [(900, "Word " * 40_000 + "alpha", "en", "long", None), (901, "A" * 3_000_000, "yy", "long", None)]


def brute_divergence(rows, least, top):
    rows = [(t or "", l or "", s or "") for _, t, l, s, _ in rows]
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
    held, times, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, l, s in rows:
        held[l].update(set(cut(t)))
        times[l, s].update(cut(t))
        sources[l].add(s)
    out = []
    for l, of in sources.items():
        kept = {t for t, n in held[l].items() if n >= least}
        n = {s: sum(times[l, s][t] for t in kept) for s in of}
        p = {s: {t: 1 + 10**9 * (times[l, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in of}
        q = {t: 1 + 10**9 * (sum(times[l, s][t] for s in of) + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in of:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in of if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if times[l, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(l, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


@pytest.mark.parametrize("least,top,block", [(30, 50, 1 << 15), (2, 3, 4), (10**6, 50, 8)])
def test_divergence_equals_brute_force(spark, least, top, block):
    got = source_divergence(frame(spark, awkward()), min_docs=least, top=top, block_terms=block)
    assert sorted(map(tuple, got.collect())) == brute_divergence(awkward(), least, top)


def test_divergence_of_no_rows(spark):
    assert source_divergence(frame(spark, [])).collect() == []


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "One, two. THREE four five six seven eight nine ten"), (2, "zulu yankee xray"), (3, "solo"), (4, None), (5, "!?"),
         (None, "no owner here"), (6, "rare one two three four five six seven eight nine"), (7, "solo"), (10, "a a a a a a a a a a a a a"), (8, "über straße")]


def brute_hits(docs, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        ws = cut(text)
        for i in range(len(ws) - min(len(ws), width) + 1 if ws else 0):
            windows[tuple(ws[i : i + width])].add(item)
    out = []
    for id_, text in docs:
        ws, hit, found = cut(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                if (w := tuple(ws[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[w]
        out.append((id_, len(ws), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def contaminated_docs():
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, ten), (2, f"x {ten.upper()}, eleven"), (3, "one two three four five six seven eight nine"), (4, f"{ten} {ten} eleven twelve"), (5, "solo... SOLO"), (6, None), (7, ""), (8, "a " * 5_000), (None, "zulu-yankee-xray"),
            (None, "zulu yankee"), (9, "no owner here"), (9, "no owner"), (9, "no owner here"), (10, "ÜBER straße über Straße"), (11, ten + " " * 100_000 + "eleven twelve"), (12, "z" * 2_000_000 + " solo"), (13, f"rare {ten}")]
    return docs + [(100 + i, f"{i} {ten} tail") for i in range(300)]  # a third and more share one passage


@pytest.mark.parametrize("width,shingle", [(10, 5), (10, 1), (4, 4), (3, 5)])
def test_decontamination_equals_brute_force(spark, width, shingle):
    docs, items = contaminated_docs(), ITEMS
    df = frame(spark, [(i, t, None, None, None) for i, t in docs])
    table = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, size int, window string")
    got = decontaminate(df, table, width=width, shingle=shingle)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "items").collect()), key=repr) == brute_hits(docs, items, width)
    assert got.filter("n_items <> size(items)").isEmpty()


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate(frame(spark, [(1, "some words", None, None, None)]), none).collect()] == [(1, 2, 0, 0, [])]
    assert decontaminate(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_filter_holds_all_and_stays_bounded(spark, monkeypatch):
    import numpy as np

    from siterank.llm import decontamination

    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 10)
    made = bloom(spark.range(5_000).selectExpr("xxhash64(id)"))
    hashes = np.array([r[0] for r in spark.range(5_000).selectExpr("xxhash64(id)").collect()], np.int64).view(np.uint64)
    assert len(made) == 16 and len(decontamination.passes(made, hashes)) == 5_000


def brute_manifest(rows):
    digest = lambda *a: hashlib.sha256("".join(a).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(part(r[0]), part(r[3]), part(r[2]), part(r[4]), part(text))

    def levels(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for rs in langs.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {x: levels([leaf(r, r[1]) for r in rs]) for x, rs in langs.items()}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for x in order:
        for place, r in enumerate(langs[x]):
            first = leaf(r, r[1])
            folded = leaf(r, r[1].translate(LOWER)) if r[1] is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 else first
            proof = []
            for tree, at in ((trees[x], place), (top, order.index(x))):
                for level in tree[:-1]:
                    run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += run[:slot] + run[slot + 1 :]
                    folded = digest(*run[:slot], folded, *run[slot + 1 :])
                    at //= 8
            out.append((r[0], first, trees[x][-1][0], top[-1][0], digest(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows_in_many_languages():
    return [(i, f"T {i}", f"l{i:03d}", None, 1) for i in range(70)] + [(1000 + i, f"Deep {i}", "deep", "s", i) for i in range(513)]


@pytest.mark.parametrize("rows", [awkward, rows_in_many_languages, lambda: [(1, "Only", "en", "s", 1)], lambda: [(i, "E", None, None, None) for i in range(9)]])
def test_manifest_equals_brute_force(spark, rows):
    got = merkle_manifest(frame(spark, rows()), crc_mod("doc_id", 3) == 0).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows())


def test_manifest_of_no_rows(spark):
    assert merkle_manifest(frame(spark, []), F.lit(True)).collect() == []


def test_positions_of_equal_rows(spark):
    rows = spark.range(1000).select(F.lit("g").alias("tree"), F.lit(None).cast("long").alias("k"))
    got = positions(rows, ["tree"], ["k"], Scratch(spark))
    assert sorted(r.pos for r in got.collect()) == list(range(1000))
