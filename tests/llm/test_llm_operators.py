"""Operators of siterank.llm against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import html as entities
import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizer_files = pytest.importorskip("public_tokenizers")

from siterank.llm import byte_bpe, exact_dedup, fingerprints, html_text, language_id, language_model, ngram_join, packing, substring_dedup, token_counts  # noqa: E402
from siterank.llm.common import crc_mod  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0D]+")
A_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
PASSAGE = " ".join(f"shared{i}" for i in range(40))
BASE = [f"word{i % 97}x{i}" for i in range(300)]
LONG = " ".join(f"tok{i % 1000} é{i % 7}" for i in range(30_000))


def edited(step: int, seed: int) -> str:
    return " ".join(w if i % step else f"new{seed}_{i}" for i, w in enumerate(BASE))


TEXTS = [
    None, "", "  \t ", "Hello world", "hello WORLD", "Hello  world", "Hello\tworld", "a b c", "a b c d", "A B C D", "it's 12 o'clock, we'll see — “ok”", "中文 and Ωmega 😀 é", "<|endoftext|> x <|startoftext|>",
    PASSAGE, f"start {PASSAGE} end", f"{PASSAGE} {PASSAGE}", "same " * 50, "same " * 60, LONG, LONG, LONG + " tail", " ".join(BASE), *[edited(60, k) for k in range(12)], *[edited(23, k) for k in range(6)],
    "line one.\nline two.\nline three.", "line two.\nline one.\nline three.", "Der schnelle Fuchs", "x", "1234 !!", "x" * 5000]
KEEP = "id long, n string, class string, row string, text_ string, text string, doc_id long, size string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % len(TEXTS), t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(7, "n", "c", "r", "t", t, i, "s", "l") for i, t in rows], KEEP).repartition(3)
    return frame.cache()


@pytest.fixture(scope="module")
def texts():
    return {i * 3 % len(TEXTS): t for i, t in enumerate(TEXTS)}


def rows(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def words(t):
    return WORD.findall(t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_ids_are_distinct(texts):
    assert len(texts) == len(TEXTS)


def test_exact_dedup(docs, texts):
    normal = {i: re.sub("[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    groups = collections.defaultdict(list)
    for i, t in normal.items():
        groups[t].append(i)
    expected = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in normal.items()}
    for first, growth in ((128, 8), (1, 2)):
        assert rows(exact_dedup.exact_dedup(docs, first_run=first, growth=growth), "doc_id", "keep_id", "group_size", "kept", "sha256") == expected


def test_exact_dedup_repeats_and_nulls(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a  b"), (None, "a b"), (3, "z"), (3, "y"), (None, "q"), (None, "p")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame).collect()}
    assert got == {(1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 1, True), (None, None, 1, True)}
    assert exact_dedup.exact_dedup(frame).count() == frame.count()


def test_exact_dedup_of_repeated_rows_and_hot_groups(spark, monkeypatch):
    """Every input row has its row, as in the query's SQL; groups dealt over several keys give the same."""
    from siterank.llm.queries import ORACLES
    import duckdb

    texts = [(i % 40 if i % 3 else None, "hot text " * 40 + str(i % 2)) for i in range(300)] + [(1, "a b"), (1, "a b"), (None, "q"), (None, "q"), (2, "a\tb")]
    documents = spark.createDataFrame(texts, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    expected = collections.Counter((i, k, n, h) for i, k, n, h in duckdb.sql(f"SELECT doc_id, keep_id, group_size, text_sha256 FROM ({ORACLES['op2_exact_dedup']})").fetchall())
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for hot in (1000, 4):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        got = exact_dedup.exact_dedup(frame).select("doc_id", "keep_id", "group_size", "sha256").collect()
        assert collections.Counter(tuple(r) for r in got) == expected


def brute_substrings(texts, width=13):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = set()
    for i, t in texts.items():
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        left = [x for x, y in zip(w, keep) if y]
        out.add((i, len(w), len(w) - len(left), " ".join(left)))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 200])
def test_substring_dedup(docs, texts, piece):
    found = substring_dedup.substring_dedup(docs, carry=("text_", "row"), piece_bytes=piece)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(texts)
    assert {r.row.row for r in found.select("row").collect()} == {"r"}
    for r in found.select("n_removed", "intervals").collect():
        assert sum(s.stop - s.start for s in r.intervals) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.intervals, r.intervals[1:]))


@pytest.mark.parametrize("fan,chunk", [(16, 1 << 21), (64, 500)])
def test_substring_dedup_in_levels(docs, texts, fan, chunk):
    """Small buckets and a small fan: several levels of dealing give the same rows."""
    found = substring_dedup.substring_dedup(docs, per_bucket=min(chunk, 300), fan=fan, piece_bytes=50_000)
    assert found._jdf.queryExecution().toString().count("MapInArrow") > 2
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(texts)


def test_packs_stay_small_at_every_size():
    """Bytes sent for a byte of text at each level, as the buckets of a 100 TB input would need it, and with one level of 64."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = [" ".join(rng.integers(0, 10**6, 300).astype(str)).encode() for _ in range(1000)]
    table = pa.record_batch({"id": np.arange(1000), "tag": rng.integers(0, 2**62, 1000), "text": pa.array(text, pa.binary())})
    sent = lambda batches: sum(b.nbytes for b in batches) / sum(map(len, text))
    one = list(substring_dedup.window_packs(13, 64, 2 << 20)([table]))
    fan = math.ceil((8 << 20) ** 0.5)
    first = list(substring_dedup.window_packs(13, fan, 2 << 20)([table]))
    # a bucket of the first level gathers windows of many texts, each of which has one or two there
    many = [f"d{i} {' '.join(rng.integers(0, 10**6, 13).astype(str))}".encode() for i in range(20_000)]
    spread = pa.record_batch({"id": np.arange(20_000), "tag": rng.integers(0, 2**62, 20_000), "text": pa.array(many, pa.binary())})
    gathered = list(substring_dedup.window_packs(13, 1, 2 << 20)([spread]))
    again = list(substring_dedup.repack(1, 32, 1 << 21)(gathered))
    per_window = sum(b.nbytes for b in again) / (2 * 20_000)
    assert sent(one) < 2.5 and sent(first) < 2 * sent(one) and per_window < 24, (sent(one), sent(first), per_window)


@pytest.mark.parametrize("key", [None, 5])
def test_substring_dedup_rows_without_a_key(spark, key):
    """Rows under a null or one repeated id keep what no smaller id holds, whichever texts they have beside them."""
    source = [f"{PASSAGE} {k}" for k in range(2)]
    texts = [f"own{i} {PASSAGE} tail{i}" if i % 2 else " ".join(f"w{i}x{k}" for k in range(60)) for i in range(1500)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(source)] + [(key, t) for t in texts], "doc_id long, text string").repartition(3)
    found = substring_dedup.substring_dedup(frame).filter(F.col("doc_id").eqNullSafe(F.lit(key)))
    assert sorted(r.kept_text for r in found.collect()) == sorted(f"own{i} tail{i}" if i % 2 else t for i, t in enumerate(texts))


def brute_components(texts):
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := words((t or "").translate(A_Z))) else set() for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and label[i] < label[j] and 100 * len(a & b) >= 85 * len(a | b):
                    label[j] = label[i]
                    changed = True
    return {(i, len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("few,block", [(32, 512), (2, 4)])
def test_ngram_join(docs, texts, few, block):
    assert rows(ngram_join.jaccard_components(docs, few=few, block=block), "doc_id", "n_shingles", "component_id") == brute_components(texts)


@pytest.fixture(scope="module")
def keyless(spark):
    """Groups of near copies whose ids are null or repeat, with the group of each row: (id, group, text)."""
    group = lambda g, k: " ".join(f"g{g}w{i}" if i != 20 * k + 10 else f"edit{k}" for i in range(200))
    listed = [(None, 0, group(0, k)) for k in range(4)] + [(k and None, 1, group(1, k)) for k in range(4)] + [(50 + g % 2, g, group(g, k)) for g in range(2, 10) for k in range(3)] + [(None, 10, "alone " + group(10, 0))]
    return listed, spark.createDataFrame([(i, t) for i, _, t in listed], "doc_id long, text string").repartition(3).cache()


def test_ngram_join_null_and_repeated_ids(keyless):
    listed, frame = keyless
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (words(t) for _, _, t in listed)]
    assert all((100 * len(a & b) >= 85 * len(a | b)) == (x[1] == y[1]) for a, x in zip(sets, listed) for b, y in zip(sets, listed))
    least = lambda g: min((i for i, h, _ in listed if h == g and i is not None), default=None)
    expected = collections.Counter((i, len(s), least(g)) for s, (i, g, _) in zip(sets, listed))
    assert collections.Counter(map(tuple, ngram_join.jaccard_components(frame).drop("class").collect())) == expected
    of = {(r.id, r["class"]): r.node for r in ngram_join.linked_rows(frame).collect()}
    assert len(of) == len(listed) and len(set(of.values())) == 11


def test_small_sets_share_a_band():
    """Every pair at the threshold shares a band key, also where bands are empty."""
    rng = np.random.default_rng(4)
    for n in [1, 5, 6, 7, 12, 13, 20, 40, 100, 300]:
        for _ in range(40):
            full = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            part = full[: math.ceil(0.85 * len(full))]
            assert set(ngram_join.band_keys(full, 0.85)) & set(ngram_join.band_keys(np.sort(part), 0.85))


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = {(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in texts.items()}
    assert rows(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected


def test_id_cache_stays_within_its_budget():
    from siterank.llm.pretokens import IdCache, PreTokens

    calls = []
    code = lambda strings: [calls.append(s) or [ord(c) for c in s] for s in strings]
    texts = [" ".join(f"w{(i * k) % 400}" for k in range(60)) for i in range(40)]
    for budget in (1, 4_000, 1 << 24):
        cache = IdCache(code, budget)
        for start in range(0, 40, 4):
            pre = PreTokens(texts[start : start + 4], words_only=False)
            ids, before = cache.ids(pre)
            want = [[ord(c) for c in t] for t in texts[start : start + 4]]
            assert [ids[before[i] : before[i + 1]].tolist() for i in range(4)] == want
        assert budget > 4_000 or len(cache.hashes) < 260
    assert len(calls) > 2 * len(cache.hashes)


def test_byte_bpe(docs, texts):
    import tiktoken

    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs, path, tokenizer_files.PATTERN)
    found = {r.doc_id: r for r in byte_bpe.decode(coded, path).collect()}
    for i, t in texts.items():
        assert found[i].ids == library.encode_ordinary(t or "")
        assert bytes(found[i].decoded) == (t or "").encode()
        assert bytes(found[i].ids_le32) == np.array(found[i].ids, "<u4").tobytes()
    whole = byte_bpe.round_trip(docs, path, tokenizer_files.PATTERN)
    assert whole.count() == docs.count() and all(bytes(r.ids_le32) == bytes(found[r.doc_id].ids_le32) and bytes(r.decoded) == bytes(found[r.doc_id].decoded) and 4 * r.n_tokens == len(r.ids_le32) for r in whole.collect())
    spans = {r.doc_id: r for r in byte_bpe.encode(docs.filter("length(text) < 200"), path, tokenizer_files.PATTERN, offsets=True).collect()}
    for i, r in spans.items():
        assert r.ids == found[i].ids
        assert all(0 <= s.start < s.stop <= len(texts[i]) for s in r.offsets)


def test_cut_characters_decode(spark):
    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(spark.createDataFrame([(1, "😀")], "doc_id long, text string"), path, tokenizer_files.PATTERN)
    cut = byte_bpe.decode(coded.withColumn("ids", F.slice("ids", 1, 1)), path).select(byte_bpe.decoded_text().alias("t")).first().t
    assert "�" in cut


def test_language_id(docs, texts, spark):
    labelled = spark.createDataFrame([("en", "the quick brown fox jumps over the lazy dog and the other animals"), ("de", "der schnelle braune Fuchs springt über den faulen Hund und die anderen"), ("el", "η γρήγορη καφέ αλεπού πηδάει"), (None, "zzz"), ("fr", None)] * 3, "lang string, text string")
    model = language_id.fit(labelled)
    assert model.langs == ["de", "el", "en"]
    mixed = spark.createDataFrame([(1, "the other animals jumps over the dog der schnelle braune Fuchs springt über den Hund und die anderen Fuchs"), (2, "πηδάει"), (3, None), (4, "12 !!"), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.identify(mixed, model, penalty=3.0, spans=True).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "de"] and found[1].spans[0].stop == 7
    assert (found[1].lang_pred, found[2].lang_pred, found[2].score) == ("de", "el", 1.0)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].spans for i in (3, 4, 5))
    kept = language_id.identify(docs, model, carry=True)
    assert rows(kept, "row.text", "row.row") == {(t, "r") for t in texts.values()}
    empty = language_id.fit(labelled.limit(0))
    assert {r.lang_pred for r in language_id.identify(mixed, empty).collect()} == {"und"}


def test_language_of_held_out_documents(spark, folder):
    known = spark.read.parquet(f"{folder}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    model = language_id.fit(known.filter(~language_id.held_out()))
    found = language_id.identify(known.filter(language_id.held_out()), model, carry=True)
    right, n = found.select(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("int")), F.count("*")).first()
    assert n > 5 and right >= 0.95


def test_more_languages_than_a_byte_counts():
    """Word k of one text scores best in language k of 300."""
    scores = np.where(np.eye(300, dtype=bool), 50.0, 0.0).astype(np.float32)
    assert language_id.best_path(scores, np.array([0, 300]), 1.0).tolist() == list(range(300))


def test_sample_of_labelled_rows_is_drawn_by_row(spark):
    rows_ = spark.range(3000).selectExpr("'en' AS lang", "'the same words' AS text")
    assert 0 < language_id.fit(rows_, max_docs=300).log.shape[1] == 1


def test_best_path_against_dynamic_program():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 9, 3]
    at = np.append(0, np.cumsum(sizes))
    scores = rng.normal(0, 2, (at[-1], 3)).astype(np.float32)
    labels = language_id.best_path(scores, at, 1.5)
    for i, j in zip(at, at[1:]):
        best = -np.inf
        for code in range(3 ** (j - i)) if j > i else []:
            path = [code // 3**k % 3 for k in range(j - i)]
            best = max(best, sum(scores[i + k, p] for k, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:])))
        got = labels[i:j]
        if j > i:
            assert math.isclose(best, sum(scores[i + k, p] for k, p in enumerate(got)) - 1.5 * (got[1:] != got[:-1]).sum(), rel_tol=1e-4)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = packing.pack(docs, path).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 2048 for r in pieces[1:]) and all(r.length <= 2048 for r in pieces)
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(5)
    for need in ({}, {7: 3}, {2048: 2, 1: 5}, {int(s): int(n) for s, n in zip(rng.integers(1, 2048, 300), rng.integers(1, 400, 300))}, {700: 10**7, 600: 10**7, 3: 10**8}):
        plan = packing.plan_sequences(need, 2048, rounds=60)
        got = collections.Counter()
        for items, n in plan:
            assert sum(items) <= 2048
            for s in items:
                got[s] += n
        assert got == collections.Counter(need)
        least = math.ceil(sum(s * n for s, n in need.items()) / 2048)
        assert sum(n for _, n in plan) <= 1.02 * least + 2 or 700 in need


def test_fingerprints(docs, texts, spark):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[j] or ""
        k = len(a) // 3
        assert (found[i].n_chars, found[i].edited_sha256) == (len(a), sha(a[: len(a) - k] + b[:k]))
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        if a == b:
            assert found[i].near_next == 1 and found[i].fingerprint == found[j].fingerprint
    of = {texts[i]: r.fingerprint for i, r in found.items()}
    assert of["line one.\nline two.\nline three."] == of["line two.\nline one.\nline three."]
    assert of[None] == of[""] and len({of[t] for t in set(TEXTS) - {None, "line two.\nline one.\nline three."}}) == len(set(TEXTS)) - 2
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == sha("abcdab")


def test_likeness_of_texts_without_sentences(spark):
    """Two thirds of the words are shared, or none, with and without spaces between words, short and long."""
    rng = np.random.default_rng(1)
    rows_, expected = [], {}
    for k, (size, glue) in enumerate([(30, " "), (300, " "), (3000, " "), (300, "")]):
        word = (lambda i: f"w{i}") if glue else (lambda i: chr(0x4E00 + i % 20000))
        a, b = rng.integers(0, 10**6, size).tolist(), rng.integers(0, 10**6, size).tolist()
        same = a[: size * 2 // 3] + b[: size // 3]
        rows_.append((k, *[glue.join(map(word, x)) for x in (a, same, b)]))
    frame = spark.createDataFrame(rows_, "k long, a string, same string, other string")
    for c in ("a", "same", "other"):
        frame = fingerprints.with_fingerprint(frame, c, f"f_{c}")
    for r in frame.select("k", fingerprints.likeness("f_a", "f_same").alias("near"), fingerprints.likeness("f_a", "f_other").alias("far")).collect():
        assert 0.5 < r.near < 0.85 and r.far < 0.3, r


def test_fingerprints_are_incremental(spark):
    frame = spark.createDataFrame([("a one.\nb two.\nc", "b two.", "c\na one.")], "whole string, part string, rest string")
    for c in ("whole", "part", "rest"):
        frame = fingerprints.with_fingerprint(frame, c, f"f_{c}")
    frame = frame.withColumn("less", fingerprints.combined("f_whole", "f_part", -1)).withColumn("more", fingerprints.combined("f_rest", "f_part"))
    assert tuple(frame.select(F.col("less") == F.col("f_rest"), F.col("more") == F.col("f_whole")).first()) == (True, True)


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>{extra}<article><h1>Head &amp; {n}</h1><p><b>First {n}<br><p>Second\n  {n}</p><div>{box}</div><p>Licensed.</p></article>{tail}<footer>&copy; foot</footer>'


def test_html_text(spark):
    pages = [(i, f"https://Site.example/{i}?x", PAGE.format(n=i, extra="<div>Welcome to our site</div>", box="Try the app now", tail=f"<section id=comments><p>c{i}</p></section>")) for i in range(10)]
    pages += [(20, None, "<p>no article</p>"), (21, "https://other.example/", None), (22, "bad", ""), (23, "https://other.example/", "text &lt; <b>bold</b><ul><li>one<li>two</ul><p>cut <a hre")]
    frame = spark.createDataFrame([(a, b, c, "clash") for a, b, c in pages], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html_text.extract_text(frame).collect()}
    for i in range(10):
        assert found[i].text == f"Head & {i}\nFirst {i}\nSecond {i}\nLicensed."  # the box and the welcome recur on the site
    assert (found[20].text, found[21].text, found[22].text, found[23].text) == ("no article", "", "", "text < bold\none\ntwo\ncut")
    assert all(r.n_chars == len(r.text) for r in found.values())
    alone = html_text.extract_text(frame.filter("page_id = 3")).first().text
    assert "Try the app now" in alone and entities.unescape(alone) == alone


def test_html_text_of_copies(spark):
    """Copies of one page are no template of their site, with or without an article, and nor is a wrapper of the article."""
    wrapped = "<html><body><div class=wrap><section><article><h1>Title</h1><p>First.</p><div>Inner box</div></article></section></div></body></html>"
    plain = "<html><body><div><h1>Plain</h1><p>No article.</p></div></body></html>"
    pages = [(i, "https://a.example/w", wrapped) for i in range(10)] + [(10 + i, "https://b.example/p", plain) for i in range(10)]
    pages += [(20 + i, f"https://c.example/{i}", wrapped.replace("<html>", f"<html><!-- {i} -->").replace("<div>Inner box</div>", "")) for i in range(10)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert found == {i: ("Title\nFirst.\nInner box", "Plain\nNo article.", "Title\nFirst.")[i // 10] for i in range(30)}


def test_html_text_of_named_wrappers():
    """Names that only contain a furniture word mark nothing, and what holds the article is never furniture."""
    for open_ in ('<div class="layout no-sidebar">', '<div class="with-comments">', '<div id="search-results">', '<section class="post-reply">', '<div class="sidebar">'):
        page = f'<html><body><nav>m</nav>{open_}<article><p>One.</p><p class="notice-board">Two.</p><p class="share-price">Three.</p><div class="share-buttons">x</div></article></{open_[1:].split()[0]}></body></html>'
        assert html_text.main_text(page, frozenset()) == "One.\nTwo.\nThree."
    aside = '<body><div class="sidebar"><article>Teaser</article></div><article><p>Main.</p></article><div class="site-footer">f</div></body>'
    assert html_text.main_text(aside, frozenset()) == "Main."


def test_html_text_of_a_large_host(spark):
    """A block on a twentieth of a host's pages is template; ids may repeat or be null, and a page may be very long."""
    long = "<article>" + "<p>" + "word " * 400_000 + "</p></article>"
    pages = [(i if i % 50 else None, f"https://big.example/{i}", f"<body>{'<div>Buy now</div>' if i % 20 == 0 else ''}<div>own {i}</div><div><p>para {i}</p></div></body>") for i in range(1200)]
    pages += [(7, "https://other.example/", long), (7, "https://other.example/", long), (8, "https://x.example/", "<div>" * 2000 + "deep")]
    found = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    got = {r.url: r.text for r in html_text.extract_text(found).collect()}
    assert all(got[f"https://big.example/{i}"] == f"own {i}\npara {i}" for i in range(1200)) and got["https://x.example/"] == "deep"
    assert html_text.extract_text(found).count() == len(pages) and got["https://other.example/"].count("word") == 400_000


def test_language_model(docs, texts):
    held = crc_mod("doc_id", 7) == 2
    found = {r.doc_id: r for r in language_model.score_documents(docs, held, shortlist=50, known=100).collect()}
    tokens = {i: [*words((t or "").translate(A_Z)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(x for i, w in tokens.items() if not out[i] for x in w)
    total = sum(counts.values())
    for i, w in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_language_model_work_per_word(monkeypatch):
    n = 4000
    counts = 1_000_000 // np.arange(1, n + 1)
    hashes = np.random.default_rng(3).permutation(np.append(np.random.default_rng(2).integers(-(2**63) + 1, 2**63 - 1, n - 1), language_model.END))
    v = language_model.Vocabulary(hashes, counts, 2000, np.full(language_model.TAIL, counts[2000:].sum() / language_model.TAIL), counts.sum(), n)
    net = language_model.Network(v, 4)
    outputs = []
    plain = language_model.exponents
    monkeypatch.setattr(language_model, "exponents", lambda w, h: outputs.append(w.shape[1] * h.shape[1]) or plain(w, h))
    ids = np.random.default_rng(4).choice(2000, 5000, p=counts[:2000] / counts[:2000].sum())
    net.output(np.zeros((5000, 4), np.float32), ids, False)
    assert sum(outputs) / 5000 < 120
    words_ = SimpleNamespace(hashes=np.append(hashes, [5, 2**63 - 1]).astype(np.uint64), data=np.full(n + 2, 97, np.uint8), starts=np.arange(n + 2), ends=np.arange(1, n + 3))
    found, times = v.look(words_)
    assert (found[:2000] == np.arange(2000)).all() and (found[2000:] >= 2000).all() and (times == np.append(counts, [0, 0])).all()


def test_language_model_is_a_distribution_and_learns():
    words_ = np.arange(1, 41)
    v = language_model.Vocabulary(np.append(language_model.END, words_), np.append(30, 60 - words_), 21, np.bincount(words_[20:] % 64, weights=61 - words_[20:], minlength=64) + 1.0, 2000, 41)
    net = language_model.Network(v, 4)
    h = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    net.p["wc"] += 0.3
    every = np.arange(21 + language_model.TAIL)
    logs, _, _ = net.output(np.repeat(h, len(every), 0), every, False)
    assert math.isclose(np.exp(logs.astype(float)).sum(), 1, rel_tol=1e-4)
    ids, fresh = np.array([[1, 2], [3, 4], [5, 30]]), np.array([[True, True], [False, False], [False, False]])

    def loss():
        outs, steps, _ = net.forward(ids, fresh, np.zeros((2, 4), np.float32))
        logs, grads, dh = net.output(outs.reshape(-1, 4), ids.ravel(), True)
        return -logs.sum(), grads | net.backward(ids, fresh, steps, dh.reshape(3, 2, 4))

    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    rng = np.random.default_rng(2)
    net.p["wc"], net.p["ww"] = rng.normal(0, 0.5, net.p["wc"].shape), rng.normal(0, 0.5, net.p["ww"].shape)
    value, grads = loss()
    for name, place in (("u", (1, 2)), ("u", (2, 9)), ("x", (1, 3)), ("x", (3, 10)), ("b", (5,)), ("wc", (0, 1)), ("bw", (3,))):
        keep = net.p[name][place]
        net.p[name][place] = keep + 1e-2
        up = loss()[0]
        net.p[name][place] = keep - 1e-2
        down = loss()[0]
        net.p[name][place] = keep
        assert math.isclose((up - down) / 2e-2, grads[name][place], rel_tol=3e-2, abs_tol=2e-3)


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    made = [exact_dedup.exact_dedup(none), substring_dedup.substring_dedup(none), ngram_join.jaccard_components(none), token_counts.token_counts(none, tokenizer_files.path("word_bpe_49k.json")),
            byte_bpe.decode(byte_bpe.encode(none, path, tokenizer_files.PATTERN), path), packing.pack(none, tokenizer_files.path("byte_bpe_50k.json")), fingerprints.edited_fingerprints(none),
            language_model.score_documents(none, crc_mod("doc_id", 7) == 2), html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string"))]
    assert [df.count() for df in made] == [0] * len(made)
