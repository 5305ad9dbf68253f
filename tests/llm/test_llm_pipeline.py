"""The pipeline's stages against brute force, and plans that the operators must have."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from siterank.llm import fingerprints, ngram_join, substring_dedup  # noqa: E402
from tests.llm.test_llm_operators import brute_components, brute_substrings, keyless  # noqa: E402, F401


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "!!! 12", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long"))
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    state = docs
    before = text(state)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        state = stage(spark, state, folder).cache()
        assert state.columns == docs.columns
        kept[name] = text(state)
        assert state.count() == len(kept[name])
    assert set(before) - set(kept["language"]) == {10**6, 10**6 + 1}
    normal = {i: " ".join(t.split(" ")) for i, t in kept["language"].items()}
    assert len(kept["exact"]) == len({t.replace("\n", " ") for t in normal.values()})
    assert set(kept["near"]) == {i for i, _, c in brute_components(kept["exact"]) if i == c}
    assert {(i, t) for i, t in kept["passages"].items()} == {(i, t) for i, _, _, t in brute_substrings(kept["near"])}
    last = corpus_pipeline.STAGES[4][1](spark, state, folder)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(kept["passages"])


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "πηδάει"), (3, "12 !!"), (4, None), (5, ""), (None, "中文")], "doc_id long, text string").selectExpr("*", "CAST(NULL AS string) AS lang", "'s' AS source", "1L AS n_chars")
    kept = corpus_pipeline.languages(spark, docs, "")
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(1, "the quick fox"), (2, "πηδάει"), (None, "中文")}


def test_near_stage_links_from_five_words_and_080(spark):
    """100 words with two edits: 86/106 of the five-word shingles, but 89/105 of the four-word ones, are shared; with three edits 81/111."""
    text = lambda g, k: " ".join(f"edit{g}" if i in [20, 50, 80][:k] else f"g{g}w{i}" for i in range(100))
    rows = [(1, text(0, 0)), (2, text(0, 2)), (3, text(1, 0)), (4, text(1, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {1, 3, 4}


def test_near_stage_keeps_one_of_null_and_repeated_ids(spark, keyless):  # noqa: F811
    listed, frame = keyless
    full = frame.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    group = {t: g for _, g, t in listed}
    kept = corpus_pipeline.near_copies(spark, full, "").collect()
    assert sorted(group[r.text] for r in kept) == list(range(11))
    assert [r.doc_id for r in kept if group[r.text] == 1] == [0]


def test_near_stage_sends_the_bands_once_and_leaves_no_shuffle_files(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bands = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("class"))
    plan = ngram_join.shared_bands(bands)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == plan.count("Exchange hashpartitioning") == 1
    pairs = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (2, 6), (3, 7)], "key long, class long")
    assert {tuple(r) for r in ngram_join.shared_bands(pairs).collect()} == {(2, 5), (2, 6)}
    dirs = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {f: f.stat().st_size for d in dirs for f in d.rglob("shuffle_*.data")}
    before = left()
    corpus_pipeline.near_copies(spark, docs, "")
    assert sum(n for f, n in left().items() if f not in before) < 0.1 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_passages_stage_sends_tags_only_of_ids_that_repeat(spark):
    base = spark.createDataFrame([(i,) for i in [None, None, -4, *range(300), 7, 7, 11]], "id long")
    repeats = substring_dedup.repeated(base)
    text = [" ".join(f"w{i}x{k}" for k in range(200)).encode() for i in range(300)]
    table = pa.table({"id": pa.array([None, *range(1, 300)], pa.int64()), "tag": np.arange(1000, 1300), "text": pa.array(text, pa.binary())})
    assert substring_dedup.tags_of(table, repeats).nonzero()[0].tolist() == [0, 7, 11]
    size = lambda *x: sum(b.nbytes for b in substring_dedup.window_packs(13, 472, 2 << 20, *x)(table.set_column(1, "tag", pa.array(np.random.default_rng(3).integers(-2**62, 2**62, 300))).to_batches()))
    assert size(repeats) < 0.85 * size()


def test_fingerprints_run_without_python(spark, folder):
    plan = fingerprints.edited_fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.split("Physical Plan")[-1]
    assert F is not None
