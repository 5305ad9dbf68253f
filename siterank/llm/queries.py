"""One query for each operator of this package, over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizer_files
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm import byte_bpe, decontamination, exact_dedup, fingerprints, html_text, language_id, language_model, merkle_manifest, ngram_join, packing, source_divergence, substring_dedup, token_counts
from siterank.llm.common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_files.path("word_bpe_49k.json"))


@query("op2_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).withColumnRenamed("sha256", "text_sha256")


@query("op3_substring_dedup", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN m USING (g) WHERE doc_id > first)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL) AS body FROM w LEFT JOIN c USING (doc_id, p) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_ngram_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b
      WHERE 100 * shared >= 85 * (u.size + v.size - shared)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir)).drop("class")


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_files.path("byte_bpe_50k.json"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(documents(spark, sf_dir), path, tokenizer_files.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query("op10_language_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_source_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p, 1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(documents(spark, sf_dir))


@query("op12_decontamination", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m)),
h AS (SELECT r, i, m, g FROM s SEMI JOIN w USING (m, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
j AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS body FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h JOIN w USING (g) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(body, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN j USING (r)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of the decimal id, a bit at a time.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(CAST(doc_id AS VARCHAR)))),
      lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substring(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) >> 1,
                       3988292384 * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substring(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) & 1))))"""


@query("op13_merkle_manifest", f"""
WITH RECURSIVE e AS (SELECT doc_id, lang, coalesce(lang, '') || CASE WHEN lang IS NULL THEN '-' ELSE '+' END AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown FROM documents),
a AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM e),
v(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM a UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY tree, level, pos // 8, n),
s AS (SELECT v.tree, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM v JOIN (SELECT DISTINCT tree, lang FROM a) USING (tree) WHERE n = 1),
u(level, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
c(r, tree, level, pos, n, folded, proof) AS (SELECT r, tree, 0, pos, n, coalesce(shown, leaf), '' FROM a
  UNION ALL SELECT c.r, c.tree, c.level + 1, c.pos // 8, (c.n + 7) // 8, sha256(string_agg(CASE WHEN v.pos = c.pos THEN folded ELSE h END, '' ORDER BY v.pos)), proof || coalesce(string_agg(h, '' ORDER BY v.pos) FILTER (WHERE v.pos <> c.pos), '')
  FROM c JOIN v ON v.tree = c.tree AND v.level = c.level AND v.pos // 8 = c.pos // 8 WHERE c.n > 1 GROUP BY c.r, c.tree, c.level, c.pos, c.n, folded, proof),
t(r, level, pos, n, folded, proof) AS (SELECT c.r, 0, s.pos, s.n, folded, proof FROM c JOIN s USING (tree) WHERE c.n = 1
  UNION ALL SELECT t.r, t.level + 1, t.pos // 8, (t.n + 7) // 8, sha256(string_agg(CASE WHEN u.pos = t.pos THEN folded ELSE h END, '' ORDER BY u.pos)), proof || coalesce(string_agg(h, '' ORDER BY u.pos) FILTER (WHERE u.pos <> t.pos), '')
  FROM t JOIN u ON u.level = t.level AND u.pos // 8 = t.pos // 8 WHERE t.n > 1 GROUP BY t.r, t.level, t.pos, t.n, folded, proof)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified FROM a JOIN s USING (tree) JOIN t ON t.r = a.r AND t.n = 1 JOIN u ON u.n = 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.merkle_manifest(documents(spark, sf_dir), crc_mod("doc_id", 3) == 0)
