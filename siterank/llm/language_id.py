"""Languages of texts and of spans inside them: scripts narrow the candidates, then Viterbi over scores of words.

A word's score in a language is the sum of log probabilities of its byte trigrams (with a mark at both ends), hashed into a
table of fixed size. Only languages that use the script of the word take part. The best path pays ``penalty`` for each
change of language. Texts of a batch run through the recurrence side by side, longest first, so each step is one array
operation over all texts that still have words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import U, Words, column, crc_mod, mix, pieces, text_bytes

CELLS = 1 << 16
NEVER = -1e4
#: Scripts by code point range.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
           ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
NAMES = [*[s for s, _, _ in SCRIPTS], "other"]
EDGE = np.uint32(0xFF)


def _script_table() -> np.ndarray:
    """Script by the first two UTF-8 bytes of a character; -1 where no letter starts."""
    table = np.full((256, 256), -1, np.int8)
    for lead in range(0xC3, 0xF5):
        table[lead] = len(NAMES) - 1
    for k, (_, low, high) in enumerate(SCRIPTS):
        for cp in range(low, high + 1):
            coded = chr(cp).encode()
            if cp < 0x80:
                if chr(cp).isalpha():
                    table[coded[0]] = k
            elif chr(cp).isalpha():
                table[coded[0], coded[1]] = k
    return table


SCRIPT_OF = _script_table()
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = True
IS_LETTER[0xC3:] = IS_LETTER[0x80:0xC0] = True


class Features:
    """Trigram cells of the letters of a batch by word, with the script and number of letters of each word."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        data, n = words.data, len(words.data)
        lengths = words.ends - words.starts
        index = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(np.repeat(True, n) & ~_spaces(n, words)) if n else np.zeros(0, np.int64)
        keep = IS_LETTER[data[at]]
        self.word, where = index[keep], at[keep]
        now = FOLD[data[where]]
        same = np.append(False, self.word[1:] == self.word[:-1]) if len(now) else np.zeros(0, bool)
        last = np.where(same, np.append(EDGE, now[:-1])[: len(now)], EDGE)
        follow = np.append(same[1:], False) if len(now) else same
        nxt = np.where(follow, np.append(now[1:], EDGE)[: len(now)], EDGE)
        self.cells = (mix((last.astype(np.uint64) << U(16)) | (now.astype(np.uint64) << U(8)) | nxt.astype(np.uint64)) % U(CELLS)).astype(np.int64)
        head = now if len(now) else np.zeros(0, np.uint32)
        self.letters = np.bincount(self.word, minlength=len(lengths))
        self.script = np.full(len(lengths), -1, np.int8)
        if len(head):
            second = data[np.minimum(where + 1, n - 1)]
            kinds = SCRIPT_OF[data[where], np.where(data[where] < 0x80, 0, second)]
            good = np.flatnonzero(kinds >= 0)[::-1]
            self.script[self.word[good]] = kinds[good]  # the first letter's script stays


def _spaces(n: int, words: Words) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, words.starts, 1)
    np.add.at(change, words.ends, -1)
    return np.cumsum(change[:n]) == 0


def count_cells(piece_bytes: int):
    """(lang, kind, cell, n) of labelled texts: kind 0 trigram cells, kind 1 letters by script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for table in pieces(batches, "text", piece_bytes):
            f = Features(column(table, "text"))
            langs, code = np.unique(np.array(column(table, "lang").to_pylist(), object), return_inverse=True)
            of_word = np.repeat(code, f.words.counts)
            for k, lang in enumerate(langs):
                mine = of_word == k
                cells = np.bincount(f.cells[mine[f.word]], minlength=CELLS)
                scripts = np.bincount(f.script[mine & (f.script >= 0)], weights=f.letters[mine & (f.script >= 0)], minlength=len(NAMES)).astype(np.int64)
                totals[lang] = totals.get(lang, 0) + np.concatenate([cells, scripts])
        for lang, both in totals.items():
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(both[at].astype(np.int64))], names=["lang", "cell", "n"])

    return run


class Model:
    """Log probabilities of cells (cells x languages) and which languages use a script (scripts x languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, min_share: float = 0.01):
        self.langs = langs
        cells, scripts = counts[:CELLS] + 0.1, counts[CELLS:]
        self.log = np.log(cells / cells.sum(0)).astype(np.float32)
        used = scripts >= min_share * np.maximum(scripts.sum(0), 1)
        used[~used.any(1)] = True
        self.barred = np.where(np.vstack([used, np.ones((1, len(langs)), bool)]), 0, NEVER).astype(np.float32)


def fit(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", max_docs: int = 40_000, piece_bytes: int = 2 << 20) -> Model:
    """Counts over labelled rows, summed in Spark; only the table of fixed size comes to the driver.

    Rows without text or label are skipped. ``max_docs`` bounds the labelled rows: beyond it, about so
    many are drawn row by row, so equal texts are not taken or left as a whole. Without any labelled row the model knows no language.
    """
    known = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")).dropna()
    n = docs.filter(F.col(lang_column).isNotNull()).count()
    if n > max_docs:
        known = known.sample(max_docs / n, seed=17)
    counted = known.select("lang", text_bytes("text").alias("text")).mapInArrow(count_cells(piece_bytes), "lang string, cell int, n long")
    rows = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique()) if len(rows) else []
    counts = np.zeros((CELLS + len(NAMES), len(langs)))
    counts[rows["cell"].to_numpy(int), np.searchsorted(langs, rows["lang"].to_numpy(str)) if len(rows) else []] = rows["n"]
    return Model(list(map(str, langs)), counts)


def best_path(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word: the best path of each text through its words' scores, with a price for each change."""
    counts = np.diff(at)
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    active = np.searchsorted(-counts[order], -np.arange(longest), side="left")  # texts with more than t words
    first, rank = at[:-1][order], np.arange(len(scores))
    labels = np.zeros(len(scores), np.int32)
    stay = np.zeros((len(scores), scores.shape[1]), bool)
    top = np.zeros(len(scores), np.int32)
    value = np.zeros((len(counts), scores.shape[1]), np.float32)
    for t in range(longest):
        m = active[t]
        w = first[:m] + t
        v = value[:m]
        best = v.argmax(1)
        limit = v[rank[:m], best][:, None] - penalty
        top[w] = best
        stay[w] = v >= limit
        v = np.maximum(v, limit) + scores[w]
        value[:m] = v - v.max(1, keepdims=True)
    state = value.argmax(1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        w = first[:m] + t
        labels[w] = state[:m]
        state[:m] = np.where(stay[w, state[:m]], state[:m], top[w])
    return labels


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def label_batches(model, penalty: float, spans: bool, carry: bool, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.langs)
        for table in pieces(batches, "text", piece_bytes):
            f = Features(column(table, "text"))
            scores = np.empty((len(f.words.starts), k), np.float32)
            for j in range(k):
                scores[:, j] = np.bincount(f.word, weights=m.log[f.cells, j], minlength=len(scores))
            scores += m.barred[f.script]
            labels = best_path(scores, f.words.at, penalty) if k else np.zeros(len(scores), np.int32)
            doc = np.repeat(np.arange(table.num_rows), f.words.counts)
            weight = np.bincount(doc * max(k, 1) + labels, weights=f.letters, minlength=table.num_rows * max(k, 1)).reshape(table.num_rows, -1)
            total = weight.sum(1)
            ok = column(table, "letter").to_numpy(zero_copy_only=False) & (total > 0) & (k > 0)
            pick = weight.argmax(1)
            out = [column(table, "id"), pa.array([m.langs[i] if y else "und" for i, y in zip(pick, ok)]), pa.array(np.where(ok, weight.max(1) / np.maximum(total, 1), 0.0))]
            if spans:
                turn = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1]))) if len(labels) else np.zeros(0, np.int64)
                found: list[list] = [[] for _ in range(table.num_rows)]
                for i, j in zip(turn.tolist(), np.append(turn[1:], len(labels)).tolist() if len(turn) else []):
                    if ok[doc[i]]:
                        base = f.words.at[doc[i]]
                        found[doc[i]].append({"start": i - int(base), "stop": j - int(base), "lang": m.langs[labels[i]]})
                out.append(pa.array(found, RUNS))
            if carry:
                out.append(column(table, "row"))
            yield pa.RecordBatch.from_arrays(out, names=["id", "lang_pred", "score", *["spans"] * spans, *["row"] * carry])

    return run


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", penalty: float = 12.0, spans: bool = False, carry: bool = False, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, lang_pred, score and, with ``spans``, word ranges with their languages; with ``carry``
    also ``row``, a struct of all input columns.

    lang_pred has the most letters on the best path and score is its share of the letters; ties go to the first language in
    order of name. Null text, text without a letter, or a model without languages give `und`, 0 and no spans. Rows are kept
    as they come; without ``carry`` only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("id"), text.cast("binary").alias("text"), text.rlike(r"\p{L}").alias("letter"), *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry)
    schema = "id long, lang_pred string, score double" + (", spans array<struct<start:int,stop:int,lang:string>>" if spans else "") + (f", row {base.schema['row'].dataType.simpleString()}" if carry else "")
    return base.mapInArrow(label_batches(shared, penalty, spans, carry, piece_bytes), schema).withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id"):
    return crc_mod(id_column, 5) == 0
