"""Token counts of whole texts: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

The first tier is the vocabulary itself: the pre-tokens that it holds as whole words, which are the frequent ones of the
text it was made from, as a sorted array of hashes with a byte each. Its size is that of the vocabulary file, whatever the
input. Pre-tokens outside it are encoded once by a worker and then looked up in its cache. No pre-token is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from siterank.llm.common import column, pieces
from siterank.llm.pretokens import PreTokens, distinct, plain

_state: dict[str, tuple] = {}


def frequent_lengths(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and token counts of the pre-tokens that the vocabulary holds whole."""
    tokenizer = Tokenizer.from_file(path)
    words = [w[: -len("</w>")] for w in tokenizer.get_vocab() if w.endswith("</w>")]
    words = [w for w in words if w.isascii() and w.isalpha() and w == w.lower()]
    pre = PreTokens([w + " " for w in words], words_only=True)
    counts = np.array([len(e) for e in tokenizer.encode_batch(words, add_special_tokens=False)], np.uint8)
    whole = pre.at[1:] - pre.at[:-1] == 1
    hashes, counts = pre.hashes[pre.at[:-1][whole]], counts[whole]
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _worker(path: str):
    """The tokenizer of this worker process, its cache of lengths, and its special strings."""
    if path not in _state:
        tokenizer = Tokenizer.from_file(path)
        _state[path] = tokenizer, {}, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return _state[path]


def count_batches(path: str, table, piece_bytes: int, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache, special = _worker(path)
        hashes, lengths = table.value
        for batch in pieces(batches, "text", piece_bytes):
            texts = column(batch, "text").to_pylist()
            short = [plain(t, special) for t in texts]
            counts = np.zeros(len(texts), np.int64)
            pre = PreTokens([t if ok else "" for t, ok in zip(texts, short)], words_only=True)
            names, where, inverse = distinct(pre.hashes)
            each = np.zeros(len(names), np.int64)
            at = np.minimum(np.searchsorted(hashes, names), len(hashes) - 1)
            hit = hashes[at] == names
            each[hit] = lengths[at[hit]]
            rest = np.flatnonzero(~hit)
            if len(cache) > most:
                cache.clear()
            keys = names[rest].tolist()
            found = list(map(cache.get, keys))
            missing = [i for i, x in enumerate(found) if x is None]
            for i, e in zip(missing, tokenizer.encode_batch_fast(pre.strings(where[rest[missing]]), add_special_tokens=False) if missing else []):
                found[i] = cache[keys[i]] = len(e)
            each[rest] = found
            total = np.zeros(len(pre.hashes) + 1, np.int64)
            np.cumsum(each[inverse], out=total[1:])
            counts = total[pre.at[1:]] - total[pre.at[:-1]]
            odd = [i for i, ok in enumerate(short) if not ok]
            for i, e in zip(odd, tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False) if odd else []):
                counts[i] = len(e)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "n_bytes"), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are those of the tokenizers library for the whole text, without begin or end tokens. Null counts as empty text
    and has no tokens. Rows are kept as they come, repeated ones and null ids too; other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = base.mapInArrow(count_batches(path, table, piece_bytes), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
