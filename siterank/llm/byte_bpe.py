"""Byte-level BPE by the tokenizers library from a file of token ranks, over Arrow batches, and its inverse.

Bytes become printable characters for the library and back: the byte table is the one of byte-level BPE, built by rule.
Merges are read off the ranks: every pair of tokens whose bytes together make a token is a merge of that token's rank. A pre-token that
is itself a token is never split (the library's ignore_merges), as with ranks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from siterank.llm.common import column, pieces
from siterank.llm.pretokens import IdCache, PreTokens, plain, spread

_state: dict[str, tuple] = {}


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable in Latin-1, otherwise the next unused one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(token) for token, _ in sorted(pairs, key=lambda p: int(p[1]))]


def rank_tokenizer(tokens: list[bytes], pattern: str) -> Tokenizer:
    """A tokenizer whose ids are the ranks."""
    shown = byte_characters()
    spell = lambda token: "".join(shown[b] for b in token)
    rank = {token: i for i, token in enumerate(tokens)}
    merges = []
    for token in tokens:
        cuts = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in rank and token[k:] in rank]
        merges += [(spell(a), spell(b)) for a, b in sorted(cuts, key=lambda c: (rank[c[0]], rank[c[1]]))]
    made = Tokenizer(models.BPE(vocab={spell(t): i for t, i in rank.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def worker_state(path: str, definition) -> tuple[Tokenizer, IdCache]:
    """The tokenizer and cache of a worker process, made once for all its tasks."""
    if path not in _state:
        tokenizer = Tokenizer.from_str(definition.value)
        _state[path] = tokenizer, IdCache(lambda strings: [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)])
    return _state[path]


def encode_texts(texts: list[str], tokenizer: Tokenizer, cache: IdCache, special: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids before each text and at the end."""
    short = [plain(t, special) for t in texts]
    ids, at = cache.ids(PreTokens([t if ok else "" for t, ok in zip(texts, short)], words_only=False))
    odd = [i for i, ok in enumerate(short) if not ok]
    if not odd:
        return ids, at
    each = [ids[at[i] : at[i + 1]] for i in range(len(texts))]
    for i, e in zip(odd, tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False)):
        each[i] = np.array(e.ids, np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=at[1:])
    return np.concatenate(each), at


def encode_batches(path: str, definition, offsets: bool, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = worker_state(path, definition)
        for table in pieces(batches, "text", piece_bytes):
            texts = column(table, "text").to_pylist()
            if offsets:
                found = tokenizer.encode_batch(texts, add_special_tokens=False)
                spans_ = pa.array([[{"start": i, "stop": j} for i, j in e.offsets] for e in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([column(table, "id"), pa.array([e.ids for e in found], pa.list_(pa.int32())), spans_], names=["id", "ids", "offsets"])
            else:
                ids, at = encode_texts(texts, tokenizer, cache)
                yield pa.RecordBatch.from_arrays([column(table, "id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False, piece_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: id and ids, and with ``offsets`` the character range of each token.

    Null counts as empty text, which has no ids. Strings of special tokens are ordinary text. A token that is part of a
    character has the range of the whole character. Rows are kept as they come; other columns are not read.
    """
    definition = docs.sparkSession.sparkContext.broadcast(rank_tokenizer(read_ranks(path), pattern).to_str())
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    schema = "id long, ids array<int>" + (", offsets array<struct<start:int,stop:int>>" if offsets else "")
    return base.mapInArrow(encode_batches(path, definition, offsets, piece_bytes), schema).withColumnRenamed("id", id_column)


def token_bytes(ids: np.ndarray, before: np.ndarray, table) -> tuple[pa.Array, pa.Array]:
    """Little-endian ids and decoded bytes of each text; ``before`` is the number of ids before each text and at the end."""
    data, starts, sizes = table
    decoded = data[spread(sizes[ids], starts[ids])]
    ends = np.append(0, np.cumsum(sizes[ids]))[before]
    binary = lambda offsets, values: pa.Array.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
    return binary(4 * before, np.ascontiguousarray(ids, "<u4")), binary(ends, decoded)


def decode_batches(table, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, piece_rows):
                part = batch.slice(first, piece_rows)
                ids = part.column("ids")
                before = np.append(0, np.cumsum(np.diff(ids.offsets.to_numpy())))
                words, blob = token_bytes(ids.flatten().to_numpy(), before, table.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names], words, blob], names=[*part.schema.names, "ids_le32", "decoded"])

    return run


def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, their starts and sizes, by the reversed table of byte characters."""
    shown = byte_characters()
    back = {c: b for b, c in enumerate(shown)}
    spelled = ["".join(shown[b] for b in token) for token in read_ranks(path)]  # as the library keeps them
    tokens = [bytes(back[c] for c in token) for token in spelled]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def coded_batches(path: str, definition, table, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = worker_state(path, definition)
        for piece in pieces(batches, "text", piece_bytes):
            ids, before = encode_texts(column(piece, "text").to_pylist(), tokenizer, cache)
            words, blob = token_bytes(ids, before, table.value)
            yield pa.RecordBatch.from_arrays([column(piece, "id"), pa.array(np.diff(before), pa.int64()), words, blob], names=["id", "n_tokens", "ids_le32", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", piece_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: id, n_tokens, ids_le32 and decoded, by ``encode`` and ``decode`` in one pass over the texts.

    Null counts as empty text, which has no ids. Texts of any length are encoded whole, repeated rows and ids are kept as they come, other columns are not
    read, and an empty table gives none.
    """
    context = docs.sparkSession.sparkContext
    definition, table = context.broadcast(rank_tokenizer(read_ranks(path), pattern).to_str()), context.broadcast(byte_table(path))
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(coded_batches(path, definition, table, piece_bytes), "id long, n_tokens long, ids_le32 binary, decoded binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, piece_rows: int = 400) -> DataFrame:
    """The rows with ``ids_le32``, the ids as little-endian 32-bit integers, and ``decoded``, their bytes: each token's characters looked up in the reversed byte table.

    Bytes of a character that tokens split are simply joined; ``decoded_text`` makes text of them. Null ids give no bytes.
    """
    table = encoded.sparkSession.sparkContext.broadcast(byte_table(path))
    rows = encoded.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.mapInArrow(decode_batches(table, piece_rows), T.StructType([*rows.schema.fields, T.StructField("ids_le32", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))


def decoded_text(decoded: str = "decoded") -> Column:
    """Decoded bytes as text; bytes of cut characters become U+FFFD."""
    return F.make_valid_utf8(F.col(decoded).cast("string"))
