"""Pre-tokens of two public byte-pair vocabularies, found for whole batches of texts with array operations.

Texts made only of ASCII, Latin letters up to U+024F and common punctuation are cut here by character classes; the classes
of these characters are the same in all Unicode versions since 2.0. All other texts (``plain`` is false) are left to the
tokenizers library as a whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from siterank.llm.common import U, spans

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞€]")
LIMIT = 0x2100
CLASSES = np.full(LIMIT, OTHER, np.uint8)
LOWER = np.arange(LIMIT, dtype=np.uint32)
for _cp in range(0x250):
    _c = chr(_cp)
    CLASSES[_cp] = LETTER if _c.isalpha() else NUMBER if _c.isnumeric() else SPACE if _c.isspace() else OTHER
    if len(_c.lower()) == 1:
        LOWER[_cp] = ord(_c.lower())
VALUES = np.random.default_rng(7).integers(0, 2**64, LIMIT, dtype=np.uint64)


def plain(text: str, special: tuple[str, ...] = ()) -> bool:
    """Whether a text can be cut here: only known characters, no string that the library takes as a special token."""
    return ODD.search(text) is None and not any(s in text for s in special)


class PreTokens:
    """Spans (start, end) of the pre-tokens of the texts laid end to end, their hashes, and the first one of each text."""

    def __init__(self, texts: list[str], words_only: bool):
        """words_only: lower-case the text, drop white space and take numbers digit by digit; otherwise a space before a
        run belongs to it, and white space before it stays a pre-token of its own."""
        self.text = "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        if words_only:
            codes = LOWER[codes]
        kind = CLASSES[codes]
        n = len(codes)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        begin = np.zeros(n + 1, bool)
        begin[bounds] = True
        first = begin[:n].copy()
        first[1:] |= kind[1:] != kind[:-1]
        edge = begin.copy()
        after = np.append(kind[1:], OTHER)
        last_space = (kind == SPACE) & (after != SPACE) & ~edge[1:]  # the white space just before a run
        blank = last_space & (codes == 32)
        if words_only:
            first |= kind == NUMBER
        else:
            first |= last_space
            first[1:] &= ~blank[:-1] | begin[1:n]  # a run is joined to the space before it
        self._contractions(codes, kind, first, begin, blank, words_only)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        if words_only:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        self.starts, self.ends = starts, ends
        self.hashes = spans(VALUES[codes], starts, ends)
        self.at = np.searchsorted(starts, bounds)

    @staticmethod
    def _contractions(codes, kind, first, begin, blank, words_only) -> None:
        """An apostrophe that starts a pre-token, with s, t, m, d, re, ve or ll after it, is cut off with these letters."""
        n = len(codes)
        if n < 2:
            return
        quote = np.flatnonzero((codes[:-1] == 39) & first[:-1] & (kind[1:] == LETTER) & ~begin[1:n])
        for i in quote.tolist():
            one = chr(codes[i + 1])
            two = one + chr(codes[i + 2]) if i + 2 < n and not begin[i + 2] else ""
            size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size:
                first[i + 1] = False
                if i + 1 + size < n and not begin[i + 1 + size] and kind[i + 1 + size] == LETTER:
                    first[i + 1 + size] = True

    def strings(self, which: np.ndarray, lower: bool = False) -> list[str]:
        out = [self.text[i:j] for i, j in zip(self.starts[which].tolist(), self.ends[which].tolist())]
        return [s.lower() for s in out] if lower else out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, one position of each, and for every position the index of its hash."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], inverse


def spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... for each of sizes[i], one after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class IdCache:
    """Token ids by hash of the pre-token, kept by a worker process in flat arrays of at most ``budget`` bytes; beyond that only the entries of
    the present texts stay."""

    def __init__(self, encode, budget: int = 24 << 20):
        self.encode, self.budget = encode, budget
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Entries in ascending order of hash, their ids one after another in ``flat``."""
        self.hashes, self.sizes, self.starts, self.flat = hashes, sizes, np.cumsum(sizes) - sizes, flat

    def ids(self, pre: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the number of ids before each text."""
        hashes, where, inverse = distinct(pre.hashes)
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            coded = self.encode(pre.strings(where[new]))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
            if 24 * (len(self.hashes) + len(sizes)) + self.flat.nbytes + flat.nbytes > self.budget:  # only what these texts use
                used = at[~new]
                self._keep(self.hashes[used], self.sizes[used], self.flat[spread(self.sizes[used], self.starts[used])])
                at = np.searchsorted(self.hashes, hashes)
            counts, starts = np.insert(self.sizes, at[new], sizes), np.insert(self.starts, at[new], len(self.flat) + np.cumsum(sizes) - sizes)
            self.hashes, self.sizes, self.starts, self.flat = np.insert(self.hashes, at[new], hashes[new]), counts, starts, np.concatenate([self.flat, flat])
            at = np.searchsorted(self.hashes, hashes)
        sizes, starts = self.sizes[at], self.starts[at]
        counts = sizes[inverse]
        ids = self.flat[spread(counts, starts[inverse])]
        before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return ids, before[pre.at]
