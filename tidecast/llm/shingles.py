"""Word shingles of whole texts as 64-bit hashes, a record batch at a time.

Words are maximal runs of anything but ASCII white space (0x20, 0x09-0x0D), with A-Z
lower-cased.  A text of fewer than k words, but not none, is one shingle: its whole
sequence.  Equality of shingles is equality of 64-bit hashes (a chance of 2**-64 per pair
of different shingles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes of text hashed at a time (texts are never cut: a longer text is a chunk of its own).
CHUNK = 1 << 19

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_ROLL = mix64(np.arange(1001, 1065, dtype=np.uint64))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_BACK, k, 1 << 64))])
        return cls.up[:n], cls.down[:n]


#: Powers of an odd number and of its inverse modulo 2**64: the factors of rolling hashes.
powers = _Powers.get


def _hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts data[offsets[i]:offsets[i+1]], in text order, and how
    many each text has (with repeats)."""
    n = len(offsets) - 1
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[_FOLD[data]] * up[: len(data)], out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)  # words before each text
    count = np.diff(at)
    made = np.maximum(count - k + 1, np.minimum(count, 1))
    out = np.empty(int(made.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(made)])
    full = count >= k
    if full.any():
        m = len(words) - k + 1
        rolled = np.zeros(m, np.uint64)
        for j in range(k):
            rolled += words[j : m + j] * (_ROLL[j] | np.uint64(1))
        rolled = mix64(rolled + np.uint64(k))
        inside = np.repeat(np.arange(n), made)[np.repeat(full, made)]
        pos = np.arange(len(out))[np.repeat(full, made)] - first[inside] + at[inside]
        out[np.repeat(full, made)] = rolled[pos]
    for i in np.flatnonzero((count > 0) & ~full):
        w = words[at[i] : at[i + 1]]
        out[first[i]] = mix64((w * (_ROLL[: len(w)] | np.uint64(1))).sum(dtype=np.uint64)[None] + np.uint64(len(w)))[0]
    return out, made


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null or wordless texts."""
    if not 1 <= k <= len(_ROLL):
        raise ValueError(f"shingles of 1 to {len(_ROLL)} words")
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, len(texts))
        hashes, made = _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        first = 0
        for m in made:
            yield np.unique(hashes[first : first + m])
            first += m
        i = j
