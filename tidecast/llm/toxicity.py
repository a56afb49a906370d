"""Toxicity scores from the nearest labelled examples.

Exact TF-IDF cosine against a bounded set of labelled examples, found with a block-max
inverted index; distance-weighted votes, calibrated on the examples themselves (each left out
of its own vote).

* Terms: whole words (runs of word characters and marks, lower case) without plural endings
  (Harman's S-stemmer); overlapping pairs of characters in scripts without spaces.  A term is
  its 64-bit xxhash from here on.
* Examples: at most ``MAX_EXAMPLES`` labelled rows, those with the smallest hash of their
  id, as long as they hold at most ``MAX_POSTINGS`` distinct terms of texts together (a
  bounded sample, the documented bound of the classifier; texts are whole).
* Vector space: every term of the examples, weighted by TF-IDF, times 1 + G2 (log-likelihood
  ratio) where the term is more frequent among toxic examples: no term is left out, and
  terms that speak for the label count more.  Document frequencies
  behind the IDF are counted over all documents.  A term that no example holds meets no
  example; it counts in the length of a text's vector, like a term of one document.
* Index: examples are ordered so that alike ones lie together and cut into blocks of
  ``BLOCK``; a term's postings are kept by block with the block's largest weight.  A search
  adds up query weight times block maximum over the query's terms, which bounds every cosine
  in a block, reads the postings of the ``FIRST`` blocks of highest bound, and then only those
  blocks whose bound reaches the k-th best cosine found.  Texts are searched ``TOGETHER`` at a
  time, and the commonest terms of a block are read as one matrix product of all texts that
  opened it; the best rows get their cosines again in double precision.
* Where the bounds of the first ``PROBE`` texts open more than ``OPEN`` of many blocks, working
  them out costs more than the blocks they close: the texts after them read all blocks, each
  term's postings at a stretch.  Both ways are exact.
* A text without any term of the examples is nearest to nothing and gets the rate of toxic
  examples among such texts.

Null and empty texts have the zero vector.  Labels that are null are no labels; a document
labelled twice is toxic if any of them says so; labels without a document, and documents
with a null id, are no examples.  Without any label the score is 0.  Equal cosines go by the
order of the index.  Repeated rows and ids are scored row by row; other columns pass through
untouched.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BROADCAST_ROWS, give_back, mix64, returned_at_once, stored, temp_name, tidy
from .shingles import powers

MAX_EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 256
FIRST = 2
#: Rows whose largest sum stands for them when all blocks are read.
STRIP = 64
ROUNDING = 1e-4  # more than sums of 32-bit products are off
EVIDENCE = 3
#: Postings, and rows of the commonest terms, that the driver works on at a time.
CHUNK, FEW = 1 << 20, 1 << 11
#: Most distinct terms of all examples together, each counted once an example.
MAX_POSTINGS = 6_000_000
#: Commonest terms, and groups of examples by them, that order the index.
LEADERS = 512
GROUPS = 16
#: Texts whose scores a task remembers (it forgets them all when there are more).
REMEMBERED = 50_000
#: Texts of a batch that a task holds as strings at a time.
SLICE = 1024
#: Words whose terms a worker remembers (16 bytes each; it forgets them all when there are more).
REMEMBERED_WORDS = 1 << 19
#: Texts searched together, those of them whose blocks are counted, and the share of opened
#: blocks from which on the others read all, in an index of at least ``MANY`` blocks.
TOGETHER, PROBE, OPEN, MANY = 128, 4, 0.4, 32

_WORDS = re.compile(r"\w+").findall
_FURTHER = re.compile("[\u0300-\U0010ffff]").search  # may hold marks or unspaced scripts
_MARKED = regex.compile(r"[\w\p{M}]+").findall
# Fixed value: scripts written without spaces between words (Thai, Lao, Myanmar, Khmer, kana, ideographs).
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+)")


def stem(word: str) -> str:
    """Harman's S-stemmer: plural endings of words over three letters."""
    if len(word) < 4 or word[-1] != "s" or word[-2] in "us":
        return word
    if word.endswith("ies") and word[-4] not in "ea":
        return word[:-3] + "y"
    return word[:-1]


def stems(text: str | None) -> list[str]:
    """The terms of a text: stems of whole words, and overlapping pairs of characters where
    a script has no spaces."""
    if not text:
        return []
    text = text.lower()
    if not _FURTHER(text):
        return [stem(w) if w[-1] == "s" else w for w in _WORDS(text)]
    out = []
    for w in _MARKED(text):
        for i, part in enumerate(_UNSPACED.split(w)):
            if i % 2 and len(part) > 1:
                out += map("".join, zip(part, part[1:]))
            elif part:
                out.append(stem(part))
    return out


def hashed(terms: Iterable[str]) -> np.ndarray:
    """64-bit hashes of terms."""
    h = xxhash.xxh3_64_intdigest
    return np.array([h(t) for t in terms], np.uint64).view(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text, hashed, and how often it holds each."""
    c = Counter(stems(text))
    return hashed(c), np.fromiter(c.values(), np.int64, len(c))


_LATIN = np.array([bool(_WORDS(chr(c))) for c in range(0x300)])  # which characters make words
_LETTER = mix64(np.arange(1, 0x301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Known:
    """The hashed terms of words that a worker has met, by the words' rolling hashes."""

    words, terms = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @classmethod
    def get(cls, words: np.ndarray, joined: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Terms of distinct ascending words, which stand at joined[start:stop]."""
        if len(cls.words) > REMEMBERED_WORDS:
            cls.words, cls.terms = cls.words[:0].copy(), cls.terms[:0].copy()
        at = np.searchsorted(cls.words, words)
        new = np.ones(len(words), bool)
        inside = at < len(cls.words)
        new[inside] = cls.words[at[inside]] != words[inside]
        out = np.empty(len(words), np.int64)
        out[~new] = cls.terms[at[~new]]
        if new.any():
            out[new] = hashed([stem(joined[i:j]) for i, j in zip(start[new].tolist(), stop[new].tolist())])
            cls.words, cls.terms = np.insert(cls.words, at[new], words[new]), np.insert(cls.terms, at[new], out[new])
        return out


def _tally(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``counted`` of lower-cased texts without characters from U+0300 on, terms ascending.
    Words are cut and told apart (by rolling 64-bit hashes) for all texts at once; each
    distinct word is stemmed and hashed as a string once, as long as it is remembered."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-16-le"), "<u2")
    edge = np.flatnonzero(np.diff(_LATIN[code].view(np.int8), prepend=0, append=0))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return [(np.zeros(0, np.int64),) * 2] * len(texts)
    up, down = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_LETTER[code] * up[:-1], out=sums[1:])
    word = mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    word, one, which = np.unique(word, return_index=True, return_inverse=True)
    term, of = np.unique(_Known.get(word, joined, start[one], stop[one]), return_inverse=True)
    end = np.cumsum([len(t) + 1 for t in texts])
    pair, n = np.unique(np.searchsorted(end, start, "right") * len(term) + of[which], return_counts=True)
    at = np.searchsorted(pair, np.arange(len(texts) + 1) * len(term))
    term = term[pair % len(term)]
    return [(term[i:j], n[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def tallied(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``counted`` of each text, whatever the order of its terms."""
    lower = [(t or "").lower() for t in texts]
    plain = [not _FURTHER(t) for t in lower]
    latin = iter(_tally([t for t, p in zip(lower, plain) if p]))
    return [next(latin) if p else counted(t) for t, p in zip(texts, plain)]


# ------------------------------------------------------------------ index


def _frequency(n: np.ndarray) -> np.ndarray:
    """Weight of a term that a text holds n times, before its IDF, in double precision."""
    return 1.0 + np.log(n.astype(np.float64))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1 and so on, as one array."""
    n = hi - lo
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - (end - n), n)


@dataclass
class Index:
    """Examples as rows in the order of the index, and their postings by term.  This much is
    sent to the workers; ``ready`` derives the blocks from it.

    The ``LEADERS`` commonest terms are in most blocks, which hold them as a small matrix.  For
    the others entry e is one term in one block: rows ``block_post[entry_post[e]:entry_post[e + 1]]``
    of block ``entry_block[e]`` hold it, with a weight of at most ``entry_peak[e]``; the entries
    of term t are ``term_entry[t]`` up to ``term_entry[t + 1]``.  By row, terms and counts of
    row r begin at ``row_at[r]`` of ``row_term`` and ``row_count``."""

    terms: np.ndarray  # hashes, ascending
    idf: np.ndarray  # times relevance
    unseen: float  # the same of a term that no example holds
    ids: np.ndarray  # example ids
    toxic: np.ndarray  # 0/1 per example
    length: np.ndarray  # of each example's vector before it is scaled to 1
    offset: np.ndarray  # (terms + 1,): where a term's postings begin
    post: np.ndarray  # example rows, by term and row
    count: np.ndarray  # how often the row holds the term
    base: float  # toxic rate of all examples
    blank: float  # toxic rate of examples with the zero vector
    knots: tuple[np.ndarray, np.ndarray]  # calibration: vote -> score

    sent = None  # the index as a broadcast variable
    row_at = None  # derived
    blocks_read = blocks_seen = 0

    def __getstate__(self):
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    def ready(self) -> Index:
        """The index with its derived parts."""
        if self.row_at is None:
            with returned_at_once():
                self._derive()
            give_back()
        return self

    def _derive(self) -> None:
        # Every worker makes these parts: CHUNK postings at a time, and first those that need most room.
        self.frequency = _frequency(np.maximum(np.arange(int(self.count.max(initial=0)) + 1), 1))  # by count
        n, size = len(self.ids), np.diff(self.offset)
        blocks = -(-n // BLOCK)
        self.leader = np.full(len(self.terms), -1, np.int32)
        often = np.argsort(-size, kind="stable")[:LEADERS]
        self.leader[often] = np.arange(len(often))
        other = np.repeat(self.leader < 0, size)
        self.block_post = self.post[other]
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.where(self.leader < 0, size, 0))
        self.weight, at = np.empty(len(term), np.float32), 0
        for lo in range(0, len(other), CHUNK):
            some = lo + np.flatnonzero(other[lo : lo + CHUNK])
            self.weight[at : at + len(some)] = self._weights(self.count[some], term[at : at + len(some)], self.post[some])
            at += len(some)
        del other
        block = _small(np.floor_divide(self.block_post, BLOCK, dtype=np.int32))
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        del term
        entries, at = int(np.count_nonzero(new)), 0
        self.entry_block, self.entry_post, self.entry_peak = np.empty(entries, block.dtype), np.empty(entries + 1, np.int32), np.empty(entries, np.float32)
        self.entry_post[-1] = len(new)
        for lo in range(0, len(new), CHUNK):
            first = np.flatnonzero(new[lo : lo + CHUNK]) + lo
            self.entry_post[at : at + len(first)], self.entry_block[at : at + len(first)] = first, block[first]
            at += len(first)
        for lo in range(0, entries, CHUNK):
            edge = self.entry_post[lo : lo + CHUNK + 1]
            self.entry_peak[lo : lo + CHUNK] = np.maximum.reduceat(self.weight[edge[0] : edge[-1]], edge[:-1] - edge[0])
        held = np.concatenate([[0], np.cumsum(np.where(self.leader < 0, size, 0))]).astype(np.int32)
        self.term_entry = np.searchsorted(self.entry_post[:-1], held).astype(np.int64)
        del new, block
        self.row_term, self.row_count = np.empty(len(self.post), np.int32), np.empty(len(self.post), self.count.dtype)
        held = sum((np.bincount(self.post[lo : lo + CHUNK], minlength=n) for lo in range(0, len(self.post), CHUNK)), np.zeros(n, np.int64))
        row_at = np.concatenate([[0], np.cumsum(held)])
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(row_at, row_at[row] + CHUNK, "right")) - 1)
            some = np.flatnonzero((self.post >= row) & (self.post < end))
            term = np.searchsorted(self.offset, some, "right") - 1  # ascending, as some is
            by = np.argsort(self.post[some], kind="stable")
            part = slice(int(row_at[row]), int(row_at[end]))
            self.row_term[part], self.row_count[part] = term[by], self.count[some[by]]
            row = end
        self.dense = np.zeros((blocks * BLOCK, len(often)), np.float32)
        for t in often.tolist():
            part = slice(int(self.offset[t]), int(self.offset[t + 1]))
            self.dense[self.post[part], self.leader[t]] = self._weights(self.count[part], t, self.post[part])
        self.peaks = self.dense.reshape(blocks, BLOCK, -1).max(axis=1) if blocks else self.dense
        self.query = np.zeros(len(self.terms))  # a query's weights by term, all 0 between queries
        self.row_at = row_at

    def alone(self) -> Index:
        """The index in a worker, which sends it nowhere: with its derived parts, without the
        postings that they repeat."""
        self.ready().post = self.count = None
        return self

    def _weights(self, n: np.ndarray, term: np.ndarray | int, row: np.ndarray) -> np.ndarray:
        """Weights of terms that rows hold n times."""
        return (self.frequency[n] * self.idf[term] / self.length[row]).astype(np.float32)

    @property
    def row_weight(self) -> np.ndarray:
        """Weights in the order of ``row_term``."""
        return self._weights(self.row_count, self.row_term, np.repeat(np.arange(len(self.ids)), np.diff(self.row_at)))

    def vector(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of hashed terms and counts: (term numbers, weights of the examples'
        terms); empty if there are none."""
        order = np.argsort(h)  # ascending needles are found faster
        h, n = h[order], n[order]
        t = np.searchsorted(self.terms, h)
        known = np.zeros(len(h), bool)
        inside = t < len(self.terms)
        known[inside] = self.terms[t[inside]] == h[inside]
        w = _frequency(n)
        w[known] *= self.idf[t[known]]
        w[~known] *= self.unseen
        w /= np.sqrt((w * w).sum()) or 1.0
        return t[known], w[known]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine above 0 and their cosines,
        exactly, ties by row, without its row of ``skips``."""
        n, blocks = len(queries), -(-len(self.ids) // BLOCK)
        if not blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        self.ready()
        before = self.blocks_read
        out = self._best(queries[:PROBE], k, *self._pruned(queries[:PROBE], k, skips and skips[:PROBE]))
        if n > PROBE:
            way = self._whole if blocks >= MANY and self.blocks_read - before > OPEN * PROBE * blocks else self._pruned
            out += self._best(queries[PROBE:], k, *way(queries[PROBE:], k, skips and skips[PROBE:]))
        return out

    def _best(self, queries: list, k: int, sums: np.ndarray, cut: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best rows of each query, from their sums and a sum that the k best reach."""
        out = []
        for d, (t, w) in enumerate(queries):
            rows = np.flatnonzero(sums[d] > max(float(cut[d]) - 2 * ROUNDING, 0.0))
            if len(rows) > 2 * k:
                near = sums[d, rows]
                rows = rows[near >= np.partition(near, -k)[-k] - 2 * ROUNDING]
            cos = self._cosines(rows, t, w)
            best = np.lexsort((rows, -np.round(cos, 12)))[:k]
            out.append((rows[best], cos[best]))
        return out

    def _whole(self, queries: list, k: int, skips: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all rows of all blocks, and a sum that the k best reach."""
        n, rows = len(queries), len(self.dense)
        lead = np.zeros((n, self.dense.shape[1]), np.float32)
        for d, (t, w) in enumerate(queries):
            column = self.leader[t]
            lead[d, column[column >= 0]] = w[column >= 0]
        sums = lead @ self.dense.T
        for d, (t, w) in enumerate(queries):
            t, w = t[self.leader[t] < 0], w[self.leader[t] < 0]
            lo, hi = self.entry_post[self.term_entry[t]], self.entry_post[self.term_entry[t + 1]]
            parts = list(map(slice, lo.tolist(), hi.tolist()))
            if parts:
                place, weight = (np.concatenate([x[p] for p in parts]) for x in (self.block_post, self.weight))
                weight *= np.repeat(w.astype(np.float32), hi - lo)
                sums[d] += np.bincount(place, weight, rows)
            if skips is not None and skips[d] >= 0:
                sums[d, skips[d]] = 0.0
        self.blocks_read += n * (rows // BLOCK)
        self.blocks_seen += n * (rows // BLOCK)
        strips = sums.reshape(n, -1, STRIP).max(axis=2)
        return sums, np.partition(strips, -k, axis=1)[:, -k].astype(np.float64) if strips.shape[1] > k else np.zeros(n)

    def _pruned(self, queries: list, k: int, skips: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the rows of the blocks that the bounds open, and a sum that the k best reach."""
        n, blocks = len(queries), len(self.dense) // BLOCK
        lead = np.zeros((self.dense.shape[1], n), np.float32)
        entries = []
        for d, (t, w) in enumerate(queries):
            column = self.leader[t]
            lead[column[column >= 0], d] = w[column >= 0]
            t, w = t[column < 0], w[column < 0]
            lo, hi = self.term_entry[t], self.term_entry[t + 1]
            entry = _ranges(lo, hi)
            entries.append((entry, np.repeat(w, hi - lo), self.entry_block[entry]))
        bound = (self.peaks @ lead).T.astype(np.float64)
        for d, (entry, q, at) in enumerate(entries):
            bound[d] += np.bincount(at, q * self.entry_peak[entry], blocks)
        some = bound > 0
        bound = bound * (1 + ROUNDING) + ROUNDING  # sums of 32-bit products
        first = np.zeros((n, blocks), bool)
        top = np.argpartition(-bound, FIRST, axis=1)[:, :FIRST] if blocks > FIRST else np.broadcast_to(np.arange(blocks), (n, blocks))
        np.put_along_axis(first, top, True, axis=1)
        sums = np.zeros((n, blocks * BLOCK), np.float32)
        self._read(sums, first, entries, lead, skips)
        opened = np.take_along_axis(sums.reshape(n, blocks, BLOCK), top[:, :, None], axis=1).reshape(n, -1)
        cut = np.partition(opened, -k, axis=1)[:, -k].astype(np.float64) if opened.shape[1] > k else np.zeros(n)
        more = some & ~first & (bound >= cut[:, None] - ROUNDING)
        self.blocks_read += int(first.sum() + more.sum())
        self.blocks_seen += n * blocks
        self._read(sums, more, entries, lead, skips)
        return sums, cut

    def _read(self, sums: np.ndarray, use: np.ndarray, entries: list, lead: np.ndarray, skips: list[int] | None) -> None:
        """Add the sums of products of the rows in the used (query, block) pairs."""
        for b in np.flatnonzero(use.any(axis=0)):
            d = np.flatnonzero(use[:, b])
            sums[d, b * BLOCK : (b + 1) * BLOCK] = (self.dense[b * BLOCK : (b + 1) * BLOCK] @ lead[:, d]).T
        for d, (entry, q, at) in enumerate(entries):
            open_ = use[d][at]
            entry, q = entry[open_], q[open_]
            lo, hi = self.entry_post[entry], self.entry_post[entry + 1]
            place = _ranges(lo, hi)
            if len(place):
                sums[d] += np.bincount(self.block_post[place], np.repeat(q, hi - lo) * self.weight[place], sums.shape[1])
            if skips is not None and skips[d] >= 0:
                sums[d, skips[d]] = 0.0

    def _cosines(self, rows: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of some rows in double precision, from their own terms."""
        if not len(rows):
            return np.zeros(0)
        lo, hi = self.row_at[rows], self.row_at[rows + 1]
        place = _ranges(lo, hi)
        self.query[t] = w
        term = self.row_term[place]
        weight = self._weights(self.row_count[place], term, np.repeat(rows, hi - lo))
        out = np.add.reduceat(self.query[term] * weight, np.cumsum(hi - lo) - (hi - lo))
        self.query[t] = 0.0
        return out

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic neighbours weighted by inverse distance, held to the base rate by
        one neighbour's weight at distance one half."""
        w = 1.0 / (1.05 - np.minimum(cos, 1.0))
        prior = 1.0 / 0.55
        return float((w @ self.toxic[rows] + prior * self.base) / (w.sum() + prior))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))

    def score(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, evidence rows and their cosines of each text."""
        found = self.nearest([self.vector(*x) for x in tallied(texts)])
        return [(self.calibrated(self.vote(rows, cos)) if len(rows) else self.blank, rows[:EVIDENCE], cos[:EVIDENCE]) for rows, cos in found]


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: knots of a rising map."""
    order = np.argsort(x, kind="stable")
    groups: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        groups.append([xi, yi, 1.0])
        while len(groups) > 1 and (groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2] or groups[-2][0] == groups[-1][0]):
            b = groups.pop()
            groups[-1] = [(groups[-1][0] * groups[-1][2] + b[0] * b[2]) / (groups[-1][2] + b[2]), groups[-1][1] + b[1], groups[-1][2] + b[2]]
    return np.array([g[0] for g in groups]), np.array([(g[1] + 0.5 * len(groups) / max(len(x), 1)) / (g[2] + len(groups) / max(len(x), 1)) for g in groups])


def _g2(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio of a term's document frequencies a of na and b of nb."""

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    n, have = na + nb, a + b
    return 2.0 * (part(a, have * na / n) + part(b, have * nb / n) + part(na - a, (n - have) * na / n) + part(nb - b, (n - have) * nb / n))


def relevance(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Weights from 1 up: 1 + G2 of a term that a of na toxic and b of nb other examples
    hold where it is more frequent among the toxic ones, 1 elsewhere."""
    if not na or not nb:
        return np.ones(len(a))
    return 1.0 + np.where(a * nb > b * na, np.maximum(_g2(a, b, na, nb), 0.0), 0.0)


def build_index(examples: Iterable[tuple[int, int, Counter]], df: dict[str, int], n_docs: int) -> Index:
    """``examples``: (id, toxic, term counts over the terms of ``df``); ``df``: document
    frequency of the terms over all documents."""
    names = hashed(df)
    order = np.argsort(names)
    names, counts = names[order], np.array(list(df.values()), np.float64)[order]
    examples = list(examples)
    row = np.repeat(np.arange(len(examples)), [len(c) for _, _, c in examples])
    term = np.searchsorted(names, hashed(s for _, _, c in examples for s in c))
    n = np.array([x for _, _, c in examples for x in c.values()], np.int64)
    return _index(np.array([i for i, _, _ in examples], np.int64), np.array([y for _, y, _ in examples], np.int64), row, term.astype(np.int32), n, names, counts, n_docs)


def _order(row: np.ndarray, term: np.ndarray, size: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Places of the examples in the index: by the commonest terms that they hold (texts of
    one language hold the same ones), then by the number of their terms, so that a block's
    largest weights are close to all its weights."""
    held = np.zeros((len(size), LEADERS), np.float32)
    for lo in range(0, len(term), CHUNK):
        column, r = leader[term[lo : lo + CHUNK]], row[lo : lo + CHUNK]
        held[r[column >= 0], column[column >= 0]] = 1
    # Two rounds of assigning each example to the nearer of a few mean leader vectors.
    group = np.zeros(len(size), np.int64)
    if len(size) > GROUPS:
        centre = held[np.linspace(0, len(size) - 1, GROUPS).astype(np.int64)]
        for _ in range(8):
            unit = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
            group = np.argmax(held @ unit.T, axis=1)
            for g in range(GROUPS):
                some = np.flatnonzero(group == g)
                if len(some):
                    total = sum(held[some[lo : lo + FEW]].sum(axis=0) for lo in range(0, len(some), FEW))  # whole numbers
                    centre[g] = total / np.float32(len(some))
    return np.lexsort((np.arange(len(size)), size, group))


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 up in the least bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _index(ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, n: np.ndarray, names: np.ndarray, df: np.ndarray, n_docs: int) -> Index:
    """From the examples' (id, toxic) and their (row, term, count)."""
    # The driver holds few arrays of all postings at once.
    a, b = np.zeros((2, len(names)), np.int64)
    for lo in range(0, len(term), CHUNK):
        part = slice(lo, lo + CHUNK)
        b += np.bincount(term[part], minlength=len(names))
        a += np.bincount(term[part][toxic.astype(bool)[row[part]]], minlength=len(names))
    b -= a
    idf = (np.log((1.0 + n_docs) / (1.0 + df)) + 1.0) * relevance(a, b, int(toxic.sum()), int((1 - toxic).sum()))
    length = np.zeros(len(ids))
    for lo in range(0, len(term), CHUNK):
        part = slice(lo, lo + CHUNK)
        length += np.bincount(row[part], (_frequency(n[part]) * idf[term[part]]) ** 2, len(ids))
    length = np.sqrt(length)
    base = float((toxic.sum() + 0.5) / (len(ids) + 1.0)) if len(ids) else 0.0
    size = np.bincount(row, None, len(ids))
    full = size > 0
    blank = float((toxic[~full].sum() + base) / ((~full).sum() + 1.0))
    leader = np.full(len(names), -1, np.int32)
    often = np.argsort(-(a + b), kind="stable")[:LEADERS]
    leader[often] = np.arange(len(often))
    order = _order(row, term, size, leader)
    order = order[full[order]]
    place = np.zeros(len(ids), np.int32)
    place[order] = np.arange(len(order))
    offset = np.concatenate([[0], np.cumsum(a + b)])
    place, n = _small(place), _small(n)
    post, count = np.empty(len(term), place.dtype), np.empty(len(term), n.dtype)
    first = 0
    while first < len(names):  # by term and row, the postings of some terms at a time
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + CHUNK, "right")) - 1)
        some = np.flatnonzero((term >= first) & (term < last))
        some = some[np.lexsort((place[row[some]], term[some]))]
        part = slice(int(offset[first]), int(offset[last]))
        post[part], count[part] = place[row[some]], n[some]
        first = last
    unseen = float(np.log((1.0 + n_docs) / 2.0) + 1.0)
    return Index(names, idf, unseen, ids[order], toxic[order].astype(np.float64), length[order], offset, post, count, base, blank, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))


# ------------------------------------------------------------------ Spark


def training_rows(labels: DataFrame, label: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """Labelled ids outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    return labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null and crc32(cast(cast(id as string) as binary)) % 5 <> 0").groupBy("id").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES) -> Index:
    """Learn from ``labelled`` (id, y).  The driver gets the examples' term counts, at most
    ``max_examples`` of them; document frequencies are a grouped sum over all ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    pick = labelled.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_examples)
    pick = F.broadcast(stored(pick.select("id", "y"), "examples"))  # at most max_examples rows

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [counted(t.as_py()) for t in b.column(2)]
            at = np.concatenate([[0], np.cumsum([len(h) for h, _ in c])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([x[k] for x in c]) if c else np.zeros(0, np.int64), kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["id", "y", "terms", "n"])

    seen = rows.join(pick, "id").select("id", "y", "text").mapInArrow(tidy(listed), "id long, y int, terms array<long>, n array<int>")
    run = Window.orderBy(F.xxhash64("id"), "id", F.xxhash64("terms", "n")).rowsBetween(Window.unboundedPreceding, 0)  # sizes of at most max_examples ids
    seen = stored(seen.withColumn("key", F.xxhash64("terms", "n")), "terms")
    upto = seen.select("id", "key", F.sum(F.size("terms").cast("long")).over(run).alias("held")).where(F.col("held") <= MAX_POSTINGS)
    seen = stored(seen.join(F.broadcast(upto.select("id", "key").distinct()), ["id", "key"]), "examples")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(b.column(0).flatten().to_numpy()))], ["term"])

    names = np.sort(seen.select("terms").mapInArrow(tidy(distinct), "term long").distinct().toArrow()["term"].to_numpy())  # a row per term of the examples
    vocabulary = spark.sparkContext.broadcast(names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            terms = [np.searchsorted(known, x.values.to_numpy()).astype("<i4").tobytes() for x in b.column(2)]
            n = [_small(x.values.to_numpy()).tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.binary()), pa.array(n, pa.binary())], ["id", "y", "terms", "n"])

    # At most MAX_POSTINGS terms, as numbers and a partition at a time.
    ids, toxic, terms, counts = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
    for r in seen.select("id", "y", "terms", "n", "key").orderBy("id", "key").drop("key").mapInArrow(tidy(numbered), "id long, y int, terms binary, n binary").toLocalIterator():
        ids.append(r["id"])
        toxic.append(r["y"])
        terms.append(np.frombuffer(r["terms"], "<i4"))
        counts.append(np.frombuffer(r["n"], f"u{max(1, len(r['n']) // max(1, len(terms[-1])))}"))
    ids, toxic = np.array(ids, np.int64), np.array(toxic, np.int64)
    sizes = np.array([len(t) for t in terms[1:]], np.int64)
    term, counts = np.concatenate(terms), np.concatenate(counts)
    del terms
    give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total, n = np.zeros(len(known), np.int64), 0
        for b in batches:
            n += b.num_rows
            for lo in range(0, b.num_rows, 256):
                h = np.sort(np.concatenate([h for h, _ in tallied(b.column(0).slice(lo, 256).to_pylist())]))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    total += np.bincount(at[known[at] == h], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(n, total[some]))], ["t", "n"])

    found = rows.select("text").mapInArrow(tidy(count), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the examples
    df, n_docs, at = np.zeros(len(names)), 0, found["t"].to_numpy()
    if len(at):
        df[at[at >= 0]] = found["n"].to_numpy()[at >= 0]
        n_docs = int(found["n"].to_numpy()[at < 0].sum())
    row = np.repeat(_small(np.arange(len(sizes))), sizes)
    index = _index(ids, toxic, row, term, counts, names, df, n_docs)
    del row, term, counts, found
    give_back()
    index.sent = model = spark.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = model.value.alone()
        at = {i: r for r, i in enumerate(ix.ids.tolist())}
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, TOGETHER):
                ids, y, h, n = (b.column(c).slice(lo, TOGETHER) for c in range(4))
                vectors = [ix.vector(x.values.to_numpy(), m.values.to_numpy(zero_copy_only=False)) for x, m in zip(h, n)]
                found = ix.nearest(vectors, skips=[at.get(i, -1) for i in ids.to_pylist()])
                out += [(ix.vote(*f), float(v)) for f, v in zip(found, y.to_pylist()) if len(f[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.float64()) for c in (0, 1)], ["vote", "y"])

    voted = seen.select("id", "y", "terms", "n").repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(tidy(votes), "vote double, y double").toPandas()  # at most a row per example
    voted = voted.sort_values(["vote", "y"])
    if len(voted):
        index.knots = _rising(voted["vote"].to_numpy(), voted["y"].to_numpy())
    return index


def judge(docs: DataFrame, index: Index, text: str = "text") -> Column:
    """A column struct(score, evidence ids, evidence cosines) for each row of ``docs``."""
    model = index.sent or docs.sparkSession.sparkContext.broadcast(index)
    knots = index.knots  # fitted after the index was sent

    @arrow_udf("score double, evidence array<long>, cosines array<double>")
    @tidy
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ix = model.value.alone()
        ix.knots = knots
        known: dict[bytes, tuple] = {}  # scores of this task's texts, for copies
        for s in batches:
            got = []
            for lo in range(0, len(s), SLICE):  # so that few texts are Python strings at once
                texts = s.slice(lo, SLICE).to_pylist()
                keys = [xxhash.xxh3_128_digest(t or "") for t in texts]
                fresh = {k: t for k, t in zip(keys, texts) if k not in known}
                if len(known) + len(fresh) > REMEMBERED:
                    known.clear()
                    fresh = dict(zip(keys, texts))
                for at in range(0, len(fresh), TOGETHER):
                    part = list(fresh)[at : at + TOGETHER]
                    known.update(zip(part, ix.score([fresh[k] for k in part])))
                got += [known[k] for k in keys]
            lists = [pa.array([x.tolist() for x in c], pa.list_(kind)) for c, kind in (([ix.ids[g[1]] for g in got], pa.int64()), ([g[2] for g in got], pa.float64()))]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), *lists], ["score", "evidence", "cosines"])

    return scored(F.col(text))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, evidence (nearest
    examples' ids) and cosines."""
    index = fit(docs, training_rows(labels, id_col=id_col), text, id_col, max_examples)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("v", judge(docs, index))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("v.score").alias("score"),
        (F.col("v.score") >= 0.5).cast("int").alias("predicted"),
        F.col("v.evidence").alias("evidence"),
        F.col("v.cosines").alias("cosines"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is under one half, with their columns."""
    index = fit(docs, training_rows(labels), text, id_col)
    v = temp_name(docs, "toxicity")
    return docs.withColumn(v, judge(docs, index, text)).where(F.col(f"`{v}`.score") < 0.5).drop(v)


assert MAX_EXAMPLES <= BROADCAST_ROWS
