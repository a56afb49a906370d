"""Which tokens of two tokenizers cover the same bytes of a text.

Each text is encoded by a byte-level BPE file (A, of space + text) and a sentencepiece model
(B, which puts the space there itself); strings of special tokens are plain text.  The tokens'
own bytes, laid end to end, give every token its byte range.  Documents of a batch are laid
one after another, so a byte position says which document it is in, and two ``merge_asof``
joins find, for every token start of one side, the token of the other side that covers it:

* the union of both directions is the table of overlapping token pairs (``overlaps``);
* a token that starts where its covering token starts begins a group, on either side: groups
  are the shortest runs of A and B tokens with the same bytes;
* the last tokens of a group end together: a link.

``summary`` counts links by id pair over the whole corpus (summed by task, then by pair) and
compares them with the highest count of the pair's B id.  The ``HOT`` most frequent pairs, by
count classes, are broadcast as sorted arrays and looked up where the documents lie; the other
pairs, each of which is rare, are joined by a shuffle.  Both ways give the same sums at any
size, and no pair has enough rows left to skew the join.

Texts that are null, empty or that either side does not give back byte by byte have no
tokens: counts are 0, the lists empty, the digest of the groups ''.  Repeated rows and ids
(also null ids) are documents of their own, each with its links.  An empty table gives no rows.
Memory in a task is bounded by one batch of ``CHUNK`` bytes or one text; joins go in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Ids, tokenizer_path
from .common import small, stored

#: Bytes of text aligned together (or one longer text), and tokens of one join.
CHUNK = 1 << 19
SLICE = 1 << 20
#: Most pairs that are broadcast, and classes of counts for each doubling.
HOT = 1 << 20
CLASSES = 8
#: Pairs gathered in a task before they are summed.
GATHERED = 1 << 21
#: Ids are below this; a pair is a * ID + b.
ID = 1 << 20


class _Plain(Ids):
    """Ids with the strings of special tokens as plain text."""

    _loaded: dict[str, _Plain] = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.lib.encode_special_tokens = True
        self.special = lambda text: None


class Sides:
    """Both tokenizers with the bytes of their tokens; one per Python worker."""

    _loaded: dict[tuple[str, str], Sides] = {}

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = _Plain.load(tokenizer_path(a))
        byte = {c: k for k, c in self.a.letters.items()}
        vocab = sorted(self.a.lib.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (vocab[-1][1] + 1)
        for token, i in vocab:
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Decimal ids with what follows them in the groups' text: [2 * id + last of its group].
        self.a_text = np.array([f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"], "S8")
        self.b_text = np.array([f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;"], "S8")

    @classmethod
    def load(cls, a: str, b: str) -> Sides:
        if (a, b) not in cls._loaded:
            cls._loaded[a, b] = cls(a, b)
        return cls._loaded[a, b]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where the bytes differ from those of space + text."""
        if text:
            a, b, whole = np.frombuffer(self.a.of(" " + text), "<u4").astype(np.int64), self.b.encode(text), (" " + text).encode()
            if b"".join([self.b_bytes[i] for i in b]) == whole and b"".join([self.a_bytes[i] for i in a.tolist()]) == whole:
                return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def covering(starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For every start the index of the last of ``other``'s starts at or before it, both
    ascending: the token that covers it."""
    out = []
    for lo in range(0, len(starts), SLICE):
        mine = starts[lo : lo + SLICE]
        first, last = np.searchsorted(other, [mine[0], mine[-1]], "right")
        first = max(int(first) - 1, 0)
        theirs = pd.DataFrame({"at": other[first : int(last)], "k": np.arange(first, int(last))})
        out.append(pd.merge_asof(pd.DataFrame({"at": mine}), theirs, on="at")["k"].to_numpy(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Aligned:
    """Texts of a batch, aligned: ids, token starts, covering tokens and group numbers."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        pairs = [sides.encode(t) for t in texts]
        self.sides = sides
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum([len(p[s]) for p in pairs])]).astype(np.int64) for s in (0, 1))
        self.a, self.b = (np.concatenate([p[s] for p in pairs]) if pairs else np.zeros(0, np.int64) for s in (0, 1))
        self.a_start, self.b_start = (np.cumsum(n) - n for n in (sides.a_len[self.a], sides.b_len[self.b]))
        self.b_of_a, self.a_of_b = covering(self.a_start, self.b_start), covering(self.b_start, self.a_start)
        a_first, b_first = self.b_start[self.b_of_a] == self.a_start, self.a_start[self.a_of_b] == self.b_start
        self.a_group, self.b_group = np.cumsum(a_first) - 1, np.cumsum(b_first) - 1
        self.a_lead, self.b_lead = np.flatnonzero(a_first), np.flatnonzero(b_first)  # the first token of each group
        self.group_at = np.searchsorted(self.a_lead, self.a_at)  # groups before each text

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the last A and the last B token of each group."""
        return self.a[np.append(self.a_lead[1:], len(self.a)) - 1], self.b[np.append(self.b_lead[1:], len(self.b)) - 1]

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens that share bytes, each pair once."""
        again = self.a_start[self.a_of_b] != self.b_start  # equal starts are in the other direction
        x = np.concatenate([np.arange(len(self.a)), self.a_of_b[again]])
        y = np.concatenate([self.b_of_a, np.flatnonzero(again)])
        order = np.lexsort((y, x))
        return x[order], y[order]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        n = len(self.a_lead)
        if not n:
            return [""] * (len(self.a_at) - 1)
        a_last, b_last = (np.append(lead[1:], size) - 1 for lead, size in ((self.a_lead, len(self.a)), (self.b_lead, len(self.b))))
        a_code, b_code = 2 * self.a, 2 * self.b
        a_code[a_last] += 1
        b_code[b_last] += 1
        out = np.empty(len(self.a) + len(self.b), "S8")
        out[np.arange(len(self.a)) + self.b_lead[self.a_group]] = self.sides.a_text[a_code]
        out[np.arange(len(self.b)) + (a_last + 1)[self.b_group]] = self.sides.b_text[b_code]
        at = self.a_at + self.b_at
        return [hashlib.sha256(out[lo:hi].tobytes().translate(None, b"\0")[:-1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch of about ``CHUNK`` bytes of text (a longer text comes alone)."""
    texts, lo, held = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        t = x.as_py()
        if texts and held + len(t or "") > CHUNK:
            yield batch.slice(lo, i - lo), texts
            texts, lo, held = [], i, 0
        texts.append(t)
        held += len(t or "")
    if texts:
        yield batch.slice(lo), texts


def _list(values: np.ndarray, at: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def overlaps(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The alignment itself, per document: a_ids and b_ids, the places (a_place, b_place) of
    the tokens that overlap, and the groups as the places of their first tokens (a_lead,
    b_lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.load(a, b)
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                x = Aligned(sides, texts)
                pa_, pb = x.overlaps()
                over_at = np.searchsorted(pa_, x.a_at)
                doc_a, doc_b = np.repeat(x.a_at[:-1], np.diff(over_at)), np.repeat(x.b_at[:-1], np.diff(over_at))
                per_group = np.diff(x.group_at)
                cols = [(x.a, x.a_at), (x.b, x.b_at), (pa_ - doc_a, over_at), (pb - doc_b, over_at), (x.a_lead - np.repeat(x.a_at[:-1], per_group), x.group_at), (x.b_lead - np.repeat(x.b_at[:-1], per_group), x.group_at)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[_list(v, at, pa.int32()) for v, at in cols]], ["doc_id", "a_ids", "b_ids", "a_place", "b_place", "a_lead", "b_lead"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_place array<int>, b_place array<int>, a_lead array<int>, b_lead array<int>")


_ROW = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _linked(docs: DataFrame, a: str, b: str, text: str, id_col: str) -> DataFrame:
    """Per row of ``docs`` its counts and digest, and its distinct linked pairs: ``la`` and
    ``lb`` with how often each (``times``).  ``uid`` tells rows apart once this is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, sides = TaskContext.get().partitionId() << 40, Sides.load(a, b)
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                x = Aligned(sides, texts)
                n, groups = len(texts), np.diff(x.group_at)
                la, lb = x.links()
                # Pairs of each text once: texts of a chunk are numbered in front of the pair.
                code = np.repeat(np.arange(n, dtype=np.int64), groups)
                order = np.lexsort((lb, la, code))
                code, la, lb = code[order], la[order], lb[order]
                new = np.append(True, (np.diff(code) != 0) | (np.diff(la) != 0) | (np.diff(lb) != 0))[: len(code)]
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(code)))
                at = np.searchsorted(code[first], np.arange(n + 1))
                cols = [pa.array(np.arange(uid, uid + n)), part.column(0), *[pa.array(v.astype(np.int64)) for v in (np.diff(x.a_at), np.diff(x.b_at), groups, groups)], pa.array(x.digests(), pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *[_list(v, at, pa.int32()) for v in (la[first], lb[first], times)]], [*_NAMES, "la", "lb", "times"])
                uid += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _ROW + ", la array<int>, lb array<int>, times array<int>")


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _codes(batch: pa.RecordBatch, la: int, lb: int) -> np.ndarray:
    return batch.column(la).flatten().to_numpy().astype(np.int64) * ID + batch.column(lb).flatten().to_numpy()


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether that is
    the highest count of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sums():
            code, times = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            pair, where = np.unique(code, return_inverse=True)
            n = np.bincount(where, times, len(pair)).astype(np.int64)
            held.clear()
            return [pa.RecordBatch.from_arrays([pa.array(pair[lo : lo + 50_000]), pa.array(n[lo : lo + 50_000])], ["pair", "n"]) for lo in range(0, len(pair), 50_000)]

        for batch in batches:
            held.append((_codes(batch, 0, 1), batch.column(2).flatten().to_numpy().astype(np.int64)))
            size += len(held[-1][0])
            if size >= GATHERED:
                yield from sums()
                size = 0
        if size:
            yield from sums()

    n = stored(linked.select("la", "lb", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(ID - 1)).alias("b")
    top = stored(n.groupBy(b).agg(F.max("n").alias("top")), "tops")  # at most a row per B id
    return stored(n.select("pair", "n", b).join(small(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def _class(n) -> F.Column:
    return F.floor(F.log2(n.cast("double")) * CLASSES).cast("int")


def hot_class(pairs: DataFrame, most: int) -> int:
    """The lowest class of counts from which on there are at most ``most`` pairs."""
    rows = pairs.groupBy(_class(F.col("n")).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect()  # at most 64 * CLASSES rows
    held, low = 0, 64 * CLASSES
    for r in rows:
        held += r["k"]
        if held > most:
            break
        low = r["c"]
    return low


def summary(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", id_col: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    spark = docs.sparkSession
    linked = stored(_linked(docs, a, b, text, id_col), "links")
    pairs = pair_counts(linked)
    cut = hot_class(pairs, hot)
    is_hot = _class(F.col("n")) >= cut
    known = pairs.where(is_hot).toArrow()  # at most ``hot`` rows
    order = np.argsort(known["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy()[order], known["n"].to_numpy()[order], known["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            la, times = batch.column(7), batch.column(9).flatten().to_numpy().astype(np.int64)
            size = la.value_lengths().to_numpy()
            code, doc = _codes(batch, 7, 8), np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pair, code), max(len(pair) - 1, 0))
            hit = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * n[at[hit]])
            cold_at = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sums[0]), pa.array(sums[1]), _list(code[~hit], cold_at, pa.int64()), _list(times[~hit], cold_at, pa.int32())], [*_NAMES, "n_best", "count_sum", "pair", "times"])

    rows = stored(linked.mapInArrow(run, _ROW + ", n_best long, count_sum long, pair array<long>, times array<int>"), "counted")
    cold = rows.select("uid", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("uid", "x.pair", "x.times")
    cold = cold.join(pairs.where(~is_hot), "pair").groupBy("uid").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    out = rows.drop("pair", "times").join(cold, "uid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).cast("long").alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256")
