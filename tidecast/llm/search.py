"""Exact ranked lexical search of a query set over all documents, with norm buckets.

Scores are integers: a term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))), its impact
in a document (10**9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, and a document's score
the sum of w * impact over the query's terms, repeats included.  N counts documents with a
term, L all their terms, n a document's, df the documents that hold a term, tf how often.

As vectors over the terms of the queries, a document has sqrt(w) * impact and a query
repeats * sqrt(w), and the score is their product:

* documents are ordered by length into buckets, longest first, and every query keeps the
  ``k`` best scores found so far; a query whose length times the longest vector of a bucket
  is below its k-th best score skips the bucket (Cauchy-Schwarz);
* inside a bucket a query adds up its heaviest coordinates only, those with ``FOCUS`` of its
  squared length; the rest of a product is at most the product of both rests' lengths, and a
  document whose sum and rest stay below the k-th best score is dropped;
* what survives is scored again in integers over all terms of the query.

Buckets run in ``ROUNDS`` Spark jobs, the longest vectors first, so that later rounds start
from the k-th best scores of the earlier ones; within a round tasks raise them further by
themselves.  Queries go in blocks of at most ``BLOCK`` distinct terms, so what is broadcast
(terms, weights, k-th scores) is bounded by the block, not by the query set.

Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased, of
whole texts.  Null texts and texts without terms count nowhere; queries without terms have
no rows.  Each row of the queries is ranked by itself, also where item ids repeat; each row of
the documents is a document.  Equal scores go by id (null last).  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Most distinct query terms handled at once.
BLOCK = 50_000
#: Shares of the documents, longest vectors first, after which a round ends.
ROUNDS = (1 / 64, 1 / 8, 1.0)
#: Share of a query's squared length that its focus coordinates hold.
FOCUS = 0.8
#: Documents of one bucket.
BUCKET = 4096
#: Relative slack of the floating-point bounds, far above their rounding errors.
SLACK = 1e-9

# Every byte that is no letter, digit or part of a non-ASCII character is a space; A-Z are a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode().translate(_TABLE).split() if text else []


class Queries:
    """A block of queries over one numbered vocabulary."""

    def __init__(self):
        self.items: list = []
        self.counts: list[Counter] = []
        self.vocab: dict[bytes, int] = {}

    def add(self, item, words: list[bytes]) -> None:
        self.items.append(item)
        self.counts.append(Counter(self.vocab.setdefault(w, len(self.vocab)) for w in words))


def blocks(queries: DataFrame, text: str, item: str, most: int = BLOCK) -> Iterator[Queries]:
    """The queries in blocks of at most ``most`` distinct terms (one query may hold more)."""
    block = Queries()
    for r in queries.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = terms(r["t"])
        if block.items and len(block.vocab) + len(set(words) - block.vocab.keys()) > most:
            yield block
            block = Queries()
        if words:
            block.add(r["i"], words)
    if block.items:
        yield block


def _counted(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t, tf) of the documents with a term: the number of all terms, and the
    block's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                rows, t, tf, at = [], [], [], [0]
                for i, x in enumerate(s.column(1)):
                    if words := terms(x.as_py()):
                        found = Counter(map(number, words))
                        found.pop(None, None)
                        rows.append((i, len(words)))
                        t.extend(found)
                        tf.extend(found.values())
                        at.append(len(t))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (t, tf)]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array([i for i, _ in rows], pa.int32())), pa.array([n for _, n in rows], pa.int64()), *lists], ["doc_id", "n", "t", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, t array<int>, tf array<int>")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the block's terms; summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], ["t", "df"])

    df = np.zeros(size, np.int64)
    for r in counted.select("t").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # a row per term of the block
        df[r["t"]] = r["df"]
    return df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Integer impacts of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    return column.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _vectors(counted: DataFrame, w: np.ndarray, n_docs: int, total: int) -> DataFrame:
    """(doc_id, t, impact, length): what has no weighted term of the queries is left out, as
    its score is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, at = _lists(b.column(2))
            tf, _ = _lists(b.column(3))
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            imp = impacts(b.column(1).to_numpy()[doc], tf, n_docs, total)
            use = (w[t] > 0) & (imp > 0)
            t, imp, doc = t[use], imp[use], doc[use]
            square = np.bincount(doc, w[t] * imp.astype(float) ** 2, b.num_rows)
            keep = np.flatnonzero(square)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows)[keep])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (t, imp)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *lists, pa.array(np.sqrt(square[keep]))], ["doc_id", "t", "impact", "length"])

    return counted.mapInArrow(run, "doc_id long, t array<int>, impact array<int>, length double")


class Searcher:
    """A block's queries with the best scores so far; ``bucket`` scores one bucket."""

    def __init__(self, queries: list[Counter], w: np.ndarray, k: int, floor: np.ndarray):
        self.w, self.k = w, k
        root = np.sqrt(w)
        self.t = [np.array(sorted(c, key=lambda t: (-c[t] * root[t], t)), np.int64) for c in queries]
        self.t = [t[w[t] > 0] for t in self.t]
        self.reps = [np.array([c[x] for x in t.tolist()], np.int64) for c, t in zip(queries, self.t)]
        self.q = [r * root[t] for t, r in zip(self.t, self.reps)]
        self.length = np.array([math.sqrt(float(q @ q)) for q in self.q])
        self.focus, self.rest = [], []
        for q in self.q:
            run = np.cumsum(q * q)
            f = int(np.searchsorted(run, FOCUS * run[-1])) + 1 if len(q) else 0
            self.focus.append(f)
            self.rest.append(math.sqrt(max(0.0, float(run[-1] - run[f - 1]))) if f else 0.0)
        self.root = root
        self.whole = np.zeros(len(w), np.int64)  # integer weights of one query at a time
        self.floor = floor.copy()  # the k-th best score of each query so far, 0 if there are fewer
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, doc), at most k
        self.skipped = self.dropped = self.scored = 0

    def bucket(self, ids: list, t: np.ndarray, impact: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """One bucket in rows (ids, their lengths, and terms with impacts from ``at[i]`` on)."""
        n = len(ids)
        top = float(length.max())
        open_ = np.flatnonzero(self.length * top * (1 + SLACK) >= np.maximum(self.floor, 1))
        self.skipped += len(self.length) - len(open_)
        if not len(open_):
            return
        doc = np.repeat(np.arange(n), np.diff(at))
        by_term = np.argsort(t, kind="stable")
        st, sd, si = t[by_term], doc[by_term], impact[by_term]
        sv = si * self.root[st]
        for j in open_.tolist():
            floor = max(int(self.floor[j]), 1)
            f, terms_ = self.focus[j], self.t[j]
            lo, hi = np.searchsorted(st, terms_, "left"), np.searchsorted(st, terms_, "right")
            part, used = np.zeros(n), np.zeros(n)
            for i in range(f):
                a, b = lo[i], hi[i]
                part[sd[a:b]] += self.q[j][i] * sv[a:b]
                used[sd[a:b]] += sv[a:b] ** 2
            bound = part + self.rest[j] * np.sqrt(np.maximum(length * length - used, 0) + SLACK * length * length)
            left = bound * (1 + SLACK) >= floor
            self.dropped += n - int(left.sum())
            rows = np.flatnonzero(left)
            if len(rows):
                self.scored += len(rows)
                self.whole[terms_] = self.reps[j] * self.w[terms_]
                self._keep(j, ids, rows, self._scores(rows, t, impact, at), floor)
                self.whole[terms_] = 0

    def _scores(self, rows: np.ndarray, t: np.ndarray, impact: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Integer scores of some rows of a bucket (each has a term) against ``whole``."""
        size = at[rows + 1] - at[rows]
        start = np.cumsum(size) - size
        place = np.arange(int(size.sum())) + np.repeat(at[rows] - start, size)
        return np.add.reduceat(self.whole[t[place]] * impact[place], start)

    def _keep(self, j: int, ids: list, rows: np.ndarray, score: np.ndarray, floor: int) -> None:
        if len(rows) > self.k:  # the k-th best of the bucket and what equals it
            floor = max(floor, int(np.partition(score, len(rows) - self.k)[len(rows) - self.k]))
        hits = np.flatnonzero(score >= floor)
        order = lambda x: (x[0], x[1] is None, x[1] if x[1] is not None else 0)
        self.best[j] = sorted([*self.best[j], *((-int(score[h]), ids[rows[h]]) for h in hits.tolist())], key=order)[: self.k]
        if len(self.best[j]) == self.k:
            self.floor[j] = max(self.floor[j], -self.best[j][-1][0])


def _search(vectors: DataFrame, block: Queries, w: np.ndarray, k: int, floor: np.ndarray) -> DataFrame:
    """(q, doc_id, score): the k best of every task whose score reaches the query's floor."""
    shared = vectors.sparkSession.sparkContext.broadcast((block.counts, w, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Searcher(*shared.value[:2], k, shared.value[2])
        for b in batches:
            for lo in range(0, b.num_rows, BUCKET):
                x = b.slice(lo, BUCKET)
                t, at = _lists(x.column(1))
                s.bucket(x.column(0).to_pylist(), t, _lists(x.column(2))[0], at, x.column(3).to_numpy())
        rows = [(j, i, -c) for j, best in enumerate(s.best) for c, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    return vectors.mapInArrow(run, "q int, doc_id long, score long")


def _best(rows: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """The k best rows of each query with their rank; first within parts of a query, so no
    group grows with the number of tasks alone."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("q", "salt").orderBy(*order)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    whole = Window.partitionBy("q").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("salt")


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", id_col: str = "doc_id", item: str = "item_id", query: str = "text") -> DataFrame:
    """The ``k`` best documents of every query with a score above 0: item, rank, doc_id,
    score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = queries.schema[item].dataType.simpleString()
    out = spark.createDataFrame([], f"{item} {kind}, rank int, doc_id long, score long")
    for block in blocks(queries, query, item):
        counted = stored(_counted(rows, block.vocab), "terms")
        n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        w = weights(n_docs, _frequencies(counted, len(block.vocab)))
        vectors = stored(_vectors(counted, w, n_docs, total), "vectors")
        # Cuts between rounds by length, and within a round partitions by length, longest first;
        # the hash spreads copies, whose lengths are equal.
        cuts = [float("inf"), *(vectors.approxQuantile("length", [1 - p for p in ROUNDS[:-1]], 0.002) or [0.0] * (len(ROUNDS) - 1)), 0.0]
        floor, found = np.zeros(len(block.items), np.int64), None
        for high, low in zip(cuts, cuts[1:]):
            part = vectors.where((F.col("length") < high) & (F.col("length") >= low))
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            part = part.repartitionByRange(n, F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"))
            hits = _search(part, block, w, k, floor)
            found = stored(_best(hits if found is None else hits.unionByName(found.drop("rank")), k), "best")
            for r in found.where(F.col("rank") == k).select("q", "score").collect():  # a row per query of the block
                floor[r["q"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(block.items)), f"q int, {item} {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "q").select(item, F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
