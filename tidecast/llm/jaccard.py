"""Exact Jaccard similarity join of documents on word n-grams, by vertical partitioning.

The distinct n-grams of the corpus get one global order, rare ones first; the order is cut
into ``FRAGMENTS`` consecutive fragments of equal mass.  A candidate pair's overlap is
counted in every fragment by itself and the partial counts are summed per pair.

1. *Order.*  A counting sketch of all n-gram occurrences (fixed size, summed over all
   rows) gives each n-gram a frequency class; the order is (class, hash).  Any global
   order gives the same result; this one keeps frequent passages out of step 2.
2. *Candidates.*  Two sets of Jaccard >= t share n-grams among the first n - ceil(t n) + 1
   of each, and at least as many as :func:`_least` works out.  Only those prefixes are
   shuffled, as (n-gram, document) rows.
3. *Stars first.*  In each n-gram's bucket every member is compared with one centre.  Copies
   of one text are then one component, and only pairs of a bucket that lie in different
   components are compared after that, so a group of many copies costs a line, not a square,
   and no link that could join two components is left out.
4. *Verification.*  Fragments of the documents in candidate pairs are joined per pair and
   fragment, overlaps summed, and the threshold tested in whole numbers.

Equal sets are one class, known by a 128-bit digest.  Components come from
:func:`common.components`.

Null, empty and blank texts have the empty set and link with nothing.  Repeated rows are
copies of each other; rows that share an id but not a text count as one document that has
the links of all of them.  Rows without id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bit_filter, components, in_filter, mix64, small, stored, temp_name, tidy
from .shingles import shingle_sets

SKETCH = 1 << 20  # counters
SLICE = 1 << 14  # counters per row while they are summed
FRAGMENTS = 8
OFTEN = 8  # prefixes that hold an n-gram before it is put last in the order
#: The first comparison, with one centre per n-gram, takes pairs that share this part of what
#: they must (they may share the rest under other centres); the second takes the bound itself.
STAR_SHARE = 4


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & np.uint64(SKETCH - 1)).astype(np.int64)


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


class Order:
    """The global order: a frequency class per sketch counter, and the fragment cuts."""

    def __init__(self, counts: np.ndarray):
        self.level = np.zeros(SKETCH, np.uint8)
        some = counts > 0
        # Classes of half powers of two; counters near the common load of the sketch share one.
        usual = max(1.0, float(np.median(counts)))
        self.level[some] = np.clip(np.ceil(2 * np.log2(np.maximum(counts[some] / (1.5 * usual), 1.0))), 0, 255).astype(np.uint8)
        self.alone = counts <= 1
        self.often: np.ndarray | None = None  # bit filter of n-grams put last, see _linked
        mass = np.bincount(self.level, weights=counts, minlength=256)
        self.before = np.concatenate([[0.0], np.cumsum(mass)]) / max(mass.sum(), 1.0)

    def sort(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in the global order, their fragments, and which may occur elsewhere too."""
        slot = _slot(h)
        level = self.level[slot]
        if self.often is not None:
            level = np.where(in_filter(self.often, h.view(np.int64)), np.uint8(255), level)
        order = np.argsort(level, kind="stable")  # h comes sorted
        h, level = h[order], level[order]
        place = self.before[level] + (self.before[level + 1] - self.before[level]) * (h.astype(np.float64) / 2.0**64)
        return h, np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1), ~self.alone[slot][order]


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """One pass: (id, n, digest) per row, and per partition the sketch in slices (at, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sketch = np.zeros(SKETCH, np.int64)
        for b in batches:
            sizes, digests, held = [], [], []
            for h in shingle_sets(b.column(1), k):
                sizes.append(len(h))
                digests.append(_digest(h) if len(h) else None)
                held.append(h)
                if len(held) >= 500:
                    sketch += np.bincount(_slot(np.concatenate(held)), minlength=SKETCH)
                    held = []
            if held:
                sketch += np.bincount(_slot(np.concatenate(held)), minlength=SKETCH)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["id", "n", "digest", "part", "at", "counts"])
        rows = [(i, sketch[i : i + SLICE]) for i in range(0, SKETCH, SLICE)]
        rows = [(i, s.astype("<i8").tobytes()) for i, s in rows if s.any()]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([part] * n, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["id", "n", "digest", "part", "at", "counts"])

    return stored(docs.mapInArrow(tidy(run), "id long, n long, digest binary, part long, at long, counts binary"), "profile")


def _order(profile: DataFrame) -> Order:
    """Sum the sketch slices, 64 partitions at a time and then those; the driver gets one sketch."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, "<i8")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "at": [int(pdf["at"].iloc[0])], "counts": [total.tobytes()]})

    s = profile.where("at is not null").select("part", "at", "counts")
    for shift in (6, 6, 63):
        s = s.withColumn("part", F.shiftright("part", shift)).groupBy("part", "at").applyInPandas(merge, "part long, at long, counts binary")
    counts = np.zeros(SKETCH, np.int64)
    for r in s.collect():
        counts[r["at"] : r["at"] + SLICE] = np.frombuffer(r["counts"], "<i8")
    return Order(counts)


def _prefixes(docs: DataFrame, order, copied, k: int, percent: int) -> DataFrame:
    """(token, id, n, pos, again): the first n - ceil(t n) + 1 n-grams of each document in the
    global order, without those that occur once in the corpus; of copies in a partition, one.
    again: the document may have copies, by the bit filter ``copied``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        o = order.value
        for b in batches:
            ids = b.column(0).to_pylist()
            got: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            for i, h in zip(ids, shingle_sets(b.column(1), k)):
                if not len(h) or (d := _digest(h)) in seen:
                    continue
                seen.add(d)
                n = len(h)
                p = n - -(-percent * n // 100) + 1
                h, _, shared = o.sort(h)
                pos = np.flatnonzero(shared[:p])
                got.append((h[pos].view(np.int64), i, n, pos))
            if got:
                m, own = [len(g[0]) for g in got], np.array([g[1] for g in got], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g[0] for g in got])), pa.array(np.repeat(own, m)), pa.array(np.repeat(np.array([g[2] for g in got], np.int32), m)), pa.array(np.concatenate([g[3] for g in got]).astype(np.int32)), pa.array(np.repeat(in_filter(copied.value, own), m))],
                    ["token", "id", "n", "pos", "again"],
                )

    return stored(docs.mapInArrow(tidy(run), "token long, id long, n int, pos int, again boolean"), "prefix")


def _least(percent: int, a: str, b: str) -> F.Column:
    """How many prefix n-grams two sets of sizes ``a`` and ``b`` share at least if they reach
    the threshold; null for sizes that cannot.

    They share at least o = ceil(t (a + b) / (1 + t)) n-grams, so at most size - o of a set
    are not shared, and the j-th shared one stands at most at place size - o + j of the set.
    Both prefixes therefore hold the first min over both sets of prefix - (size - o)."""
    total, most = F.col(a).cast("long") + F.col(b), F.greatest(a, b).cast("long")
    least = F.ceil(total * percent / F.lit(100 + percent)) - F.ceil(most * percent / F.lit(100)) + 1
    return F.when(F.least(a, b).cast("long") * 100 >= most * percent, least)


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, c) of ``met`` (xid, xn, yid, yn), and how often each was met."""
    x = F.col("xid") < F.col("yid")
    p = met.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b"), F.when(x, F.col("xn")).otherwise(F.col("yn")).cast("long").alias("na"), F.when(x, F.col("yn")).otherwise(F.col("xn")).cast("long").alias("nb"))
    return p.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


def _sharing(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share as many n-grams as the threshold implies.  A list holds
    the shared n-grams of one prefix."""
    lists = stored(members.groupBy("id").agg(F.collect_list("token").alias("tokens")), "lists")
    both = pairs.join(lists.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(lists.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= _least(percent, "na", "nb")).select("a", "b", "na", "nb")


def _links(docs: DataFrame, pairs: DataFrame, order, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold: overlaps per fragment, summed.  Of a
    pair the document with more pairs is the hub; the fragments of the other, the leaf, go to it."""
    pairs = stored(pairs, "pairs")
    degree = small(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")), "degrees"))
    pairs = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    pairs = stored(pairs.select("a", "b", "na", "nb", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf")), "pairs")
    hubs, leaves = (docs.sparkSession.sparkContext.broadcast(bit_filter(pairs, c)) for c in ("hub", "leaf"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hub, leaf = in_filter(hubs.value, ids), in_filter(leaves.value, ids)
            b = b.filter(pa.array(hub | leaf))
            place, frags, segs = [], [], []

            def made(hub=hub[hub | leaf], leaf=leaf[hub | leaf], ids=ids[hub | leaf]):
                at = np.array(place, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(frags, pa.int32()), pa.array(segs, pa.binary()), pa.array(hub[at]), pa.array(leaf[at])], ["id", "f", "seg", "at_hub", "at_leaf"])

            for i, h in enumerate(shingle_sets(b.column(1), k)):
                h, f, _ = o.sort(h)
                for x in np.unique(f):
                    place.append(i)
                    frags.append(x)
                    segs.append(np.sort(h[f == x]).tobytes())
                if len(place) > 2000:
                    yield made()
                    place, frags, segs = [], [], []
            yield made()

    segs = stored(docs.mapInArrow(tidy(cut), "id long, f int, seg binary, at_hub boolean, at_leaf boolean"), "segments")
    sent = segs.where("at_leaf").select(F.col("id").alias("leaf"), "f", F.col("seg").alias("sa")).join(small(pairs), "leaf")
    both = sent.join(segs.where("at_hub").select(F.col("id").alias("hub"), "f", F.col("seg").alias("sb")), ["hub", "f"])

    @pandas_udf("long")
    def shared(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = np.empty(len(sa), np.int64)
        for i, (x, y) in enumerate(zip(sa, sb)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            out[i] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        return pd.Series(out)

    partial = both.select("a", "b", "na", "nb", "f", shared("sa", "sb").alias("o")).groupBy("a", "b", "na", "nb", "f").agg(F.max("o").alias("o"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return stored(whole.where((100 * F.col("o")) >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b").distinct(), "links")


def _members(copied: DataFrame, prefix: DataFrame) -> DataFrame:
    """(token, id, n, pos, s, r) of the n-grams that several prefixes hold, by class
    representative; s: how many a prefix has, r: which of them this is.  A bit filter drops the bulk of the prefixes, n-grams of one document,
    before the exact join.  Only prefixes that may be of ``copied`` rows (id, rep) are sent to
    their representatives and merged; the others stand for themselves."""
    shared = stored(prefix.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "shared")
    bits = prefix.sparkSession.sparkContext.broadcast(bit_filter(shared, "token"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(bits.value, b.column(0).to_numpy())))

    def met(again: bool) -> DataFrame:
        rows = prefix.where(F.col("again") == again).select("token", "id", "n", "pos")
        return rows.mapInArrow(tidy(some), "token long, id long, n int, pos int").join(shared, "token")

    merged = met(True).join(small(copied), "id", "left").withColumn("rep", F.coalesce("rep", "id")).groupBy("rep", "token", "n").agg(F.min("pos").alias("pos"))
    got = met(False).unionByName(merged.withColumnRenamed("rep", "id"))
    own = Window.partitionBy("id")  # the shared n-grams of one prefix
    return stored(got.withColumn("s", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("pos", "token"))), "members")


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, rep) per row, and the links between class representatives that matter."""
    spark = docs.sparkSession
    profile = _profile(docs, k)
    order = _order(profile)
    rows = profile.where("at is null").select("id", "n", "digest")
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = stored(rows.join(reps, "digest", "left").select("id", "n", "digest", F.coalesce("rep", "id").alias("rep"), "copies"), "nodes")
    copied = stored(nodes.where("copies > 1").select("id", "rep").distinct(), "copied")
    again = spark.sparkContext.broadcast(bit_filter(copied, "id"))

    # The sketch cannot tell n-grams of a few dozen documents from single ones.  Those that a
    # first round of prefixes shows are put last too, and the prefixes made again; any fixed
    # order is exact, so the filter's false positives do no harm.
    first = _prefixes(docs, spark.sparkContext.broadcast(order), again, k, percent)
    often = stored(first.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") >= OFTEN).select("token"), "often")
    order.often = bit_filter(often, "token")
    order = spark.sparkContext.broadcast(order)
    prefix = _prefixes(docs, order, again, k, percent)
    members = _members(copied, prefix)
    by = F.col("pos").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    centres = members.groupBy("token").agg(F.count("*").alias("m"), F.min_by("id", by).alias("yid"), F.min_by("n", by).alias("yn"), F.min_by("s", by).alias("ys")).where("m > 1")
    stars = members.select("token", F.col("id").alias("xid"), F.col("n").alias("xn"), F.col("s").alias("xs")).join(centres, "token").where("xid <> yid").where(F.least("xs", "ys") >= _least(percent, "xn", "yn"))
    links = _links(docs, _pairs(stars).where(F.col("c") * STAR_SHARE >= _least(percent, "na", "nb")).drop("c"), order, k, percent)

    # Buckets whose members are in several components: compare the members outside the
    # largest component with everything of another component.  Two prefixes that share c of
    # their s shared n-grams meet at one of the first s - c + 1 of both.
    comp = stored(components(links), "components")
    placed = stored(members.join(small(comp), "id", "left").select("token", "id", "n", "s", "r", F.coalesce("component_id", "id").alias("comp")), "placed")
    share = placed.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("comps"), F.max_by("comp", F.col("c")).alias("main")).where("comps > 1")
    open_ = placed.join(share.select("token", "main"), "token")
    x = open_.select("token", F.col("id").alias("xid"), F.col("n").alias("xn"), (F.col("s") - F.col("r") + 1).alias("xleft"), F.col("comp").alias("xcomp"), (F.col("comp") == F.col("main")).alias("xmain"))
    y = open_.select("token", F.col("id").alias("yid"), F.col("n").alias("yn"), (F.col("s") - F.col("r") + 1).alias("yleft"), F.col("comp").alias("ycomp"), (F.col("comp") == F.col("main")).alias("ymain"))
    x = x.where("not xmain").drop("xmain")
    rest = x.join(y, "token").where("xcomp <> ycomp and (ymain or xid < yid)").where(F.least("xleft", "yleft") >= _least(percent, "xn", "yn"))
    more = _links(docs, _sharing(_pairs(rest).drop("c"), members, percent), order, k, percent)
    return nodes, links.unionByName(more)


def join(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (distinct ``words``-word n-grams) and
    component_id, the smallest id reachable over pairs with
    100 * intersection >= percent * union."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "twice")
    if twice.isEmpty():
        nodes, links = _linked(rows, words, percent)
        comp = components(links).select(F.col("id").alias("rep"), "component_id")
        return nodes.join(comp, "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    # Texts that share an id are compared one by one, under ids of their own, and their
    # components are one: a document has the links of all its texts.
    own = rows.join(small(twice.withColumn("again", F.lit(True))), "id", "left")
    uid = F.when(F.col("again"), -1 - F.pmod(F.xxhash64("id", "text"), F.lit(1 << 62))).otherwise(F.col("id"))
    own = stored(own.select("id", uid.alias("uid"), "text"), "own")
    nodes, links = _linked(own.select(F.col("uid").alias("id"), "text"), words, percent)
    named = nodes.withColumnRenamed("id", "uid").join(own.select("uid", "id").distinct(), "uid")
    named = stored(named.select("uid", "id", "n", "rep"), "named")
    several = named.join(small(twice), "id")
    bound = several.join(small(stored(several.groupBy("id").agg(F.min("rep").alias("a")), "several")), "id").select("a", F.col("rep").alias("b"))
    comp = components(links.unionByName(bound.where("a <> b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("c"))
    placed = stored(named.join(comp, "rep", "left").withColumn("c", F.coalesce("c", "rep")), "placed")
    least = placed.groupBy("c").agg(F.min("id").alias("component_id"))
    return placed.join(least, "c").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their component (smallest id; of repeated rows,
    one), with their columns.  Rows that may go are told apart by a bit filter and tested
    exactly; the others, the bulk, are not shuffled."""
    found = stored(join(docs, words, percent, text, id_col), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.unionByName(twice), "doc_id"))

    @pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        ok = s.notna()
        return pd.Series(in_filter(bits.value, s.fillna(0).to_numpy(np.int64)) & ok.to_numpy())

    m, key = temp_name(docs, "maybe"), temp_name(docs, "key")
    flagged = docs.withColumn(m, maybe(F.col(id_col).cast("long")))
    sure = flagged.where(~F.col(m)).drop(m)
    doubt = flagged.where(F.col(m)).drop(m).withColumn(key, F.col(id_col).cast("long"))
    kept = doubt.join(gone.withColumnRenamed("doc_id", key), key, "left_anti").dropDuplicates([key]).drop(key)
    return sure.unionByName(kept.select(*sure.columns))
