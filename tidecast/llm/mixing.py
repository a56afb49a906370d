"""Mix sources to target weights by hash thresholds, in DataFrame functions only.

A source's target is its share, by weight, of ``share`` times all words, at most ``most``
times the source's own words; what a full source cannot take is shared again by weight
among the others.  Which documents fill a target is decided by a hash of each document, so
no documents are sorted and the same rows give the same mix on every run and partitioning:

* words are summed by source and leading hash bits (``BITS`` at a time, at most 2**BITS sums
  a source), running sums find the bucket in which the budget ends, and only the documents
  of that bucket are summed again by the next bits, until the bucket is one hash value;
* budgets nest: a target of 1.3 times a source is every document once and a threshold for
  the remaining 0.3;
* documents of more than 1/``FINE`` of their source's target are settled first, in
  proportion; the others then get what is left, so one very long document at the boundary
  does not move the source off its target.

A boundary hash is taken if that brings the sum nearer to the budget (ties: not taken).
With ``FINE`` = 64 a source ends within 1/128 of its target, unless its short documents are
too few to make up for the long ones.

Null and empty texts have size 0 and are taken 0 times over.  The null source is a source,
after all others.  Repeated rows (same id and text) share one hash and are taken together;
rows of one id with other texts are separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored, temp_name

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
BITS = 10
FINE = 64
SALTS = 32


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def place(id_col: Column, text: Column) -> Column:
    """The 60-bit hash of a document: the first 15 hex digits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and orders like the source, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def _joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Columns of ``per_source`` (stored, one row per ``key``) at each of ``rows``, which have
    a hash ``h``.  Few sources are broadcast; many are joined with ``SALTS`` copies of each, so
    a source with a third of all rows is spread over as many tasks."""
    if per_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_source), "key")
    copies = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"]).drop("salt")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 in order of ``key``: ranges of keys are counted by themselves
    and start where the ranges before end."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(sources.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = parts.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return parts.join(F.broadcast(base), "part").select(*sources.columns, (F.col("base") + nth).alias("nth"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2) -> DataFrame:
    """(key, source_size) with each source's ``target``.  Sources whose share exceeds their
    most are set to it and the rest is shared again, until none exceeds it."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = stored(_numbered(sizes).select("key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        n, caps, rest = s.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == seen or not rest:
            break
        level, seen = (share * total - caps) / rest, n
    return stored(s.select("key", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target")), "targets")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each key of ``budgets`` (key, budget; stored) the hash up to which documents are
    taken: (key, upto, got), ``got`` being the words up to it (upto -1, got 0: none).
    ``rows``: stored (key, h, size).  A budget beyond all words takes all."""
    done, left = [], budgets.where("budget > 0").select("key", "budget", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("before"))
    shift = HASH_BITS
    while shift > 0:
        near = rows.where("size > 0").select("key", "h", "size")
        if shift < HASH_BITS:  # only the documents of the boundary buckets
            at = left.select("key", "path")
            near = _joined(near, at).where(F.shiftright("h", shift) == F.col("path")).drop("path")
        shift -= BITS
        sums = near.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**BITS rows
        first = Window.partitionBy("key").orderBy("bucket")
        cut = sums.join(left, "key").withColumn("upto_s", F.sum("s").over(run))
        cut = cut.where("upto_s >= budget").withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("below", F.col("upto_s") - F.col("s"))
        cut = stored(cut.drop("n", "path"), "boundary")
        nearer = F.col("upto_s") - F.col("budget") < F.col("budget") - F.col("below")
        done.append(cut.where("low = high").select("key", F.when(nearer, F.col("high")).otherwise(F.col("low") - 1).alias("upto"), (F.col("before") + F.when(nearer, F.col("upto_s")).otherwise(F.col("below"))).alias("got")))
        left = cut.where("low < high").select("key", (F.col("budget") - F.col("below")).alias("budget"), F.col("bucket").alias("path"), (F.col("before") + F.col("below")).alias("before"))
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _cut(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Whole times and a threshold for (key, words, budget): (key, times, upto, got)."""
    whole = F.when(F.col("words") > 0, F.floor(F.col("budget") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    b = stored(budgets.withColumn("times", whole).withColumn("budget", F.when(F.col("words") > 0, F.col("budget") - F.col("times") * F.col("words")).otherwise(F.lit(0.0))), "budgets")
    t = b.join(thresholds(rows, b.select("key", "budget")), "key", "left")
    return t.select("key", "times", F.coalesce("upto", F.lit(-1)).cast("long").alias("upto"), (F.col("times") * F.col("words") + F.coalesce("got", F.lit(0))).cast("long").alias("got"))


def _keys(text: str, id_col: str, source: str) -> list[Column]:
    return [source_key(F.col(source)).alias("key"), words(F.col(text)).alias("size"), place(F.col(id_col), F.col(text)).alias("h")]


def _slim(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *_keys(text, id_col, source))


def _long() -> Column:
    return F.col("size") * FINE > F.col("target")


def _copies() -> Column:
    long = _long()
    return F.when(long, F.col("long_times") + (F.col("h") <= F.col("long_upto")).cast("long")).otherwise(F.col("times") + (F.col("h") <= F.col("upto")).cast("long"))


def _plan(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: its size, target and thresholds, from stored (key, size, h)."""
    goal = targets(slim.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most)
    parted = _joined(slim.select("key", "size", "h"), goal.select("key", "target"))
    sums = parted.groupBy("key").agg(F.sum(F.when(_long(), F.col("size")).otherwise(F.lit(0))).alias("long_words"))
    goal = stored(goal.join(sums, "key"), "goals")
    parted = _joined(slim.select("key", "size", "h"), goal.select("key", "target"))
    share_of = F.when(F.col("source_size") > 0, F.col("target") * F.col("long_words") / F.col("source_size")).otherwise(F.lit(0.0))
    longs = _cut(parted.where(_long()), goal.select("key", F.col("long_words").alias("words"), share_of.alias("budget")))
    goal = stored(goal.join(longs.select("key", F.col("times").alias("long_times"), F.col("upto").alias("long_upto"), "got"), "key"), "goals")
    rest = F.col("source_size") - F.col("long_words")
    budget = F.least(F.greatest(F.col("target") - F.col("got"), F.lit(0.0)), rest * F.lit(float(most)))
    shorts = _cut(parted.where(~_long()), goal.select("key", rest.alias("words"), budget.alias("budget")))
    return stored(goal.join(shorts.select("key", "times", "upto"), "key").drop("got", "long_words"), "mix")


def decide(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    slim = stored(_slim(docs, text, id_col, source), "sizes")
    rows = _joined(slim, _plan(slim, weights, share, most)).withColumn("copies", _copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed table itself: rows of ``docs``, with all their columns, as often as taken.
    Thresholds are applied in the scan, so documents are neither joined by id nor sorted."""
    slim = stored(_slim(docs, text, id_col, source), "sizes")
    plan = _plan(slim, weights, share, most)
    own = temp_name(docs, "doc")
    rows = docs.select(F.struct("*").alias(own), *_keys(text, id_col, source))
    rows = _joined(rows, plan).withColumn("copies", _copies())
    return rows.select(own, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).select(f"{own}.*")
