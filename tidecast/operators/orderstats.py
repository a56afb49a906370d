"""Skew-safe order statistics within groups.

CRPS needs ``sum_i (2i - n - 1) * x_(i)`` over the sorted values of each group, and
exact (linear-interpolation) percentiles need the values at given ranks.  The obvious
plan, ``row_number() over (partition by key order by x)``, sends every row of a key
to one task, which fails when one key holds a large share of all rows.

There is one plan, whatever the sizes, and it runs no job while it is built:

1. ``groupBy(key, value)`` sums weights: equal values collapse with partial aggregation, so
   a point mass (zeros, a cap) is one row.
2. Keys with more than ``rows_per_bucket`` distinct values are cut into value buckets of about
   that many.  The cuts are taken from the values whose hash falls on a fixed residue, an
   even sample of the distinct values that comes out the same wherever and however often it
   is computed.  Bucket ``b`` holds only values below those of bucket ``b + 1``.
3. Running weights over ``(key, bucket)`` ordered by value: a window partition holds about
   ``rows_per_bucket`` rows, never the key's rows.
4. Running totals over the buckets of a key give each bucket's offset.  There is one row per
   (key, bucket).

Values at which counts are wanted although no row holds them ("marks", such as observations
met by a forecast's samples) travel along with weight 0, so samples and observations meet in
one sorted pass: work n + m instead of n x m.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import rows_per_bucket

N, B, C, SX = "_n", "_b", "_c", "_sx"
BEFORE, SBEFORE = "_before", "_sbefore"  # weight, and sum of weight x value, below this value
SAMPLED = 64  # sampled values per bucket that place its ends
DIRECT_LEVELS = 16  # up to this many levels are read by conditional aggregates


def bucketed(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    per_bucket: int | None = None,
    weight: str | None = None,
    marks: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct ``value`` of a key (null values left out): ``_c`` (its weight: rows,
    or the sum of ``weight``), ``_n`` and ``_sx`` (the key's weight and sum of weight x value)
    and ``_b`` (value bucket).  ``marks`` (keys and ``value``) adds rows of weight 0."""
    keys = list(keys)
    per_bucket = per_bucket or rows_per_bucket(df.sparkSession)
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(*keys, value, (F.col(weight) if weight else F.lit(1).cast("long")).alias(C))
    if marks is not None:
        rows = rows.unionByName(marks.where(x.isNotNull()).select(*keys, value, F.lit(0).cast(rows.schema[C].dataType).alias(C)))
    rows = rows.groupBy(*keys, value).agg(F.sum(C).alias(C))
    every = max(1, per_bucket // SAMPLED)
    step = max(1, per_bucket // every)
    stats = rows.groupBy(*keys).agg(
        F.sum(C).alias(N),
        F.sum(F.col(C) * x).alias(SX),
        F.count(F.lit(1)).alias("_d"),
        F.sort_array(F.collect_list(F.when(F.pmod(F.xxhash64(x), F.lit(every)) == 0, x))).alias("_s"),
    )
    cuts = F.when(F.col("_d") > per_bucket, F.filter("_s", lambda e, i: (i + 1) % step == 0))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    stats = stats.select(*named, N, SX, cuts.alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    bucket = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda e: e < x)))
    return rows.join(stats, on=same, how="inner").select(*keys, value, C, N, SX, bucket.alias(B))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    per_bucket: int | None = None,
    weight: str | None = None,
    marks: DataFrame | None = None,
) -> DataFrame:
    """:func:`bucketed` with ``_before`` and ``_sbefore``: the key's weight, and sum of weight x
    value, strictly below the row's value."""
    keys = list(keys)
    rows = bucketed(df, keys, value, per_bucket, weight, marks)
    x = F.col(value)
    totals = rows.groupBy(*keys, B).agg(F.sum(C).alias("_nb"), F.sum(F.col(C) * x).alias("_sb"))
    lower = Window.partitionBy(*keys).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(B).alias("_kb"),
        F.coalesce(F.sum("_nb").over(lower), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_sb").over(lower), F.lit(0.0)).alias("_soff"),
    )
    inside = Window.partitionBy(*keys, B).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_r": F.coalesce(F.sum(C).over(inside), F.lit(0)),
        "_sr": F.coalesce(F.sum(F.col(C) * x).over(inside), F.lit(0.0)),
    })
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(B) == F.col("_kb")]
    return rows.join(totals, on=same, how="inner").select(
        *keys, value, C, N, SX, (F.col("_off") + F.col("_r")).alias(BEFORE), (F.col("_soff") + F.col("_sr")).alias(SBEFORE)
    )


def _at(q: float):
    """Zero-based fractional rank of level ``q``."""
    return (F.col(N) - 1) * F.lit(float(q))


def _holds(rank):
    """Whether the row's value has the (1-based) rank."""
    return (rank > F.col(BEFORE)) & (rank <= F.col(BEFORE) + F.col(C))


def summary(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float] = (),
    names: Sequence[str] = (),
    per_bucket: int | None = None,
) -> DataFrame:
    """Per key: ``n``, ``sum_x``, ``gini_sum`` (``sum_i (2i - n - 1) x_(i)``; over n^2 it is half
    the mean absolute difference) and one column per requested level."""
    return summary_from_ranked(ranked(df, keys, value, per_bucket), keys, value, levels, names)


def summary_from_ranked(rows: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = (), names: Sequence[str] = ()) -> DataFrame:
    """:func:`summary` on the output of :func:`ranked`."""
    keys = list(keys)
    x = F.col(value)
    aggs = [
        F.first(N).alias("n"),
        F.first(SX).alias("sum_x"),
        F.sum((2 * F.col(BEFORE) + F.col(C) - F.col(N)) * F.col(C) * x).alias("gini_sum"),
    ]
    for i, q in enumerate(levels):
        aggs.append(F.max(F.when(_holds(F.floor(_at(q)) + 1), x)).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(_holds(F.ceil(_at(q)) + 1), x)).alias(f"_hi{i}"))
    out = [*keys, "n", "sum_x", "gini_sum"]
    for i, (q, name) in enumerate(zip(levels, names)):
        h = (F.col("n") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name))
    return rows.groupBy(*keys).agg(*aggs).where(F.col("n") > 0).select(*out)


def quantiles_long(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float],
    per_bucket: int | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation between order statistics
    (NumPy ``percentile`` default / SQL ``quantile_cont``), long form:
    ``keys..., level_idx INT, q DOUBLE, value DOUBLE``."""
    keys = list(keys)
    rows = ranked(df, keys, value, per_bucket)
    if len(levels) <= DIRECT_LEVELS:
        wide = summary_from_ranked(rows, keys, value, levels, [f"_q{i}" for i in range(len(levels))])
        cells = [F.struct(F.lit(i).alias("level_idx"), F.lit(float(q)).alias("q"), F.col(f"_q{i}").alias("value")) for i, q in enumerate(levels)]
        return wide.select(*keys, F.explode(F.array(*cells)).alias("_l")).select(*keys, "_l.level_idx", "_l.q", "_l.value")
    # Every row names the levels that read it; most rows name none.
    lv = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(levels)])
    h = F.col("_h")
    read = F.filter(lv, lambda e: _holds(F.floor((F.col(N) - 1) * e.q) + 1) | _holds(F.ceil((F.col(N) - 1) * e.q) + 1))
    hits = rows.select(*keys, value, C, N, BEFORE, F.explode(read).alias("_l")).withColumn("_h", (F.col(N) - 1) * F.col("_l.q"))
    got = hits.groupBy(*keys, F.col("_l.i").alias("level_idx")).agg(
        F.first("_l.q").alias("q"),
        F.first("_h").alias("_h"),
        F.max(F.when(_holds(F.floor(h) + 1), F.col(value))).alias("_xlo"),
        F.max(F.when(_holds(F.ceil(h) + 1), F.col(value))).alias("_xhi"),
    )
    return got.select(*keys, "level_idx", "q", (F.col("_xlo") + (h - F.floor(h)) * (F.col("_xhi") - F.col("_xlo"))).alias("value"))


def quantiles_wide(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float],
    names: Sequence[str],
    per_bucket: int | None = None,
) -> DataFrame:
    """Same as :func:`quantiles_long`, one column per level (``names``)."""
    if len(levels) <= DIRECT_LEVELS:
        return summary(df, keys, value, levels, names, per_bucket).select(*keys, *names)
    long = quantiles_long(df, keys, value, levels, per_bucket)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("level_idx") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])


def order_index(df: DataFrame, keys: Sequence[str], value: str, name: str = "i", per_bucket: int | None = None) -> DataFrame:
    """``df`` with every row's rank within its key by ``value`` (ties share the lowest rank,
    null values come first as in ``rank()``).  Ranks come from value buckets and are joined to
    the rows by (key, value), so no task holds a key's rows."""
    keys = list(keys)
    x = F.col(value)
    at = ranked(df, keys, value, per_bucket).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_x"), BEFORE)
    nulls = df.where(x.isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_nulls"))
    nulls = nulls.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], "_nulls")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [x == F.col("_x")]
    also = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    out = df.join(at, on=same, how="left").join(nulls, on=also, how="left")
    first = F.when(x.isNull(), F.lit(1)).otherwise(F.col(BEFORE) + F.coalesce("_nulls", F.lit(0)) + 1)
    return out.select(*[F.col(c) for c in df.columns], first.cast("int").alias(name))
