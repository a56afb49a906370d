"""Hourly panel: slices, calendar spine, features, day matrix, scaling (survey B, C).

Every window here is partitioned by the series key (``zone``): a series has one row
per hour, so a window partition is bounded by the time span, not by data volume.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAG_HOURS = {"d2": 48, "d3": 72, "d7": 168}  # fixed: D-2, D-3, D-7 in hours
CYCLICAL = ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")
TIME_FEATURES = CYCLICAL + ("is_weekend",)
HOURS = 24


# ---------------------------------------------------------------- B: slices and filters
def date_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """B1: inclusive date slice; ``end`` means through the end of that day."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.date_add(F.lit(end), 1)))


def eval_slice(df: DataFrame, ts: str, start, end, closed: bool = False) -> DataFrame:
    """B2: evaluation slice; ``closed=True`` keeps the extra midnight row of
    ``ts <= end + 1 day`` (the reference parity mode), default is half-open."""
    upper = F.to_timestamp(F.date_add(F.lit(end), 1))
    cond = F.col(ts) <= upper if closed else F.col(ts) < upper
    return df.where((F.col(ts) >= F.lit(start)) & cond)


#: Fixed: the zones of the study keep this wall clock.
LOCAL_TZ = "Europe/Oslo"


def to_local(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    """Naive timestamps are UTC; convert to local wall-clock time (NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts) if isinstance(ts, str) else ts)


def drop_warmup(df: DataFrame, keys: Sequence[str], order: str, n: int = 168) -> DataFrame:
    """Drop the first ``n`` rows of every series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > n).drop("_rn")


def full_blocks(df: DataFrame, keys: Sequence[str], block: str, size: int = HOURS) -> DataFrame:
    """Keep only blocks that have exactly ``size`` rows."""
    w = Window.partitionBy(*keys, block)
    return df.withColumn("_bn", F.count(F.lit(1)).over(w)).where(F.col("_bn") == size).drop("_bn")


def week_slice(df: DataFrame, ts: str, start, days: int = 7) -> DataFrame:
    """``[start, start + days)``."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.date_add(F.lit(start), days)))


# ---------------------------------------------------------------- C1-C4: calendar
def hourly_spine(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per hour between each series' first and last timestamp."""
    span = df.groupBy(key).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    return span.select(key, F.explode(F.sequence("_t0", "_t1", F.expr("INTERVAL 1 HOUR"))).alias(ts))


def daily_spine(start, end) -> Column:
    """``explode`` this for one row per day in ``[start, end]``."""
    return F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY")))


def calendar_parts(df: DataFrame, ts: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Hour, day of week (Monday = 0) and month of the local time."""
    local = to_local(ts, tz)
    return df.withColumns(
        {"hour": F.hour(local), "day_of_week": F.weekday(local), "month": F.month(local)}
    )


def time_features(df: DataFrame, ts: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Cyclical encodings and the weekend flag of the local time."""
    local = to_local(ts, tz)
    h, d, m = F.hour(local), F.weekday(local), F.month(local)
    two_pi = 2 * math.pi
    return df.withColumns(
        {
            "hour_sin": F.sin(two_pi * h / 24),
            "hour_cos": F.cos(two_pi * h / 24),
            "day_of_week_sin": F.sin(two_pi * d / 7),
            "day_of_week_cos": F.cos(two_pi * d / 7),
            "month_sin": F.sin(two_pi * (m - 1) / 12),
            "month_cos": F.cos(two_pi * (m - 1) / 12),
            "is_weekend": (d >= 5).cast("double"),
        }
    )


# ---------------------------------------------------------------- C5-C11: lags and matrix
def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    lags: dict[str, int] | None = None,
) -> DataFrame:
    """Positional lags (rows, not calendar hours), all in one window pass;
    names ``{column}_{lag}``."""
    lags = lags or LAG_HOURS
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{c}_{name}": F.lag(c, n).over(w) for name, n in lags.items() for c in columns})


def lags_by_time(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], lags: dict[str, int] | None = None, tz: str | None = None
) -> DataFrame:
    """C5 by time: the value exactly so many hours earlier, whatever rows are missing between
    (null where that hour has no row).  With ``tz`` the hours are those of the local clock of the
    UTC stamp ``ts``: two days before 14:00 is 14:00 also across a clock change; the hour that a
    change skips has no value, of the hour that it repeats the later one counts.  One sort per
    series; each frame holds the rows of one hour.  Of rows with one stamp the greatest value
    counts."""
    lags = lags or LAG_HOURS
    clock = epoch_seconds(to_local(ts, tz) if tz else F.col(ts)).cast("long")
    w = Window.partitionBy(*keys).orderBy(clock)
    return df.withColumns({
        f"{c}_{name}": F.max(F.struct(F.col(ts), F.col(c))).over(w.rangeBetween(-3600 * n, -3600 * n))[c] for name, n in lags.items() for c in columns
    })


def feature_family(name: Column) -> Column:
    """Strip the ``_d{N}`` lag suffix to get the base feature name."""
    return F.regexp_replace(name, r"_d[0-9]+$", "")


def feature_families(register: DataFrame) -> DataFrame:
    """Families by base name with member count and running start offset.

    ``register`` has ``feature, pos`` (C10); output ``family, members, size, start_idx``.
    """
    fam = register.withColumn("family", feature_family(F.col("feature")))
    g = fam.groupBy("family").agg(
        F.min("pos").alias("_first"),
        F.sort_array(F.collect_list(F.struct("pos", "feature"))).alias("_m"),
        F.count(F.lit(1)).alias("n_members"),
    )
    w = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return g.select(
        "family",
        F.transform("_m", lambda s: s["feature"]).alias("members"),
        "n_members",
        (F.col("n_members") * HOURS).alias("size"),
        (F.coalesce(F.sum("n_members").over(w), F.lit(0)) * HOURS).alias("start_idx"),
    )


def day_blocks(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Positional day block ``day_id = (row_number - 1) div 24`` and the hour
    slot inside the block."""
    w = Window.partitionBy(*keys).orderBy(order)
    rn = F.row_number().over(w) - 1
    return df.withColumn("_rn0", rn).withColumns(
        {"day_id": F.floor(F.col("_rn0") / HOURS).cast("long"), "slot": (F.col("_rn0") % HOURS).cast("int")}
    ).drop("_rn0")


def day_matrix(
    df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str]
) -> DataFrame:
    """One row per ``(keys, day_id)`` with ``y`` (24 values) and ``x``
    (24 * F values, feature-major, hour-minor).  Needs ``day_id`` and ``slot``; only
    complete blocks are kept (B8).  A block is 24 rows, so ``collect_list`` is bounded."""
    full = full_blocks(df, keys, "day_id")
    g = full.groupBy(*keys, "day_id").agg(
        F.min("ts").alias("day_start"),
        F.sort_array(F.collect_list(F.struct("slot", target, *features))).alias("_rows"),
    )
    def field(name: str):
        return lambda r: r[name].cast("double")

    y = F.transform("_rows", field(target))
    xs = [F.transform("_rows", field(f)) for f in features]
    return g.select(*keys, "day_id", "day_start", y.alias("y"), (F.concat(*xs) if xs else F.array()).alias("x"))


def feature_register(features: Sequence[str], spark) -> DataFrame:
    """``feature, pos, start_idx, size`` for the flattened ``x`` layout."""
    rows = [(f, i, i * HOURS, HOURS) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, pos int, start_idx int, size int")


def train_split_day(days: DataFrame, keys: Sequence[str], validation_start) -> DataFrame:
    """C11: first validation ``day_id`` per series — the first block starting on or
    after ``validation_start``; 80 % of the blocks when no block does."""
    g = days.groupBy(*keys).agg(
        F.min(F.when(F.col("day_start") >= F.lit(validation_start), F.col("day_id"))).alias("_v"),
        F.count(F.lit(1)).alias("_nd"),
    )
    return g.select(*keys, F.coalesce("_v", F.floor(F.col("_nd") * 0.8)).cast("long").alias("split_day"))


def fit_scaler(long_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``(keys, feature, hour)`` mean and population std of the training
    rows; std 0 becomes 1 (scikit-learn's guard).  ``long_df`` has ``feature, hour, v``."""
    return long_df.groupBy(*keys, "feature", "hour").agg(
        F.avg("v").alias("mu"),
        F.when(F.stddev_pop("v") == 0, F.lit(1.0)).otherwise(F.stddev_pop("v")).alias("sigma"),
    )


def apply_scaler(long_df: DataFrame, scaler: DataFrame, keys: Sequence[str], skip: Sequence[str] = CYCLICAL) -> DataFrame:
    """``(v - mu) / sigma``; features in ``skip`` pass through unchanged.
    The scaler has one row per (series, feature, hour) and is joined by key."""
    j = long_df.join(scaler, on=[*keys, "feature", "hour"], how="left")
    scaled = F.when(F.col("feature").isin(*skip) | F.col("mu").isNull(), F.col("v")).otherwise(
        (F.col("v") - F.col("mu")) / F.col("sigma")
    )
    return j.withColumn("v_scaled", scaled).drop("mu", "sigma")


def inverse_scale(v: Column, mu: Column, sigma: Column) -> Column:
    """Back to target units."""
    return v * sigma + mu


# ---------------------------------------------------------------- C15-C19: selection
def select_groups(register: DataFrame, flags: DataFrame) -> DataFrame:
    """Keep flagged feature groups; when none is flagged, force the first one
    (lowest ``pos``).  ``flags`` has ``feature, selected``."""
    j = register.join(flags, on="feature", how="left").withColumn(
        "selected", F.coalesce(F.col("selected"), F.lit(False))
    )
    # The register has one row per feature column (tens of rows): a global window is fine.
    w = Window.partitionBy(F.lit(1))
    j = j.withColumns({"_any": F.max(F.col("selected").cast("int")).over(w), "_first": F.min("pos").over(w)})
    keep = F.col("selected") | ((F.col("_any") == 0) & (F.col("pos") == F.col("_first")))
    return j.where(keep).drop("selected", "_any", "_first")


def sibling_selection(register: DataFrame, flags: DataFrame) -> DataFrame:
    """A column is kept if its own flag or the flag of any lag sibling (same base
    name) is on.  Implemented as a left-semi join on the base name."""
    on_fams = flags.where("selected").select(feature_family(F.col("feature")).alias("family")).distinct()
    return register.withColumn("family", feature_family(F.col("feature"))).join(
        on_fams, on="family", how="left_semi"
    )


def expanded_names(selected: DataFrame) -> DataFrame:
    """C17: ``{feature}_{hour}`` for every selected feature and hour."""
    return selected.select(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour")
    ).withColumn("name", F.concat_ws("_", "feature", F.col("hour").cast("string")))


def hashed_split(keys: Sequence[str], seed: int, train_pct: int = 80) -> Column:
    """Seeded, partition-independent 80/20 split flag (True = train)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(100)) < train_pct


def daily_arrays(df: DataFrame, keys: Sequence[str], ts: str, value: str, tz: str | None = None) -> DataFrame:
    """Per (keys, local date) the values ordered by time (a day is <= 25 rows).
    ``ts`` is local time already, or UTC where ``tz`` names the zone to convert to."""
    return df.groupBy(*keys, F.to_date(to_local(ts, tz) if tz else F.col(ts)).alias("date")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(ts, value))), lambda s: s[value]).alias("values")
    )


# ---------------------------------------------------------------- C20-C26: preprocessing
def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """C20: carry the last non-null value forward (at most ``limit`` rows)."""
    lo = Window.unboundedPreceding if limit is None else -limit
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(lo, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation in time between the previous and next non-null values
    (gaps at the ends stay null)."""
    # both directions use growing frames (linear per series): "next" reads the series
    # in descending time order
    w_prev = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_t", epoch_seconds(F.col(order)))
    for c in columns:
        tv = F.when(F.col(c).isNotNull(), F.col("_t"))
        out = out.withColumns(
            {
                f"_pv_{c}": F.last(c, ignorenulls=True).over(w_prev),
                f"_pt_{c}": F.last(tv, ignorenulls=True).over(w_prev),
                f"_nv_{c}": F.last(c, ignorenulls=True).over(w_next),
                f"_nt_{c}": F.last(tv, ignorenulls=True).over(w_next),
            }
        )
        frac = (F.col("_t") - F.col(f"_pt_{c}")) / (F.col(f"_nt_{c}") - F.col(f"_pt_{c}"))
        out = out.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
                F.col(f"_pv_{c}") + frac * (F.col(f"_nv_{c}") - F.col(f"_pv_{c}"))
            ),
        ).drop(f"_pv_{c}", f"_pt_{c}", f"_nv_{c}", f"_nt_{c}")
    return out.drop("_t")


def rolling_stats(df: DataFrame, keys: Sequence[str], order: str, column: str, n: int) -> DataFrame:
    """Trailing mean and population std over the previous ``n`` rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumns(
        {f"{column}_roll_mean": F.avg(column).over(w), f"{column}_roll_std": F.stddev_pop(column).over(w)}
    )


def kfold_ids(days: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """``fold`` 1..k over the time order of each series (``ntile``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return days.withColumn("fold", F.ntile(k).over(w))


def expanding_splits(folds: DataFrame, k: int) -> DataFrame:
    """Split ``s`` of 1..k-1 trains on folds 1..s and validates on fold s + 1; a row
    per split that uses the fold."""
    splits = F.sequence(F.greatest(F.col("fold") - 1, F.lit(1)), F.lit(k - 1))
    rows = folds.withColumn("split", F.explode(splits))
    return rows.withColumn("role", F.when(F.col("fold") <= F.col("split"), F.lit("train")).otherwise(F.lit("validate")))


def three_way_split(ts: Column, val_start, test_start) -> Column:
    """C26: 'train' / 'val' / 'test' by date."""
    return (
        F.when(ts < F.lit(val_start), F.lit("train"))
        .when(ts < F.lit(test_start), F.lit("val"))
        .otherwise(F.lit("test"))
    )


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a wall-clock (NTZ) timestamp, independent of the
    session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def lag_column_name(feature: str, lag: str) -> str:
    return f"{feature}_{lag}"


def is_lag_name(name: str) -> bool:
    return re.search(r"_d[0-9]+$", name) is not None
