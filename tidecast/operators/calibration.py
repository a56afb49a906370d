"""Calibration curves, sharpness and daily forecast summaries (survey E21-E31)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def nominal_levels(num_bins: int = 10) -> list[float]:
    """Nominal coverages ``linspace(0.1, 0.9, num_bins)`` (fixed by the reference)."""
    return [float(v) for v in np.linspace(0.1, 0.9, num_bins)]


def interval_90(df: DataFrame) -> DataFrame:
    """The 90 % interval is (q05, q95), else (q10, q90); rows with neither drop."""
    cols = set(df.columns)
    lower = F.coalesce(*[F.col(c) for c in ("q05", "q10") if c in cols])
    upper = F.coalesce(*[F.col(c) for c in ("q95", "q90") if c in cols])
    return df.withColumns({"lower90": lower, "upper90": upper}).where(
        F.col("lower90").isNotNull() & F.col("upper90").isNotNull()
    )


def calibration_curve(
    fc: DataFrame, keys: Sequence[str], num_bins: int = 10, mean: str = "mean", realized: str = "realized", tol: float = 0.1
) -> DataFrame:
    """For each nominal level, shrink the 90 % interval around the mean by
    ``nominal / 0.9``; empirical coverage, mean width and the +-tol flag.

    The level list is a literal array exploded per row (no join), so the work is one
    partial aggregate keyed by (keys, level)."""
    lv = F.array(*[F.lit(v) for v in nominal_levels(num_bins)])
    x = interval_90(fc).select(*keys, mean, realized, "lower90", "upper90", F.posexplode(lv).alias("level_idx", "nominal"))
    f = F.col("nominal") / 0.9
    lo = F.col(mean) - (F.col(mean) - F.col("lower90")) * f
    hi = F.col(mean) + (F.col("upper90") - F.col(mean)) * f
    inside = ((F.col(realized) >= lo) & (F.col(realized) <= hi)).cast("double")
    out = x.groupBy(*keys, "level_idx", "nominal").agg(
        F.avg(inside).alias("empirical"), F.avg(hi - lo).alias("width")
    )
    return out.withColumn("within_tol", F.abs(F.col("empirical") - F.col("nominal")) <= tol)


def sharpness(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean interval width over levels, and mean absolute calibration error."""
    return curve.groupBy(*keys).agg(
        F.avg("width").alias("sharpness"),
        F.avg(F.abs(F.col("empirical") - F.col("nominal"))).alias("calibration_error"),
        F.sum(F.col("within_tol").cast("int")).alias("levels_within_tol"),
    )


def spike_week(fc: DataFrame, keys: Sequence[str], ts: str, start, days: int = 7) -> DataFrame:
    """The ``[start, start + days)`` slice with the hour offset from its start."""
    part = interval_90(fc).where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.date_add(F.lit(start), days)))
    w = Window.partitionBy(*keys).orderBy(ts)
    return part.withColumn("hour_offset", F.row_number().over(w) - 1)


def interval_coverage(df: DataFrame, keys: Sequence[str], y: str, lo: str, hi: str) -> DataFrame:
    """Share of observations inside [lo, hi]."""
    return df.groupBy(*keys).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def heat_bands(df: DataFrame, keys: Sequence[str], value: str, by: Column) -> DataFrame:
    """Mean score by a calendar band (hour, day of week or season)."""
    return df.groupBy(*keys, by.alias("band")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def heat_bands_of(df: DataFrame, keys: Sequence[str], value: str, bands: dict[str, Column]) -> DataFrame:
    """E29 for several kinds of band in one pass: ``keys, kind, band`` (as text), mean, n."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("band")) for k, c in bands.items()])
    long = df.select(*keys, value, F.inline(each))
    return long.groupBy(*keys, "kind", "band").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def season(month: Column) -> Column:
    """Meteorological season of a month number."""
    return (
        F.when(month.isin(12, 1, 2), F.lit("winter"))
        .when(month.isin(3, 4, 5), F.lit("spring"))
        .when(month.isin(6, 7, 8), F.lit("summer"))
        .otherwise(F.lit("autumn"))
    )


# ---------------------------------------------------------------- daily summaries
def daily_summary(stats: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """Per forecast day (``keys``): overall mean, peak hours (mean above the
    day's mean) and their mean, volatile hours (std above the mean std) and their
    mean std, high-value / high-risk hours (above the day's 75th percentile).
    A day has 24 rows, so the window and ``collect_list`` are bounded."""
    w = Window.partitionBy(*keys)
    d = stats.withColumns(
        {
            "_dm": F.avg("mean").over(w),
            "_ds": F.avg("std").over(w),
            "_p75m": F.percentile(F.col("mean"), F.lit(0.75)).over(w),
            "_p75s": F.percentile(F.col("std"), F.lit(0.75)).over(w),
        }
    )
    peak = F.col("mean") > F.col("_dm")
    vol = F.col("std") > F.col("_ds")
    return d.groupBy(*keys).agg(
        F.first("_dm").alias("overall_mean"),
        F.array_sort(F.collect_list(F.when(peak, F.col(hour)))).alias("peak_hours"),
        F.avg(F.when(peak, F.col("mean"))).alias("peak_mean"),
        F.array_sort(F.collect_list(F.when(vol, F.col(hour)))).alias("volatile_hours"),
        F.avg(F.when(vol, F.col("std"))).alias("volatile_std"),
        F.array_sort(F.collect_list(F.when(F.col("mean") > F.col("_p75m"), F.col(hour)))).alias("high_value_hours"),
        F.array_sort(F.collect_list(F.when(F.col("std") > F.col("_p75s"), F.col(hour)))).alias("high_risk_hours"),
    )


def state_summary(stats: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """Hours, count and mean forecast per market state of each day."""
    return stats.groupBy(*keys, "state").agg(
        F.array_sort(F.collect_list(hour)).alias("hours"),
        F.count(F.lit(1)).alias("count"),
        F.avg("mean").alias("mean"),
    )
