"""Join operators (survey D1-D8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast


def forecast_actual(samples: DataFrame, actuals: DataFrame) -> DataFrame:
    """Samples joined to observations on their shared key columns.  The
    observation table (one row per zone-hour) is broadcast after a size check."""
    keys = [c for c in actuals.columns if c in samples.columns]
    return samples.join(sized_broadcast(actuals), on=keys, how="inner")


def dst_align(values: Column) -> Column:
    """Map one local day's hourly values to 24 slots: 25 values drop index 3
    (the repeated hour), 23 values repeat index 2 as index 3; other lengths -> null."""
    n = F.size(values)
    return (
        F.when(n == 24, values)
        .when(n == 25, F.concat(F.slice(values, 1, 3), F.slice(values, 5, 21)))
        .when(n == 23, F.concat(F.slice(values, 1, 3), F.slice(values, 3, 1), F.slice(values, 4, 20)))
    )


def trailing_window(
    targets: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    target_day: str,
    history_day: str,
    days: int,
    bucket_days: int | None = None,
) -> DataFrame:
    """Every target date with the history rows in ``[t - days, t)``.

    Range condition made shuffle-friendly: each history day is replicated to the
    coarse buckets that hold its target days, at most ``ceil(days / bucket) + 1``, so the join is an
    equi-join on ``(keys, bucket)`` plus the exact range filter — never a nested
    loop.  ``bucket_days`` defaults to ``days``."""
    bd = bucket_days or days
    t = targets.withColumn("_bk", F.floor(F.unix_date(F.col(target_day)) / bd).cast("long"))
    h = history.withColumn(
        "_bk",
        F.explode(
            F.sequence(
                F.floor((F.unix_date(F.col(history_day)) + 1) / bd).cast("long"),
                F.floor((F.unix_date(F.col(history_day)) + days) / bd).cast("long"),
            )
        ),
    )
    j = t.join(h, on=[*keys, "_bk"], how="inner")
    cond = (F.col(history_day) >= F.date_sub(F.col(target_day), days)) & (F.col(history_day) < F.col(target_day))
    return j.where(cond).drop("_bk")
