"""Proper scoring of sample forecasts (survey E1-E20, F1).

Inputs are long tables:

* ``samples``: one row per predictive sample, keyed by ``sample_keys``
  (e.g. model, run_id, zone, hour[, date]) with value column ``x``;
* ``actuals``: one row per observation, keyed by ``zone, date, hour`` with ``y``.

Plan shape: the samples of a forecast and the observations it meets are sorted together
once (:func:`orderstats.ranked`, observations as marks of weight 0).  Counts and sums below
an observation give ``mean |x - y|``; the same rows give the sample count, mean, CRPS
order-statistic term and percentiles.  Work is n + m for n samples and m observations, for a
forecast shared by many dates (historical simulation) and for forecasts of one date each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import orderstats

PINBALL_LEVELS = (0.1, 0.5, 0.9)  # fixed: quantiles scored by the reference
WINKLER_ALPHA = 0.9  # fixed: nominal coverage of the scored interval
STATE_THRESHOLD = 0.5  # fixed: up/down regulation threshold
STAT_LEVELS = (0.01, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.99)  # fixed: p01..p99 stats
STAT_NAMES = ("p01", "p05", "p10", "p25", "p75", "p90", "p95", "p99")


def level_name(q: float) -> str:
    """``q10`` style label; rounds (0.29 -> q29) instead of truncating."""
    return f"q{round(q * 100):02d}"


def winkler_levels(alpha: float = WINKLER_ALPHA) -> tuple[float, float]:
    lower = (1 - alpha) / 2
    return lower, 1 - lower


# ------------------------------------------------------------------ building blocks
def pinball(q: Column | float, y: Column, pred: Column) -> Column:
    """``max(q * e, (q - 1) * e)`` with ``e = y - pred``."""
    q = F.lit(q) if isinstance(q, float) else q
    e = y - pred
    return F.when(y >= pred, q * e).otherwise((1 - q) * (pred - y))


def winkler(y: Column, lower: Column, upper: Column, alpha: float = WINKLER_ALPHA, standard: bool = False) -> Column:
    """E5: interval width plus ``penalty * distance`` outside the interval.

    ``penalty = 2 / alpha`` with ``alpha`` the nominal coverage (the reference's
    choice); ``standard=True`` uses the textbook ``2 / (1 - alpha)``."""
    pen = 2.0 / (1 - alpha) if standard else 2.0 / alpha
    width = upper - lower
    return (
        F.when(y < lower, width + pen * (lower - y))
        .when(y > upper, width + pen * (y - upper))
        .otherwise(width)
    )


def sample_summary(
    samples: DataFrame,
    keys: Sequence[str],
    value: str = "x",
    levels: Sequence[float] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Per sample key: ``n``, ``mean_x``, ``gini_sum`` and the requested percentiles."""
    keys = list(keys)
    names = list(names or [level_name(q) for q in levels])
    summ = orderstats.summary(samples, keys, value, levels, names)
    return summ.select(*keys, "n", (F.col("sum_x") / F.col("n")).alias("mean_x"), "gini_sum", *names)


def hourly_scores(
    samples: DataFrame,
    actuals: DataFrame,
    sample_keys: Sequence[str],
    value: str = "x",
    y: str = "y",
    pinball_levels: Sequence[float] = PINBALL_LEVELS,
    alpha: float = WINKLER_ALPHA,
    standard_winkler: bool = False,
) -> DataFrame:
    """E1-E5 per forecast hour: ``crps``, ``abs_err``/``sq_err`` of the sample mean,
    ``pinball_qNN`` and ``winkler``.  Keys = sample keys plus the observation keys
    that are not join keys (typically ``date``); join keys are the shared columns."""
    sample_keys = list(sample_keys)
    join_keys = [c for c in actuals.columns if c in sample_keys]
    extra = [c for c in actuals.columns if c not in sample_keys and c != y]
    out_keys = sample_keys + extra
    lo, hi = winkler_levels(alpha)
    levels = list(pinball_levels) + [lo, hi]
    names = [f"_pb{i}" for i in range(len(pinball_levels))] + ["_lo", "_hi"]
    summ = sample_summary(samples, sample_keys, value, levels, names)

    forecasts = samples.where(F.col(value).isNotNull()).select(*sample_keys).distinct()
    met = forecasts.join(actuals.select(*join_keys, *extra, y), on=join_keys, how="inner")
    rows = orderstats.ranked(samples, sample_keys, value, marks=met.select(*sample_keys, F.col(y).cast("double").alias(value)))
    summ = orderstats.summary_from_ranked(rows, sample_keys, value, levels, names)
    summ = summ.select(*sample_keys, "n", "sum_x", (F.col("sum_x") / F.col("n")).alias("mean_x"), "gini_sum", *names)
    below = rows.select(*sample_keys, F.col(value).alias("_x"), orderstats.BEFORE, orderstats.SBEFORE)
    at = met.withColumn("_x", F.col(y).cast("double")).join(below, on=[*sample_keys, "_x"], how="left")
    j = at.join(summ, on=sample_keys, how="inner")
    # E1 term 1: n * mean |x - y| = y * below - sum below + sum above - y * above.
    under, total = F.col(orderstats.BEFORE), F.col(orderstats.SBEFORE)
    j = j.withColumn("_mad", (F.col(y) * (2 * under - F.col("n")) + F.col("sum_x") - 2 * total) / F.col("n"))
    yy, mean = F.col(y), F.col("mean_x")
    cols = [
        *out_keys,
        "n",
        y,
        "mean_x",
        (F.col("_mad") - F.col("gini_sum") / (F.col("n") * F.col("n"))).alias("crps"),
        F.abs(yy - mean).alias("abs_err"),
        F.pow(yy - mean, 2).alias("sq_err"),
    ]
    for i, q in enumerate(pinball_levels):
        cols.append(pinball(float(q), yy, F.col(f"_pb{i}")).alias(f"pinball_{level_name(q)}"))
    cols.append(winkler(yy, F.col("_lo"), F.col("_hi"), alpha, standard_winkler).alias("winkler"))
    return j.select(*cols)


def daily_metrics(hourly: DataFrame, day_keys: Sequence[str], pinball_levels: Sequence[float] = PINBALL_LEVELS, hours: int = 24) -> DataFrame:
    """Per day: mean CRPS over hours, MAE, RMSE (per day), pinball per level and
    their mean, Winkler.  Days that have not exactly ``hours`` hours are skipped."""
    pb = [f"pinball_{level_name(q)}" for q in pinball_levels]
    agg = hourly.groupBy(*day_keys).agg(
        F.count(F.lit(1)).alias("hours"),
        F.avg("crps").alias("crps"),
        F.avg("abs_err").alias("mae"),
        F.sqrt(F.avg("sq_err")).alias("rmse"),
        *[F.avg(c).alias(c) for c in pb],
        F.avg("winkler").alias("winkler"),
    ).where(F.col("hours") == hours)
    mean_pb = sum((F.col(c) for c in pb), F.lit(0.0)) / len(pb)
    return agg.withColumn("pinball_mean", mean_pb)


def overall_metrics(daily: DataFrame, keys: Sequence[str], pinball_levels: Sequence[float] = PINBALL_LEVELS) -> DataFrame:
    """Over days: mean / median / population std of CRPS, MAE, RMSE, Winkler;
    mean of each pinball column.  Group size = number of days (bounded)."""
    aggs = [F.count(F.lit(1)).alias("total_days")]
    for m in ("crps", "mae", "rmse", "winkler"):
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.median(m).alias(f"{m}_median"),
            F.stddev_pop(m).alias(f"{m}_std"),
        ]
    for q in pinball_levels:
        aggs.append(F.avg(f"pinball_{level_name(q)}").alias(f"pinball_{level_name(q)}"))
    aggs.append(F.avg("pinball_mean").alias("pinball_mean"))
    return daily.groupBy(*keys).agg(*aggs)


def comparison_rollup(daily: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Mean daily metrics at every prefix of ``levels`` (zone, model, run) with
    totals; ``grouping_level`` counts rolled-up columns."""
    return daily.rollup(*levels).agg(
        F.grouping_id().alias("grouping_level"),
        F.count(F.lit(1)).alias("days"),
        F.avg("crps").alias("crps"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("pinball_mean").alias("pinball_mean"),
        F.avg("winkler").alias("winkler"),
    )


MODEL_TABLE_METRICS = ("mae", "rmse", "crps", "pinball_10", "winkler")


def model_table(daily: DataFrame, model_keys: Sequence[str], zone: str = "zone") -> DataFrame:
    """E12 + F1: per model, the mean over days in each zone, then the unweighted mean
    over zones (``mean_of_days``); ``{metric}_rank`` with ties at the minimum rank."""
    per_zone = daily.groupBy(*model_keys, zone).agg(
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("crps").alias("crps"),
        F.avg("pinball_q10").alias("pinball_10"),
        F.avg("winkler").alias("winkler"),
    )
    tab = per_zone.groupBy(*model_keys).agg(
        F.count(F.lit(1)).alias("zones"), *[F.avg(m).alias(m) for m in MODEL_TABLE_METRICS]
    )
    return rank_models(tab, MODEL_TABLE_METRICS)


def unpivot_metrics(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric table to long ``(ids..., metric, value)``."""
    return table.unpivot(list(ids), list(metrics), "metric", "value")


def rank_models(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``rank() over (order by metric)`` per metric (tiny aggregated table)."""
    return table.withColumns({f"{m}_rank": F.rank().over(Window.orderBy(F.col(m).asc_nulls_last())) for m in metrics})


# ------------------------------------------------------------------ summaries
def forecast_stats(
    samples: DataFrame,
    keys: Sequence[str],
    value: str = "x",
    levels: Sequence[float] = STAT_LEVELS,
    names: Sequence[str] = STAT_NAMES,
    threshold: float = STATE_THRESHOLD,
) -> DataFrame:
    """E6-E8 per key: mean, median, population std, percentiles, exceedance
    probabilities and the market state label."""
    keys = list(keys)
    x = F.col(value)
    moments = samples.where(x.isNotNull()).groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.avg((x > threshold).cast("double")).alias("up_prob"),
        F.avg((x < -threshold).cast("double")).alias("down_prob"),
    )
    qs = orderstats.quantiles_wide(samples, keys, value, [0.5, *levels], ["median", *names])
    out = moments.join(qs, on=keys, how="inner")
    return out.withColumns(
        {
            "normal_prob": 1.0 - F.col("up_prob") - F.col("down_prob"),
            "state": market_state(F.col("up_prob"), F.col("down_prob")),
        }
    )


def exceedance(samples: DataFrame, keys: Sequence[str], value: str = "x", threshold: float = STATE_THRESHOLD) -> DataFrame:
    """E7/E8 only: exceedance probabilities and the state (no percentiles needed)."""
    x = F.col(value)
    p = samples.where(x.isNotNull()).groupBy(*keys).agg(
        F.avg((x > threshold).cast("double")).alias("up_prob"),
        F.avg((x < -threshold).cast("double")).alias("down_prob"),
    )
    return p.withColumns(
        {
            "normal_prob": 1.0 - F.col("up_prob") - F.col("down_prob"),
            "state": market_state(F.col("up_prob"), F.col("down_prob")),
        }
    )


def unpivot_quantiles(df: DataFrame, ids: Sequence[str], value: str = "x") -> DataFrame:
    """``qNN`` columns to long ``(q, value)`` rows with ``q = NN / 100``."""
    qcols = [c for c in df.columns if len(c) == 3 and c[0] == "q" and c[1:].isdigit()]
    long = df.unpivot(list(ids), qcols, "qname", value)
    return long.withColumn("q", F.substring("qname", 2, 2).cast("double") / 100).drop("qname")


def market_state(up: Column, down: Column) -> Column:
    """Up if P(up) > P(down), down if the reverse, else normal."""
    return (
        F.when(up > down, F.lit("up_regulation"))
        .when(down > up, F.lit("down_regulation"))
        .otherwise(F.lit("normal"))
    )


# ------------------------------------------------------------------ regional
def regional_matrix(hourly: DataFrame, models: Sequence[str], zone: str = "zone", model: str = "model") -> DataFrame:
    """Zone x model CRPS, mean over all scored hours (``mean_of_hours``);
    missing combinations are null."""
    return hourly.groupBy(zone).pivot(model, list(models)).agg(F.avg("crps"))


def regional_gap(matrix_long: DataFrame, model_col: str = "model", zone: str = "zone", value: str = "crps") -> DataFrame:
    """Per model best and worst zone, mean/min/max and the gap in %."""
    return matrix_long.groupBy(model_col).agg(
        F.avg(value).alias("mean_crps"),
        F.min(value).alias("min_crps"),
        F.max(value).alias("max_crps"),
        F.min_by(zone, value).alias("best_zone"),
        F.max_by(zone, value).alias("worst_zone"),
    ).withColumn(
        "gap_pct",
        F.when(F.col("min_crps") != 0, (F.col("max_crps") - F.col("min_crps")) / F.col("min_crps") * 100),
    )


# ------------------------------------------------------------------ validation
def validation_pinball(preds: DataFrame, keys: Sequence[str], q: str = "q", pred: str = "pred", y: str = "y") -> DataFrame:
    """Mean pinball per (keys, hour, q) over rows, then the mean over hours and q."""
    per = preds.groupBy(*keys, "hour", q).agg(F.avg(pinball(F.col(q), F.col(y), F.col(pred))).alias("loss"))
    return per.groupBy(*keys).agg(F.avg("loss").alias("val_pinball"), F.count(F.lit(1)).alias("cells"))


def pinball_by_hour(preds: DataFrame, keys: Sequence[str], q: str = "q", pred: str = "pred", y: str = "y") -> DataFrame:
    """Average quantile loss per hour (over rows and levels)."""
    per = preds.groupBy(*keys, "hour", q).agg(F.avg(pinball(F.col(q), F.col(y), F.col(pred))).alias("loss"))
    return per.groupBy(*keys, "hour").agg(F.avg("loss").alias("loss"))


# ------------------------------------------------------------------ descriptive
def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample std, population skewness / excess kurtosis, min,
    quartiles, max."""
    keys = list(keys)
    x = F.col(value)
    mom = df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    qs = orderstats.quantiles_wide(df, keys, value, (0.25, 0.5, 0.75), ("p25", "p50", "p75"))
    return mom.join(qs, on=keys, how="inner")
