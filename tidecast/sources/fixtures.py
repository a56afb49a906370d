"""Inputs in the shapes the operators expect, derived by query from the driver tables.

These builders only reshape driver rows (see FIXTURES.md); the operators they feed do
all the work.  ``events`` stands in for an hourly market panel: ``event_type`` is the
zone, event values aggregated per hour are the panel columns, and historical event
values of the same zone and hour-of-day are the predictive samples of three
"forecasters" that differ only in their history window.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load

@dataclass(frozen=True)
class Span:
    """The days of ``events``, first and last included, and the dates that divide them: the
    first third is one history, the rest up to ``evaluation`` (seven tenths) another, and the
    rows from ``validation`` (seven ninths) on judge fitted models."""

    first: dt.date
    last: dt.date

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1

    def _at(self, days: int) -> dt.date:
        return self.first + dt.timedelta(days=days)

    @property
    def evaluation(self) -> dt.date:
        return self._at(self.days * 7 // 10)

    @property
    def validation(self) -> dt.date:
        return self._at(self.days * 7 // 9)

    @property
    def windows(self) -> tuple[tuple[str, str, dt.date, dt.date], ...]:
        """(model, run_id, first day, last day) of the three forecasters' histories."""
        third, end = self._at(self.days // 3), self.evaluation - dt.timedelta(days=1)
        return (("hist", "1", self.first, end), ("early", "2", self.first, third - dt.timedelta(days=1)), ("late", "3", third, end))


def span(spark: SparkSession, sf_dir: str) -> Span:
    """First and last day of the events (one row; an empty table has one empty day)."""
    low, high = load(spark, sf_dir, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    none = dt.date(1970, 1, 1)
    return Span(low or none, high or none)


PANEL_COLUMNS = ("premium", "price_up", "price_down", "vol_up", "vol_down")
FORECAST_LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)
QUANTILE_MODEL_LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def hourly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.groupBy(
        F.col("event_type").alias("zone"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    ).agg(
        F.avg("value").alias("premium"),
        F.max("value").alias("price_up"),
        F.min("value").alias("price_down"),
        F.sum("value").alias("vol_up"),
        F.count(F.lit(1)).cast("double").alias("vol_down"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free panel: per-zone hourly spine (C1) with forward fill (C20, no limit)."""
    from ..operators import panel

    raw = hourly_raw(spark, sf_dir)
    spine = panel.hourly_spine(raw, "zone", "ts")
    full = spine.join(raw, on=["zone", "ts"], how="left")
    return panel.forward_fill(full, ["zone"], "ts", list(PANEL_COLUMNS))


def order_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of hourly order values per priority, in UTC and without gaps: an order counts in
    hour ``o_orderkey mod 24`` of its date; hours without orders have value 0."""
    from ..operators import panel

    o = load(spark, sf_dir, "orders").withColumn("ts", F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate").cast("timestamp_ntz")))
    raw = o.groupBy(F.col("o_orderpriority").alias("zone"), "ts").agg(F.sum("o_totalprice").alias("value"))
    return panel.hourly_spine(raw, "zone", "ts").join(raw, on=["zone", "ts"], how="left").fillna(0.0, ["value"])


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).where(F.col("ts") >= F.lit(dt.datetime.combine(span(spark, sf_dir).evaluation, dt.time())))
    return h.select(
        "zone",
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.col("premium").alias("y"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of ``events``: each event becomes a sample of every forecaster whose
    history window contains its day (the windows overlap, so up to two rows)."""
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    day = F.to_date("ts")
    windows = span(spark, sf_dir).windows
    first, last = min(d0 for _, _, d0, _ in windows), max(d1 for _, _, _, d1 in windows)
    wins = F.array_compact(
        F.array(
            *[
                F.when((day >= F.lit(d0)) & (day <= F.lit(d1)), F.struct(F.lit(m).alias("model"), F.lit(r).alias("run_id")))
                for m, r, d0, d1 in windows
            ]
        )
    )
    out = ev.where((day >= F.lit(first)) & (day <= F.lit(last))).select("*", F.explode(wins).alias("_w"))
    return out.select(
        F.col("_w.model").alias("model"),
        F.col("_w.run_id").alias("run_id"),
        F.col("event_type").alias("zone"),
        F.hour("ts").alias("hour"),
        F.col("event_id").alias("sample_id"),
        F.col("value").alias("x"),
    )


def settlement_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (zone, date, hour): day-ahead price, activation flag, imbalance MW."""
    h = hourly(spark, sf_dir)
    w = Window.partitionBy("zone").orderBy("ts")
    return h.select(
        "zone",
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.col("price_down").alias("da_price"),
        (F.hour("ts") % 3 == 0).alias("activated"),
        F.coalesce(F.col("vol_up") - F.lag("vol_up").over(w), F.lit(0.0)).alias("imbalance_mw"),
    )


def strategies(spark: SparkSession) -> DataFrame:
    """The eight strategy rows with the rule defaults of the bidding study (fixed values)."""
    rows = [
        # strategy, rule, model, threshold, prob, da_price, alpha, risk
        ("Naive", "naive", "late", None, None, None, None, None),
        ("Point Forecast", "point", "late", 50.0, None, None, None, None),
        ("PT-Normal", "prob_threshold", "hist", 60.0, 0.7, None, None, None),
        ("EV-Normal", "expected_value", "hist", None, None, 60.0, None, None),
        ("CVaR-Normal", "cvar", "hist", None, None, 60.0, 0.95, 0.3),
        ("PT-Skewed-t", "prob_threshold", "late", 60.0, 0.7, None, None, None),
        ("EV-Skewed-t", "expected_value", "late", None, None, 60.0, None, None),
        ("CVaR-Skewed-t", "cvar", "late", None, None, 60.0, 0.95, 0.3),
    ]
    schema = (
        "strategy string, rule string, model string, threshold double, prob double, "
        "da_price double, alpha double, risk double"
    )
    return spark.createDataFrame(rows, schema)


def forecast_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report-style forecast per (model, zone, date, hour): mean, median, std,
    q05/q25/q75/q95 of the samples and the realised value."""
    from ..operators import orderstats

    s = samples(spark, sf_dir)
    keys = ["model", "zone", "hour"]
    mom = s.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    qs = orderstats.quantiles_wide(s, keys, "x", (0.5, *FORECAST_LEVELS[:2], *FORECAST_LEVELS[3:]),
                                   ("median", "q05", "q25", "q75", "q95"))
    a = actuals(spark, sf_dir)
    return (
        mom.join(qs, on=keys)
        .join(a, on=["zone", "hour"])
        .select("model", "zone", "date", "hour", "mean", "median", "std", "q05", "q25", "q75", "q95",
                F.col("y").alias("realized"))
    )


def quantile_fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile-model style forecast: (model, zone, hour, q, value) at seven levels."""
    from ..operators import orderstats

    lng = orderstats.quantiles_long(samples(spark, sf_dir), ["model", "zone", "hour"], "x", QUANTILE_MODEL_LEVELS)
    return lng.select("model", "zone", "hour", "q", "value")


def param_fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parametric forecast (loc, scale, tailweight, skewness, a, b) per
    (model, zone, hour), moment-fitted to the samples."""
    from ..operators import ensemble

    return ensemble.fit_parameters(samples(spark, sf_dir), ["model", "zone", "hour"])
