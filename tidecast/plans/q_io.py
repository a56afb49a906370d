"""Source/sink round trips in the shared folder: A2, A3, A5-A9, A11-A14.

Each query writes a table derived from the driver tables, reads it back with an
explicit schema and returns what was read, so the oracle compares the round trip
with the original."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, ensemble, scores
from ..sources import fixtures as fx
from ..sources import forecast_io as io
from .oracle import with_fixtures
from .q_forecasts import _ST, _STAT_COLS, SK
from .q_panel import _SCALE_LOCAL, _scaler
from .registry import query
from .util import r, rounded

FW_SCHEMA = (
    "hour int, mean double, median double, std double, q05 double, q25 double, q75 double, q95 double, "
    "realized double, model string, zone string, date date"
)
FW_COLS = ["mean", "median", "std", "q05", "q25", "q75", "q95", "realized"]


@query(
    "a2_scan_forecast_csv",
    with_fixtures("SELECT model, zone, date, hour, " + ", ".join(r(c, c) for c in FW_COLS) + " FROM forecast_wide", "forecast_wide"),
)
def a2_scan_forecast_csv(spark, sf):
    path = io.scratch_root(spark, "forecast_csv")
    io.write_partitioned(fx.forecast_wide(spark, sf), path, ["model", "zone", "date"], fmt="csv")
    back = io.read_csv(spark, path, FW_SCHEMA, skip_suffix="_state.json")
    return rounded(back.select("model", "zone", "date", "hour", *FW_COLS))


PARAM_FIELDS = ["loc", "scale", "tailweight", "skewness", "a", "b"]
PARAM_SCHEMA = "zone string, " + ", ".join(f"{f} array<double>" for f in PARAM_FIELDS) + ", model string"


@query(
    "a3_a10_param_json",
    with_fixtures("SELECT model, zone, CAST(hour AS INTEGER) AS hour, " + ", ".join(r(c, c) for c in PARAM_FIELDS) + " FROM param_fc", "param_fc"),
)
def a3_a10_param_json(spark, sf):
    path = io.scratch_root(spark, "params_json")
    io.write_params_json(fx.param_fc(spark, sf), path, ["model", "zone"], "hour", PARAM_FIELDS, ["model"])
    back = io.read_json(spark, path, PARAM_SCHEMA, skip_suffix="_state.json")
    return rounded(io.arrays_to_hours(back, ["model", "zone"], PARAM_FIELDS))


def _stats_layout(spark, sf):
    """Forecast statistics of every run plus a horizontal-ensemble run ``hEns`` of the
    ``hist`` family, written into one partitioned layout and read back."""
    path = io.scratch_root(spark, "forecast_stats")
    s = fx.samples(spark, sf)
    stats = scores.forecast_stats(s, SK)
    io.write_partitioned(stats, path, ["zone", "model", "run_id"])
    qf = ensemble.horizontal(s, ["zone", "hour"], "model", "x").select("zone", "hour", "q", "value")
    ens = scores.forecast_stats(ensemble.sample_quantile_function(qf, ["zone", "hour"], 200), ["zone", "hour"])
    ens = ens.withColumns({"model": F.lit("hist"), "run_id": F.lit("hEns")}).select(*stats.columns)
    io.write_partitioned(ens, path, ["zone", "model", "run_id"])  # dynamic overwrite: adds partitions
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))


@query("a5_discover_runs", with_fixtures("SELECT DISTINCT zone, model, run_id FROM samples", "samples"))
def a5_discover_runs(spark, sf):
    return io.discover_runs(_stats_layout(spark, sf), ["zone", "model"])


@query("a6_zone_model_pairs", with_fixtures("SELECT DISTINCT zone, model FROM samples", "samples"))
def a6_zone_model_pairs(spark, sf):
    return io.zone_model_pairs(_stats_layout(spark, sf))


@query("a7_latest_run")
def a7_latest_run(spark, sf):
    """A7 (rows-only: file times): newest run per (zone, model) in the written layout."""
    return io.latest_run(_stats_layout(spark, sf), ["zone", "model"])


@query(
    "a9_write_forecast_stats",
    with_fixtures("SELECT model, run_id, zone, hour, state, " + ", ".join(r(c, c) for c in _STAT_COLS) + " FROM st", "samples", local=_ST),
)
def a9_write_forecast_stats(spark, sf):
    back = io.discover_runs(_stats_layout(spark, sf), [c for c in SK if c != "run_id"] + ["state", *_STAT_COLS])
    return rounded(back.select(*SK, "state", *_STAT_COLS))


@query(
    "a8_write_hourly",
    with_fixtures("SELECT zone, ts, " + ", ".join(r(c, c) for c in fx.PANEL_COLUMNS) + " FROM hourly", "hourly"),
)
def a8_write_hourly(spark, sf):
    path = io.scratch_root(spark, "hourly")
    io.write_panel(fx.hourly(spark, sf), path)
    return rounded(spark.read.parquet(path).select("zone", "ts", *fx.PANEL_COLUMNS))


@query(
    "a11_write_training_tables",
    with_fixtures(f"SELECT zone, feature, CAST(hour AS INTEGER) AS hour, {r('mu', 'mu')}, {r('sigma', 'sigma')} FROM sc", "hourly", local=_SCALE_LOCAL),
)
def a11_write_training_tables(spark, sf):
    sc, lf = _scaler(spark, sf)
    root = io.scratch_root(spark, "training")
    sc.write.mode("overwrite").partitionBy("zone").parquet(f"{root}/scaler")
    lf.groupBy("zone", "feature").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/feature_groups")
    lf.write.mode("overwrite").partitionBy("zone").parquet(f"{root}/matrix_long")
    back = spark.read.parquet(f"{root}/scaler")
    return rounded(back.select("zone", "feature", F.col("hour").cast("int").alias("hour"), "mu", "sigma"))


@query("a12_report_csv")
def a12_report_csv(spark, sf):
    """A12 (rows-only: formatted text): the model table as CSV with two decimals."""
    from .q_scores import daily

    tab = scores.model_table(daily(spark, sf), ["model"])
    path = io.scratch_root(spark, "report")
    io.write_report_csv(tab, path, 2)
    return spark.read.option("header", True).csv(path)


@query(
    "a13_write_samples",
    with_fixtures(f"SELECT model, run_id, zone, CAST(hour AS INTEGER) AS hour, sample_id, {r('x', 'x')} FROM samples", "samples"),
)
def a13_write_samples(spark, sf):
    path = io.scratch_root(spark, "samples")
    io.write_partitioned(fx.samples(spark, sf), path, ["model"])
    back = spark.read.schema("run_id string, zone string, hour int, sample_id long, x double, model string").parquet(path)
    return rounded(back.select("model", "run_id", "zone", "hour", "sample_id", "x"))


_SUMMARY_SCHEMA = (
    "model string, run_id string, zone string, overall_mean double, peak_hours array<int>, peak_mean double, "
    "volatile_hours array<int>, volatile_std double, high_value_hours array<int>, high_risk_hours array<int>"
)


@query(
    "a14_summary_json",
    with_fixtures(
        "SELECT model, run_id, zone, " + r("any_value(dm)", "overall_mean") + ", "
        "coalesce(array_to_string(list_sort(list(hour) FILTER (WHERE mean > dm)), ','), '') AS peak_hours, "
        + r("avg(mean) FILTER (WHERE mean > dm)", "peak_mean")
        + " FROM (SELECT *, avg(mean) OVER (PARTITION BY model, run_id, zone) AS dm FROM st) GROUP BY model, run_id, zone",
        "samples",
        local=_ST,
    ),
)
def a14_summary_json(spark, sf):
    summ = calibration.daily_summary(scores.forecast_stats(fx.samples(spark, sf), SK), ["model", "run_id", "zone"])
    path = io.scratch_root(spark, "summary_json")
    io.write_json_rows(summ, path)
    back = spark.read.text(path).select(F.from_json("value", _SUMMARY_SCHEMA).alias("j")).select("j.*")
    return rounded(back.select("model", "run_id", "zone", "overall_mean", F.array_join("peak_hours", ",").alias("peak_hours"), "peak_mean"))


