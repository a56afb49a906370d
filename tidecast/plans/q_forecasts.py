"""Forecast summaries, quantile-grid scoring, regional tables, calibration and daily
summaries: E6-E8, E13-E18, E20-E30, B12, B14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, scores
from ..session import materialize
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

SK = ["model", "run_id", "zone", "hour"]
_STAT_COLS = ("mean", "median", "std", *scores.STAT_NAMES, "up_prob", "down_prob", "normal_prob")
_STATS_SQL = (
    "SELECT model, run_id, zone, hour, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS std, "
    + ", ".join(f"quantile_cont(x, {q!r}) AS {nm}" for q, nm in zip(scores.STAT_LEVELS, scores.STAT_NAMES))
    + ", avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) AS up_prob, avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END) AS down_prob"
    + " FROM samples GROUP BY model, run_id, zone, hour"
)
_STATE_SQL = (
    "CASE WHEN up_prob > down_prob THEN 'up_regulation' WHEN down_prob > up_prob THEN 'down_regulation' "
    "ELSE 'normal' END"
)
_ST = [("st0", _STATS_SQL), ("st", f"SELECT *, 1.0 - up_prob - down_prob AS normal_prob, {_STATE_SQL} AS state FROM st0")]


def _stats(spark, sf):
    return scores.forecast_stats(fx.samples(spark, sf), SK)


@query(
    "e6_forecast_stats",
    with_fixtures("SELECT model, run_id, zone, hour, state, " + ", ".join(r(c, c) for c in _STAT_COLS) + " FROM st", "samples", local=_ST),
)
def e6_forecast_stats(spark, sf):
    return rounded(_stats(spark, sf).select(*SK, "state", *_STAT_COLS))


@query(
    "e7_exceedance",
    with_fixtures(
        "SELECT model, run_id, zone, hour, " + ", ".join(r(c, c) for c in ("up_prob", "down_prob", "normal_prob")) + " FROM st",
        "samples",
        local=_ST,
    ),
)
def e7_exceedance(spark, sf):
    return rounded(scores.exceedance(fx.samples(spark, sf), SK).select(*SK, "up_prob", "down_prob", "normal_prob"))


@query("e8_state", with_fixtures("SELECT model, run_id, zone, hour, state FROM st", "samples", local=_ST))
def e8_state(spark, sf):
    return scores.exceedance(fx.samples(spark, sf), SK).select(*SK, "state")


# ------------------------------------------------------------ quantile-grid scoring
QG_KEYS = ["model", "zone", "date", "hour"]


def _grid_hourly(spark, sf):
    # read twice below (quantile columns and realised values): materialize once
    fw = materialize(fx.forecast_wide(spark, sf))
    long = scores.unpivot_quantiles(fw.select(*QG_KEYS, "q05", "q25", "q75", "q95"), QG_KEYS)
    obs = fw.select(*QG_KEYS, F.col("realized").alias("y"))
    return scores.hourly_scores(long, obs, QG_KEYS)


_QG = [
    (
        "ql",
        """SELECT model, zone, date, hour, x, realized FROM forecast_wide
    UNPIVOT (x FOR qname IN (q05, q25, q75, q95))""",
    ),
    (
        "qr",
        """SELECT model, zone, date, hour, x, realized,
           row_number() OVER (PARTITION BY model, zone, date, hour ORDER BY x) AS i,
           count(*) OVER (PARTITION BY model, zone, date, hour) AS n FROM ql""",
    ),
    (
        "qh",
        """SELECT model, zone, date, hour, avg(abs(x - realized)) - sum((2 * i - n - 1) * x) / (any_value(n) * any_value(n)) AS crps
    FROM qr GROUP BY model, zone, date, hour""",
    ),
    ("qz", "SELECT zone, model, avg(crps) AS crps FROM qh GROUP BY zone, model"),
]


def _qg_sql(body):
    return with_fixtures(body, "forecast_wide", local=_QG)


@query("e13_quantile_grid_crps", _qg_sql(f"SELECT model, zone, date, hour, {r('crps', 'crps')} FROM qh"))
def e13_quantile_grid_crps(spark, sf):
    return rounded(_grid_hourly(spark, sf).select(*QG_KEYS, "crps"))


def _zone_model(spark, sf):
    return _grid_hourly(spark, sf).groupBy("zone", "model").agg(F.avg("crps").alias("crps"))


@query(
    "e14_regional_matrix",
    _qg_sql(
        "SELECT zone, "
        + ", ".join(r(f"avg(crps) FILTER (WHERE model = '{m}')", m) for m in ("early", "hist", "late"))
        + " FROM qh GROUP BY zone"
    ),
)
def e14_regional_matrix(spark, sf):
    return rounded(scores.regional_matrix(_grid_hourly(spark, sf), ["early", "hist", "late"]))


@query(
    "e15_regional_gap",
    _qg_sql(
        "SELECT model, arg_min(zone, crps) AS best_zone, arg_max(zone, crps) AS worst_zone, "
        + r("CASE WHEN min(crps) <> 0 THEN (max(crps) - min(crps)) / min(crps) * 100 END", "gap_pct")
        + " FROM qz GROUP BY model"
    ),
)
def e15_regional_gap(spark, sf):
    return rounded(scores.regional_gap(_zone_model(spark, sf)).select("model", "best_zone", "worst_zone", "gap_pct"))


@query(
    "e16_zone_range",
    _qg_sql(
        "SELECT model, arg_min(zone, crps) AS best_zone, arg_max(zone, crps) AS worst_zone, "
        + ", ".join([r("avg(crps)", "mean_crps"), r("min(crps)", "min_crps"), r("max(crps)", "max_crps")])
        + " FROM qz GROUP BY model"
    ),
)
def e16_zone_range(spark, sf):
    return rounded(scores.regional_gap(_zone_model(spark, sf)).select("model", "best_zone", "worst_zone", "mean_crps", "min_crps", "max_crps"))


# ------------------------------------------------------------ validation pinball
def _qpreds(spark, sf):
    q = fx.quantile_fc(spark, sf).withColumnRenamed("value", "pred")
    return q.join(fx.actuals(spark, sf), on=["zone", "hour"])


_VP = [
    (
        "vp",
        """SELECT q.model, q.zone, q.hour, q.q,
           avg(CASE WHEN a.y >= q.value THEN q.q * (a.y - q.value) ELSE (1 - q.q) * (q.value - a.y) END) AS loss
    FROM quantile_fc q JOIN actuals a ON a.zone = q.zone AND a.hour = q.hour
    GROUP BY q.model, q.zone, q.hour, q.q""",
    )
]


@query(
    "e17_validation_pinball",
    with_fixtures(
        f"SELECT model, zone, {r('avg(loss)', 'val_pinball')}, count(*) AS cells FROM vp GROUP BY model, zone",
        "quantile_fc",
        "actuals",
        local=_VP,
    ),
)
def e17_validation_pinball(spark, sf):
    return rounded(scores.validation_pinball(_qpreds(spark, sf), ["model", "zone"]))


@query(
    "e20_pinball_by_hour",
    with_fixtures(
        f"SELECT model, zone, hour, {r('avg(loss)', 'loss')} FROM vp GROUP BY model, zone, hour",
        "quantile_fc",
        "actuals",
        local=_VP,
    ),
)
def e20_pinball_by_hour(spark, sf):
    return rounded(scores.pinball_by_hour(_qpreds(spark, sf), ["model", "zone"]))


# ------------------------------------------------------------ descriptive statistics
@query(
    "e18_describe",
    with_fixtures(
        "SELECT zone, count(premium) AS count, "
        + ", ".join(
            [
                r("avg(premium)", "mean"),
                r("stddev_samp(premium)", "std"),
                r("CASE WHEN avg(pow(premium - mp, 2)) > 0 THEN avg(pow(premium - mp, 3)) / pow(avg(pow(premium - mp, 2)), 1.5) END", "skew"),
                r("kurtosis_pop(premium)", "kurtosis"),
                r("min(premium)", "min"),
                r("max(premium)", "max"),
                r("quantile_cont(premium, 0.25)", "p25"),
                r("quantile_cont(premium, 0.5)", "p50"),
                r("quantile_cont(premium, 0.75)", "p75"),
            ]
        )
        + " FROM (SELECT *, avg(premium) OVER (PARTITION BY zone) AS mp FROM hourly) GROUP BY zone",
        "hourly",
    ),
)
def e18_describe(spark, sf):
    return rounded(scores.describe(fx.hourly(spark, sf), ["zone"], "premium"))


# ------------------------------------------------------------ calibration
_LEVELS = calibration.nominal_levels(10)
_LV_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {v!r})" for i, v in enumerate(_LEVELS)) + ") t(level_idx, nominal)"
_CAL = [
    ("lv", _LV_SQL),
    (
        "cal",
        """SELECT f.model, CAST(lv.level_idx AS INTEGER) AS level_idx, lv.nominal,
           avg(CASE WHEN f.realized >= f.mean - (f.mean - f.q05) * (lv.nominal / 0.9)
                     AND f.realized <= f.mean + (f.q95 - f.mean) * (lv.nominal / 0.9) THEN 1.0 ELSE 0.0 END) AS empirical,
           avg((f.mean + (f.q95 - f.mean) * (lv.nominal / 0.9)) - (f.mean - (f.mean - f.q05) * (lv.nominal / 0.9))) AS width
    FROM forecast_wide f CROSS JOIN lv GROUP BY f.model, lv.level_idx, lv.nominal""",
    ),
]


def _curve(spark, sf):
    return calibration.calibration_curve(fx.forecast_wide(spark, sf), ["model"])


@query(
    "e21_calibration_curve",
    with_fixtures(
        "SELECT model, level_idx, "
        + ", ".join([r("nominal", "nominal"), r("empirical", "empirical"), r("width", "width")])
        + ", abs(empirical - nominal) <= 0.1 AS within_tol FROM cal",
        "forecast_wide",
        local=_CAL,
    ),
)
def e21_calibration_curve(spark, sf):
    return rounded(_curve(spark, sf).select("model", "level_idx", "nominal", "empirical", "width", "within_tol"))


@query(
    "e22_sharpness",
    with_fixtures(
        "SELECT model, "
        + ", ".join([r("avg(width)", "sharpness"), r("avg(abs(empirical - nominal))", "calibration_error")])
        + ", CAST(sum(CASE WHEN abs(empirical - nominal) <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS levels_within_tol"
        " FROM cal GROUP BY model",
        "forecast_wide",
        local=_CAL,
    ),
)
def e22_sharpness(spark, sf):
    return rounded(calibration.sharpness(_curve(spark, sf), ["model"]))


@query(
    "e24_spike_week",
    with_fixtures(
        "SELECT model, zone, CAST(row_number() OVER (PARTITION BY model, zone ORDER BY date, hour) - 1 AS INTEGER) AS hour_offset, "
        + ", ".join([r("mean", "mean"), r("q05", "lower90"), r("q95", "upper90"), r("realized", "realized")])
        + " FROM forecast_wide, span WHERE date >= d_val AND date < d_val + 7",
        "forecast_wide",
        "span",
    ),
)
def e24_spike_week(spark, sf):
    fw = fx.forecast_wide(spark, sf).withColumn("ts", F.timestamp_add("HOUR", F.col("hour"), F.col("date").cast("timestamp_ntz")))
    wk = calibration.spike_week(fw, ["model", "zone"], "ts", fx.span(spark, sf).validation)
    return rounded(wk.select("model", "zone", F.col("hour_offset").cast("int").alias("hour_offset"), "mean", "lower90", "upper90", "realized"))


@query(
    "e29_heat_bands",
    with_fixtures(
        " UNION ALL ".join(
            f"SELECT model, '{kind}' AS kind, CAST({band} AS VARCHAR) AS band, {r('avg(crps)', 'crps')}, count(*) AS n FROM qh GROUP BY model, {band}"
            for kind, band in (
                ("hour", "CAST(hour AS INTEGER)"),
                ("day_of_week", "CAST(isodow(date) - 1 AS INTEGER)"),
                ("season", "CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"),
            )
        ),
        "forecast_wide",
        local=_QG,
    ),
)
def e29_heat_bands(spark, sf):
    bands = {"hour": F.col("hour").cast("int"), "day_of_week": F.weekday("date"), "season": calibration.season(F.month("date"))}
    return rounded(calibration.heat_bands_of(_grid_hourly(spark, sf), ["model"], "crps", bands))


@query(
    "e30_interval_coverage",
    with_fixtures(
        f"SELECT model, zone, {r('avg(CASE WHEN realized BETWEEN q05 AND q95 THEN 1.0 ELSE 0.0 END)', 'coverage')}, count(*) AS n"
        " FROM forecast_wide GROUP BY model, zone",
        "forecast_wide",
    ),
)
def e30_interval_coverage(spark, sf):
    return rounded(calibration.interval_coverage(fx.forecast_wide(spark, sf), ["model", "zone"], "realized", "q05", "q95"))


# ------------------------------------------------------------ daily summaries
SUM_KEYS = ["model", "run_id", "zone"]


def _hours_list(cond: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(hour) FILTER (WHERE {cond})), ','), '')"


@query(
    "e25_daily_summary",
    with_fixtures(
        "SELECT model, run_id, zone, "
        + ", ".join(
            [
                r("any_value(dm)", "overall_mean"),
                f"{_hours_list('mean > dm')} AS peak_hours",
                r("avg(mean) FILTER (WHERE mean > dm)", "peak_mean"),
                f"{_hours_list('std > ds')} AS volatile_hours",
                r("avg(std) FILTER (WHERE std > ds)", "volatile_std"),
                f"{_hours_list('mean > p75m')} AS high_value_hours",
                f"{_hours_list('std > p75s')} AS high_risk_hours",
            ]
        )
        + " FROM (SELECT *, avg(mean) OVER w AS dm, avg(std) OVER w AS ds, quantile_cont(mean, 0.75) OVER w AS p75m,"
        " quantile_cont(std, 0.75) OVER w AS p75s FROM st WINDOW w AS (PARTITION BY model, run_id, zone))"
        " GROUP BY model, run_id, zone",
        "samples",
        local=_ST,
    ),
)
def e25_daily_summary(spark, sf):
    d = calibration.daily_summary(_stats(spark, sf), SUM_KEYS)
    lists = ["peak_hours", "volatile_hours", "high_value_hours", "high_risk_hours"]
    return rounded(d.withColumns({c: F.array_join(F.col(c), ",") for c in lists}))


@query(
    "e26_state_summary",
    with_fixtures(
        "SELECT model, run_id, zone, state, array_to_string(list_sort(list(hour)), ',') AS hours, count(*) AS count, "
        + r("avg(mean)", "mean")
        + " FROM st GROUP BY model, run_id, zone, state",
        "samples",
        local=_ST,
    ),
)
def e26_state_summary(spark, sf):
    d = calibration.state_summary(_stats(spark, sf), SUM_KEYS)
    return rounded(d.withColumn("hours", F.array_join("hours", ",")))
