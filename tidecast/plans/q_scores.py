"""Scoring queries: E1-E12, F1 (forecast samples from ``events`` history)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

SAMPLE_KEYS = ["model", "run_id", "zone", "hour"]
DAY_KEYS = ["model", "run_id", "zone", "date"]
LO, HI = scores.winkler_levels()


def hourly_scores(spark, sf):
    return scores.hourly_scores(fx.samples(spark, sf), fx.actuals(spark, sf), SAMPLE_KEYS)


def daily(spark, sf):
    return scores.daily_metrics(hourly_scores(spark, sf), DAY_KEYS)


# --------------------------------------------------------------------- oracle text
SQL_SCORES = [
    (
        "sm",
        f"""SELECT model, run_id, zone, hour, count(*) AS n, avg(x) AS mean_x,
           quantile_cont(x, 0.1) AS pb10, quantile_cont(x, 0.5) AS pb50, quantile_cont(x, 0.9) AS pb90,
           quantile_cont(x, {LO!r}) AS wlo, quantile_cont(x, {HI!r}) AS whi
    FROM samples GROUP BY model, run_id, zone, hour""",
    ),
    (
        "rk",
        """SELECT model, run_id, zone, hour, x,
           row_number() OVER (PARTITION BY model, run_id, zone, hour ORDER BY x) AS i,
           count(*) OVER (PARTITION BY model, run_id, zone, hour) AS n
    FROM samples""",
    ),
    ("gs", "SELECT model, run_id, zone, hour, sum((2 * i - n - 1) * x) AS g FROM rk GROUP BY model, run_id, zone, hour"),
    (
        "t1",
        """SELECT s.model, s.run_id, s.zone, s.hour, a.date, avg(abs(s.x - a.y)) AS mad, any_value(a.y) AS y
    FROM samples s JOIN actuals a ON a.zone = s.zone AND a.hour = s.hour
    GROUP BY s.model, s.run_id, s.zone, s.hour, a.date""",
    ),
    (
        "hs",
        """SELECT t1.model, t1.run_id, t1.zone, t1.date, t1.hour, sm.n, t1.y, sm.mean_x,
           t1.mad - gs.g / (sm.n * sm.n) AS crps,
           abs(t1.y - sm.mean_x) AS abs_err, (t1.y - sm.mean_x) * (t1.y - sm.mean_x) AS sq_err,
           CASE WHEN t1.y >= sm.pb10 THEN 0.1 * (t1.y - sm.pb10) ELSE (1 - 0.1) * (sm.pb10 - t1.y) END AS pinball_q10,
           CASE WHEN t1.y >= sm.pb50 THEN 0.5 * (t1.y - sm.pb50) ELSE (1 - 0.5) * (sm.pb50 - t1.y) END AS pinball_q50,
           CASE WHEN t1.y >= sm.pb90 THEN 0.9 * (t1.y - sm.pb90) ELSE (1 - 0.9) * (sm.pb90 - t1.y) END AS pinball_q90,
           (sm.whi - sm.wlo) + CASE WHEN t1.y < sm.wlo THEN (2 / 0.9) * (sm.wlo - t1.y)
                                    WHEN t1.y > sm.whi THEN (2 / 0.9) * (t1.y - sm.whi) ELSE 0 END AS winkler
    FROM t1 JOIN sm USING (model, run_id, zone, hour) JOIN gs USING (model, run_id, zone, hour)""",
    ),
    (
        "dm",
        """SELECT model, run_id, zone, date, count(*) AS hours, avg(crps) AS crps, avg(abs_err) AS mae,
           sqrt(avg(sq_err)) AS rmse, avg(pinball_q10) AS pinball_q10, avg(pinball_q50) AS pinball_q50,
           avg(pinball_q90) AS pinball_q90, avg(winkler) AS winkler,
           (avg(pinball_q10) + avg(pinball_q50) + avg(pinball_q90)) / 3 AS pinball_mean
    FROM hs GROUP BY model, run_id, zone, date HAVING count(*) = 24""",
    ),
]


def scored_sql(body: str, upto: str = "dm", extra=None) -> str:
    names = [n for n, _ in SQL_SCORES]
    local = SQL_SCORES[: names.index(upto) + 1] + list(extra or [])
    return with_fixtures(body, "samples", "actuals", local=local)


# --------------------------------------------------------------------- queries
@query(
    "e1_crps",
    scored_sql(f"SELECT model, run_id, zone, date, hour, n, {r('crps', 'crps')} FROM hs", "hs"),
)
def e1_crps(spark, sf):
    return rounded(hourly_scores(spark, sf).select(*DAY_KEYS, "hour", "n", "crps"))


@query("e2_mae", scored_sql(f"SELECT model, run_id, zone, date, {r('mae', 'mae')} FROM dm"))
def e2_mae(spark, sf):
    return rounded(daily(spark, sf).select(*DAY_KEYS, "mae"))


@query("e3_rmse", scored_sql(f"SELECT model, run_id, zone, date, {r('rmse', 'rmse')} FROM dm"))
def e3_rmse(spark, sf):
    return rounded(daily(spark, sf).select(*DAY_KEYS, "rmse"))


@query(
    "e4_pinball",
    scored_sql(
        "SELECT model, run_id, zone, date, "
        + ", ".join(r(c, c) for c in ("pinball_q10", "pinball_q50", "pinball_q90", "pinball_mean"))
        + " FROM dm"
    ),
)
def e4_pinball(spark, sf):
    return rounded(daily(spark, sf).select(*DAY_KEYS, "pinball_q10", "pinball_q50", "pinball_q90", "pinball_mean"))


@query("e5_winkler", scored_sql(f"SELECT model, run_id, zone, date, {r('winkler', 'winkler')} FROM dm"))
def e5_winkler(spark, sf):
    return rounded(daily(spark, sf).select(*DAY_KEYS, "winkler"))


_DAILY_COLS = ("crps", "mae", "rmse", "pinball_q10", "pinball_q50", "pinball_q90", "pinball_mean", "winkler")


@query(
    "e9_daily_metrics",
    scored_sql("SELECT model, run_id, zone, date, hours, " + ", ".join(r(c, c) for c in _DAILY_COLS) + " FROM dm"),
)
def e9_daily_metrics(spark, sf):
    return rounded(daily(spark, sf).select(*DAY_KEYS, "hours", *_DAILY_COLS))


_E10 = ", ".join(
    [
        f"{r(f'avg({m})', f'{m}_mean')}, {r(f'median({m})', f'{m}_median')}, {r(f'stddev_pop({m})', f'{m}_std')}"
        for m in ("crps", "mae", "rmse", "winkler")
    ]
    + [r(f"avg({c})", c) for c in ("pinball_q10", "pinball_q50", "pinball_q90", "pinball_mean")]
)


@query(
    "e10_overall_metrics",
    scored_sql(f"SELECT model, run_id, zone, count(*) AS total_days, {_E10} FROM dm GROUP BY model, run_id, zone"),
)
def e10_overall_metrics(spark, sf):
    return rounded(scores.overall_metrics(daily(spark, sf), ["model", "run_id", "zone"]))


@query(
    "e11_comparison_rollup",
    scored_sql(
        "SELECT zone, model, run_id, CAST(grouping(zone, model, run_id) AS INTEGER) AS grouping_level, "
        "count(*) AS days, "
        + ", ".join(r(f"avg({c})", c) for c in ("crps", "mae", "rmse", "pinball_mean", "winkler"))
        + " FROM dm GROUP BY ROLLUP (zone, model, run_id)"
    ),
)
def e11_comparison_rollup(spark, sf):
    return rounded(scores.comparison_rollup(daily(spark, sf), ["zone", "model", "run_id"]))


_E12_M = ("mae", "rmse", "crps", "pinball_10", "winkler")


@query(
    "e12_model_table",
    scored_sql(
        "SELECT model, zones, "
        + ", ".join(r(m, m) for m in _E12_M)
        + ", "
        + ", ".join(f"CAST(rank() OVER (ORDER BY {m} ASC NULLS LAST) AS INTEGER) AS {m}_rank" for m in _E12_M)
        + " FROM (SELECT model, count(*) AS zones, "
        + ", ".join(f"avg({m}) AS {m}" for m in _E12_M)
        + " FROM (SELECT model, zone, avg(mae) AS mae, avg(rmse) AS rmse, avg(crps) AS crps, "
        "avg(pinball_q10) AS pinball_10, avg(winkler) AS winkler FROM dm GROUP BY model, zone) "
        "GROUP BY model)"
    ),
)
def e12_model_table(spark, sf):
    tab = scores.model_table(daily(spark, sf), ["model"])
    return rounded(tab.select("model", "zones", *_E12_M, *[f"{m}_rank" for m in _E12_M]))
