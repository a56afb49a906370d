"""Scoring of forecasts that differ by date, on local days.

Observations are years of hourly order values put on local days of 24 slots, the real days of
23 and 25 hours included (D8).  Two forecasters give every (zone, date, hour) its own samples:
``week`` the same slot of the seven days before, ``weekday`` that of the four same weekdays
before.  Samples and observations meet on (zone, date, hour) only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, panel, scores
from ..session import materialize
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .q_scores import _DAILY_COLS, _E10, _E12_M, HI, LO
from .registry import query
from .util import r, rounded

#: Days back of each forecaster's samples.
HISTORY = {"week": (1, 2, 3, 4, 5, 6, 7), "weekday": (7, 14, 21, 28)}
KEYS = ["model", "zone", "date", "hour"]


def observed(spark, sf) -> DataFrame:
    """``zone, date, hour, y``: local days aligned to 24 slots; cut days are left out."""
    days = panel.daily_arrays(fx.order_hours(spark, sf), ["zone"], "ts", "value", panel.LOCAL_TZ)
    slots = days.select("zone", "date", F.posexplode(joins.dst_align(F.col("values"))).alias("hour", "y"))
    return slots.select("zone", "date", F.col("hour").cast("int").alias("hour"), "y")


def forecasts(obs: DataFrame) -> DataFrame:
    """``model, zone, date, hour, x``: samples of every forecast hour."""
    lags = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("days")) for m, ds in HISTORY.items() for d in ds])
    s = obs.withColumn("_l", F.explode(lags))
    return s.select(F.col("_l.model").alias("model"), "zone", F.date_add("date", F.col("_l.days")).alias("date"), "hour", F.col("y").alias("x"))


def daily(spark, sf) -> DataFrame:
    obs = materialize(observed(spark, sf))  # read as samples and as observations
    return scores.daily_metrics(scores.hourly_scores(forecasts(obs), obs, KEYS), KEYS[:3])


_LOCAL = "timezone('Europe/Oslo', timezone('UTC', ts))"
_VALUES = ", ".join(f"('{m}', {d})" for m, ds in HISTORY.items() for d in ds)
SQL = [
    ("dv", f"SELECT zone, CAST({_LOCAL} AS DATE) AS date, list(value ORDER BY ts) AS v FROM order_hours GROUP BY 1, 2"),
    ("da", """SELECT zone, date, CASE len(v) WHEN 24 THEN v WHEN 25 THEN v[1:3] || v[5:25] WHEN 23 THEN v[1:3] || v[3:3] || v[4:23] END AS v
    FROM dv WHERE len(v) BETWEEN 23 AND 25"""),
    ("ob", "SELECT zone, date, CAST(unnest(range(24)) AS INTEGER) AS hour, unnest(v) AS y FROM da"),
    ("fs", f"SELECT model, zone, date + days AS date, hour, y AS x FROM ob, (VALUES {_VALUES}) t(model, days)"),
    ("sm", f"""SELECT model, zone, date, hour, count(*) AS n, avg(x) AS mean_x, any_value(y) AS y, avg(abs(x - y)) AS mad,
           quantile_cont(x, 0.1) AS pb10, quantile_cont(x, 0.5) AS pb50, quantile_cont(x, 0.9) AS pb90,
           quantile_cont(x, {LO!r}) AS wlo, quantile_cont(x, {HI!r}) AS whi, sum((2 * i - k - 1) * x) AS g
    FROM (SELECT fs.*, ob.y, row_number() OVER (PARTITION BY model, zone, date, hour ORDER BY x) AS i, count(*) OVER (PARTITION BY model, zone, date, hour) AS k
          FROM fs JOIN ob USING (zone, date, hour)) GROUP BY model, zone, date, hour"""),
    ("hs", """SELECT *, mad - g / (n * n) AS crps, abs(y - mean_x) AS abs_err, (y - mean_x) * (y - mean_x) AS sq_err,
           greatest(0.1 * (y - pb10), 0.9 * (pb10 - y)) AS pinball_q10, 0.5 * abs(y - pb50) AS pinball_q50,
           greatest(0.9 * (y - pb90), 0.1 * (pb90 - y)) AS pinball_q90,
           (whi - wlo) + (2 / 0.9) * (greatest(wlo - y, 0) + greatest(y - whi, 0)) AS winkler FROM sm"""),
    ("dm", """SELECT model, zone, date, count(*) AS hours, avg(crps) AS crps, avg(abs_err) AS mae, sqrt(avg(sq_err)) AS rmse,
           avg(pinball_q10) AS pinball_q10, avg(pinball_q50) AS pinball_q50, avg(pinball_q90) AS pinball_q90, avg(winkler) AS winkler,
           (avg(pinball_q10) + avg(pinball_q50) + avg(pinball_q90)) / 3 AS pinball_mean
    FROM hs GROUP BY model, zone, date HAVING count(*) = 24"""),
]


def _sql(body: str) -> str:
    return with_fixtures(body, "order_hours", local=SQL)


@query("e9_dated_daily", _sql("SELECT model, zone, date, hours, " + ", ".join(r(c, c, 3) for c in _DAILY_COLS) + " FROM dm"))
def e9_dated_daily(spark, sf):
    return rounded(daily(spark, sf).select(*KEYS[:3], "hours", *_DAILY_COLS), 3)


@query("e10_dated_overall", _sql(f"SELECT model, zone, count(*) AS total_days, {_E10.replace(', 6)', ', 3)')} FROM dm GROUP BY model, zone"))
def e10_dated_overall(spark, sf):
    return rounded(scores.overall_metrics(daily(spark, sf), ["model", "zone"]), 3)


@query(
    "e12_dated_models",
    _sql(
        "SELECT model, zones, " + ", ".join(r(m, m, 3) for m in _E12_M) + ", "
        + ", ".join(f"CAST(rank() OVER (ORDER BY {m} ASC NULLS LAST) AS INTEGER) AS {m}_rank" for m in _E12_M)
        + " FROM (SELECT model, count(*) AS zones, " + ", ".join(f"avg({m}) AS {m}" for m in _E12_M)
        + " FROM (SELECT model, zone, avg(mae) AS mae, avg(rmse) AS rmse, avg(crps) AS crps, avg(pinball_q10) AS pinball_10,"
        " avg(winkler) AS winkler FROM dm GROUP BY model, zone) GROUP BY model)"
    ),
)
def e12_dated_models(spark, sf):
    tab = scores.model_table(daily(spark, sf), ["model"])
    return rounded(tab.select("model", "zones", *_E12_M, *[f"{m}_rank" for m in _E12_M]), 3)
