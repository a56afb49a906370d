"""Joins, set operations, ordering and report tables: D1-D3, D8, H1-H4, G2-G3, F1-F3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, orderstats, panel, report, scores
from ..session import sized_broadcast
from ..sources import fixtures as fx
from ..sources.tables import load
from .oracle import with_fixtures
from .q_scores import daily as scored_daily
from .q_scores import scored_sql
from .registry import query
from .util import r, rounded


@query(
    "d1_forecast_actual_join",
    with_fixtures(
        "SELECT s.model, s.run_id, s.zone, a.date, s.hour, s.sample_id, " + r("s.x", "x") + ", " + r("a.y", "y")
        + " FROM samples s JOIN actuals a ON a.zone = s.zone AND a.hour = s.hour",
        "samples",
        "actuals",
    ),
)
def d1_forecast_actual_join(spark, sf):
    j = joins.forecast_actual(fx.samples(spark, sf), fx.actuals(spark, sf))
    return rounded(j.select("model", "run_id", "zone", "date", "hour", "sample_id", "x", "y"))


def _full_actual_days(spark, sf):
    raw = fx.hourly_raw(spark, sf).select("zone", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))
    return panel.full_blocks(raw, ["zone"], "date").select("zone", "date").distinct()


@query(
    "d2_unmatched_dates",
    with_fixtures(
        """SELECT zone, date, 'left_only' AS side FROM (
             SELECT zone, CAST(ts AS DATE) AS date FROM hourly_raw GROUP BY 1, 2 HAVING count(*) = 24
             EXCEPT SELECT zone, date FROM forecast_wide)
           UNION ALL
           SELECT zone, date, 'right_only' FROM (
             SELECT zone, date FROM forecast_wide
             EXCEPT SELECT zone, CAST(ts AS DATE) FROM hourly_raw GROUP BY 1, 2 HAVING count(*) = 24)""",
        "hourly_raw",
        "forecast_wide",
    ),
)
def d2_unmatched_dates(spark, sf):
    fc_days = fx.forecast_wide(spark, sf).select("zone", "date").distinct()
    return report.date_sets_diff(_full_actual_days(spark, sf), fc_days, ["zone"], "date")


def _order_days(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("date"))


@query(
    "d3_dates_in_all_runs",
    """SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS date FROM orders
       GROUP BY 1, 2
       HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders o2
                                                 WHERE o2.o_orderstatus = orders.o_orderstatus)""",
)
def d3_dates_in_all_runs(spark, sf):
    return report.dates_in_all(_order_days(spark, sf), ["o_orderstatus"], "o_orderpriority", "date")


@query(
    "d8_dst_align",
    with_fixtures(
        """SELECT zone, date, n_values,
           array_to_string(list_transform(
             CASE WHEN n_values = 24 THEN v
                  WHEN n_values = 25 THEN v[1:3] || v[5:25]
                  WHEN n_values = 23 THEN v[1:3] || v[3:3] || v[4:23] END,
             lambda e: CAST(round(e + 1e-9, 6) + 0.0 AS VARCHAR)), ',') AS aligned
    FROM (SELECT zone, CAST(lt AS DATE) AS date, count(*) AS n_values, list(premium ORDER BY lt) AS v
          FROM (SELECT zone, premium, timezone('Europe/Oslo', timezone('UTC', ts)) AS lt FROM hourly)
          GROUP BY 1, 2)""",
        "hourly",
    ),
)
def d8_dst_align(spark, sf):
    h = fx.hourly(spark, sf).withColumn("lt", panel.to_local("ts"))
    days = panel.daily_arrays(h, ["zone"], "lt", "premium").withColumn("n_values", F.size("values").cast("long"))
    aligned = joins.dst_align(F.col("values"))
    txt = F.array_join(F.transform(aligned, lambda e: (F.round(e + 1e-9, 6) + 0.0).cast("string")), ",")
    return days.select("zone", "date", "n_values", txt.alias("aligned"))


_LOCAL = "timezone('Europe/Oslo', timezone('UTC', ts))"


@query(
    "d8_dst_days",
    with_fixtures(
        "SELECT zone, date, n_values, " + ", ".join(r(f"CASE WHEN n_values = 24 THEN v[{k}] WHEN n_values = 25 THEN v[{k if k <= 3 else k + 1}] WHEN n_values = 23 THEN v[{k if k <= 3 else k - 1}] END", f"h{k - 1}", 2) for k in (1, 3, 4, 5, 24))
        + f" FROM (SELECT zone, CAST({_LOCAL} AS DATE) AS date, count(*) AS n_values, list(value ORDER BY ts) AS v FROM order_hours GROUP BY 1, 2)",
        "order_hours",
    ),
)
def d8_dst_days(spark, sf):
    """D8 over years of local days: real days of 23 and 25 hours put on 24 slots (slots
    around the clock change and the ends shown; null for the cut first and last days)."""
    h = fx.order_hours(spark, sf)
    days = panel.daily_arrays(h, ["zone"], "ts", "value", panel.LOCAL_TZ).withColumn("n_values", F.size("values").cast("long"))
    a = days.withColumn("a", joins.dst_align(F.col("values")))
    return rounded(a.select("zone", "date", "n_values", *[F.col("a")[k].alias(f"h{k}") for k in (0, 2, 3, 4, 23)]), 2)


@query(
    "h1_intersect_dates",
    """SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'
       INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def h1_intersect_dates(spark, sf):
    d = _order_days(spark, sf)
    a = d.where(F.col("o_orderpriority") == "1-URGENT").select("date")
    b = d.where(F.col("o_orderpriority") == "2-HIGH").select("date")
    return a.intersect(b)


@query(
    "h2_except_dates",
    """SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'
       EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def h2_except_dates(spark, sf):
    d = _order_days(spark, sf)
    a = d.where(F.col("o_orderpriority") == "1-URGENT").select("date")
    b = d.where(F.col("o_orderpriority") == "2-HIGH").select("date")
    return a.subtract(b)


@query(
    "h3_union_all_frames",
    with_fixtures(
        "SELECT model, zone, date, hour, " + r("mean", "mean") + " FROM forecast_wide",
        "forecast_wide",
    ),
)
def h3_union_all_frames(spark, sf):
    fw = fx.forecast_wide(spark, sf).select("model", "zone", "date", "hour", "mean")
    frames = [fw.where(F.col("model") == m) for m, *_ in fx.span(spark, sf).windows]
    return rounded(reduce(DataFrame.unionByName, frames))


@query("h4_distinct_zone_models", with_fixtures("SELECT DISTINCT zone, model FROM samples", "samples"))
def h4_distinct_zone_models(spark, sf):
    return fx.samples(spark, sf).select("zone", "model").distinct()


MODEL_ORDER = ["hist", "early", "late"]


@query(
    "g2_custom_order",
    with_fixtures(
        """SELECT model, run_id, CAST(row_number() OVER (ORDER BY
              CASE model WHEN 'hist' THEN 1 WHEN 'early' THEN 2 WHEN 'late' THEN 3 ELSE 4 END,
              TRY_CAST(run_id AS INTEGER) ASC NULLS LAST, run_id) AS INTEGER) AS position
    FROM (SELECT DISTINCT model, run_id FROM samples)""",
        "samples",
    ),
)
def g2_custom_order(spark, sf):
    pairs = fx.samples(spark, sf).select("model", "run_id").distinct()
    w = Window.orderBy(*report.custom_order(F.col("model"), F.col("run_id"), MODEL_ORDER))
    return pairs.withColumn("position", F.row_number().over(w))


@query(
    "g3_best_candidate",
    with_fixtures(
        """SELECT zone, arg_min(model, val_pinball) AS best_model, """
        + r("min(val_pinball)", "best_val_pinball")
        + """ FROM (SELECT model, zone, avg(loss) AS val_pinball FROM (
              SELECT q.model, q.zone, q.hour, q.q,
                     avg(CASE WHEN a.y >= q.value THEN q.q * (a.y - q.value) ELSE (1 - q.q) * (q.value - a.y) END) AS loss
              FROM quantile_fc q JOIN actuals a ON a.zone = q.zone AND a.hour = q.hour
              GROUP BY q.model, q.zone, q.hour, q.q) GROUP BY model, zone) GROUP BY zone""",
        "quantile_fc",
        "actuals",
    ),
)
def g3_best_candidate(spark, sf):
    q = fx.quantile_fc(spark, sf).withColumnRenamed("value", "pred").join(fx.actuals(spark, sf), on=["zone", "hour"])
    vp = scores.validation_pinball(q, ["model", "zone"])
    best = report.best_candidate(vp.withColumnRenamed("model", "model"), ["zone"], "val_pinball", "model")
    return rounded(best)


def _model_table_long(spark, sf):
    tab = scores.model_table(scored_daily(spark, sf), ["model"])
    return scores.unpivot_metrics(tab, ["model"], list(scores.MODEL_TABLE_METRICS))


_MT = (
    "SELECT model, zones, mae, rmse, crps, pinball_10, winkler FROM (SELECT model, count(*) AS zones, "
    "avg(mae) AS mae, avg(rmse) AS rmse, avg(crps) AS crps, avg(pinball_10) AS pinball_10, avg(winkler) AS winkler "
    "FROM (SELECT model, zone, avg(mae) AS mae, avg(rmse) AS rmse, avg(crps) AS crps, avg(pinball_q10) AS pinball_10, "
    "avg(winkler) AS winkler FROM dm GROUP BY model, zone) GROUP BY model)"
)
_MTL = [("mt", _MT), ("mtl", "SELECT model, metric, value FROM mt UNPIVOT (value FOR metric IN (mae, rmse, crps, pinball_10, winkler))")]


@query(
    "f1_rank_models",
    scored_sql(
        f"SELECT model, metric, {r('value', 'value')}, CAST(rank() OVER (PARTITION BY metric ORDER BY value) AS INTEGER) AS rank FROM mtl",
        extra=_MTL,
    ),
)
def f1_rank_models(spark, sf):
    lng = _model_table_long(spark, sf)
    return rounded(lng.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy("value"))))


@query(
    "f2_order_index",
    with_fixtures(
        "SELECT model, run_id, zone, hour, sample_id, CAST(rank() OVER (PARTITION BY model, run_id, zone, hour ORDER BY x) AS INTEGER) AS i"
        " FROM samples",
        "samples",
    ),
)
def f2_order_index(spark, sf):
    keys = ["model", "run_id", "zone", "hour"]
    return orderstats.order_index(fx.samples(spark, sf), keys, "x").select(*keys, "sample_id", "i")


@query(
    "f3_heat_bands",
    scored_sql(
        """SELECT model, metric, """
        + r("value", "value")
        + ", "
        + r("CASE WHEN hi = lo THEN NULL ELSE (value - lo) / (hi - lo) END", "norm")
        + """, CAST(CASE WHEN hi = lo THEN 0
                   WHEN (value - lo) / (hi - lo) <= 0.1 THEN 1 WHEN (value - lo) / (hi - lo) <= 0.25 THEN 2
                   WHEN (value - lo) / (hi - lo) <= 0.4 THEN 3 WHEN (value - lo) / (hi - lo) <= 0.55 THEN 4
                   WHEN (value - lo) / (hi - lo) <= 0.7 THEN 5 WHEN (value - lo) / (hi - lo) <= 0.85 THEN 6
                   ELSE 7 END AS INTEGER) AS band,
           abs(value - lo) < 1e-6 AS is_best
    FROM (SELECT *, coalesce(min(value) FILTER (WHERE model <> 'early') OVER (PARTITION BY metric), 0.0) AS lo,
                    coalesce(max(value) FILTER (WHERE model <> 'early') OVER (PARTITION BY metric), 1.0) AS hi FROM mtl)""",
        extra=_MTL,
    ),
)
def f3_heat_bands(spark, sf):
    hb = report.heat_bands(_model_table_long(spark, sf), "metric", "value", "model", exclude=["early"])
    return rounded(hb.select("model", "metric", "value", "norm", F.col("band").cast("int").alias("band"), "is_best"))


@query(
    "g1_order_by_date",
    with_fixtures(
        "SELECT zone, date, CAST(row_number() OVER (PARTITION BY zone ORDER BY date) AS INTEGER) AS position"
        " FROM (SELECT DISTINCT zone, date FROM forecast_wide)",
        "forecast_wide",
    ),
)
def g1_order_by_date(spark, sf):
    """G1: forecast dates in order per zone (the order made explicit as a position)."""
    d = fx.forecast_wide(spark, sf).select("zone", "date").distinct()
    return d.withColumn("position", F.row_number().over(Window.partitionBy("zone").orderBy("date"))).orderBy("zone", "date")


@query(
    "d4_scaler_lookup",
    with_fixtures(
        "SELECT h.zone, h.ts, "
        + r("(h.premium - s.mu) / s.sigma", "premium_z")
        + " FROM hourly h JOIN (SELECT zone, CAST(hour(ts) AS INTEGER) AS hour, avg(premium) AS mu,"
        " CASE WHEN stddev_pop(premium) = 0 THEN 1.0 ELSE stddev_pop(premium) END AS sigma FROM hourly, span"
        " WHERE ts < d_eval GROUP BY 1, 2) s ON s.zone = h.zone AND s.hour = hour(h.ts)",
        "hourly",
        "span",
    ),
)
def d4_scaler_lookup(spark, sf):
    """A (zone, hour) scaler fitted on the training period, broadcast after a
    size check and looked up by key for every row."""
    h = fx.hourly(spark, sf).withColumn("hour", F.hour("ts"))
    long = h.select("zone", "ts", "hour", F.lit("premium").alias("feature"), F.col("premium").alias("v"))
    train = long.where(F.col("ts") < F.lit(fx.span(spark, sf).evaluation).cast("timestamp_ntz"))
    sc = panel.fit_scaler(train, ["zone"])
    out = panel.apply_scaler(long, sized_broadcast(sc), ["zone"], skip=())
    return rounded(out.select("zone", "ts", F.col("v_scaled").alias("premium_z")))
