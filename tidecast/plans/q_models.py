"""Model queries: K1-K11, E28 (grouped fits on the hourly panel)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import boosting, models, quantreg, rolling, scores
from ..sources import fixtures as fx
from ..sources.tables import load
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

FEATURES = ["premium_d2", "premium_d7", "vol_down_d2"]
P = len(FEATURES) + 1
GK = ["zone", "hour"]


def design(spark, sf):
    """Rows ``zone, ts, date, hour, y, x=[1, features...]`` (positional lags on the
    gap-free panel; rows without full lag history dropped)."""
    h = fx.hourly(spark, sf)
    w = Window.partitionBy("zone").orderBy("ts")
    d = h.select(
        "zone", "ts", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.col("premium").alias("y"),
        F.lag("premium", 48).over(w).alias("premium_d2"),
        F.lag("premium", 168).over(w).alias("premium_d7"),
        F.lag("vol_down", 48).over(w).alias("vol_down_d2"),
    ).where(F.col("premium_d7").isNotNull())
    return d.withColumn("x", F.array(F.lit(1.0), *[F.col(c) for c in FEATURES]))


def _train_test(spark, sf):
    d, start = design(spark, sf), dt.datetime.combine(fx.span(spark, sf).validation, dt.time())
    return d.where(F.col("ts") < F.lit(start)), d.where(F.col("ts") >= F.lit(start))


def _beta_cols(df):
    return df.select("*", *[F.col("beta")[i].alias(f"b{i}") for i in range(P)]).drop("beta")


@query("k1_linear_quantile_fit")
def k1_linear_quantile_fit(spark, sf):
    """K1 (rows-only: a linear program): coefficients per (zone, hour, q), with the loss
    that they reach and the proof that none is lower (``gap``, ``converged``)."""
    train, _ = _train_test(spark, sf)
    return rounded(_beta_cols(models.quantile_regression(train, GK, P)))


def _k2(spark, sf):
    train, test = _train_test(spark, sf)
    coefs = models.quantile_regression(train, GK, P)
    return models.predict_quantiles(test, coefs, GK)


@query("k2_predict_quantiles")
def k2_predict_quantiles(spark, sf):
    """K2 (rows-only): predicted quantiles of the validation rows."""
    return rounded(_k2(spark, sf).select("zone", "ts", "hour", "q", "y", "pred"))


@query("k8_day_quantile_params")
def k8_day_quantile_params(spark, sf):
    """K8 (rows-only): per (zone, date) the predicted (hour, q) grid as ordered arrays."""
    pr = _k2(spark, sf)
    g = pr.groupBy("zone", "date").agg(F.sort_array(F.collect_list(F.struct("hour", "q", "pred"))).alias("_g"))
    return g.select(
        "zone", "date",
        F.array_distinct(F.transform("_g", lambda s: s["q"])).alias("quantiles"),
        F.transform("_g", lambda s: F.round(s["pred"], 6)).alias("values"),
    )


@query("e28_feature_importance")
def e28_feature_importance(spark, sf):
    """E28 (rows-only): mean |coefficient| per feature over every (zone, hour, q) fit."""
    train, _ = _train_test(spark, sf)
    coefs = models.quantile_regression(train, GK, P)
    return rounded(models.coefficient_importance(coefs, [*GK, "q"], ["intercept", *FEATURES]))


@query("k3_tree_quantiles")
def k3_tree_quantiles(spark, sf):
    """K3 (rows-only): quantile leaves of one regression tree over all zones and hours."""
    train, test = _train_test(spark, sf)
    feats = ["hour", *FEATURES]
    return rounded(models.tree_quantiles(train, test, feats, "y", ["zone", "ts"], categories=["zone"]))


@query("k4_location_scale")
def k4_location_scale(spark, sf):
    """K4 (rows-only): location-scale regression per (zone, hour), clamped Normal
    scale (I10 bounds) and the negative log-likelihood of each validation row (E19)."""
    train, test = _train_test(spark, sf)
    coefs = models.location_scale(train, GK, P)
    pr = models.predict_location_scale(test, coefs, GK)
    sc = F.least(F.greatest(F.col("scale"), F.lit(1e-3)), F.lit(1e6))
    return rounded(pr.select("zone", "ts", "loc", sc.alias("scale"), (-dist.normal_logpdf(F.col("y"), F.col("loc"), sc)).alias("nll")))


# K5 search space: every set of features times a ladder of L1 penalties, as a table of any
# length.  C15: no flag selected forces the first feature group.
ALPHAS = (0.0, 0.02)


def candidates() -> list[tuple[int, tuple[bool, ...], float]]:
    """(candidate id, mask over the design columns, alpha)."""
    masks = [tuple(bool(k >> j & 1) for j in range(len(FEATURES))) for k in range(2 ** len(FEATURES))]
    masks = [m if any(m) else (True,) + (False,) * (len(FEATURES) - 1) for m in masks]
    return [(i, (True, *m), a) for i, (m, a) in enumerate(((m, a) for m in masks for a in ALPHAS), start=1)]


def _problems(ids=None) -> list[quantreg.Problem]:
    return [quantreg.Problem(i, q, a, m) for i, m, a in candidates() if ids is None or i in ids for q in quantreg.QUANTILES]


def _search(spark, sf):
    """Validation pinball per candidate.  All candidates are problems of one fit, which
    reads the training rows once; predictions are never written per row and candidate, the
    loss of each is summed where the row lies."""
    train, test = _train_test(spark, sf)
    coefs = quantreg.fit(train, GK, P, _problems())
    return models.coefficient_loss(test, coefs, GK, ["candidate"]).withColumnRenamed("candidate", "candidate_id"), coefs


@query("k5_candidate_search")
def k5_candidate_search(spark, sf):
    """K5 + G3 (rows-only): validation pinball of every candidate and its position."""
    vp, _ = _search(spark, sf)
    place = F.row_number().over(Window.orderBy("val_pinball", "candidate_id"))  # a row per candidate
    return rounded(vp.select("candidate_id", "val_pinball", place.alias("position")))


@query("k6_refit_best")
def k6_refit_best(spark, sf):
    """K6 (rows-only): refit the best candidate on all rows; its coefficients."""
    vp, _ = _search(spark, sf)
    best_id = vp.orderBy("val_pinball", "candidate_id").select("candidate_id").first()[0]  # one scalar
    coefs = quantreg.fit(design(spark, sf), GK, P, _problems({best_id}))
    return rounded(_beta_cols(coefs.withColumnRenamed("candidate", "candidate_id")))


K3_FEATURES = FEATURES


@query("k3_boosted_quantiles")
def k3_boosted_quantiles(spark, sf):
    """K3 (rows-only): boosted quantile trees per (zone, hour), all levels together; the last
    week before the validation rows says how many rounds each group keeps."""
    train, test = _train_test(spark, sf)
    start = fx.span(spark, sf).validation
    model = boosting.fit(train, GK, K3_FEATURES, rounds=10, rate=0.3, validation=F.col("date") >= F.lit(start - dt.timedelta(days=7)), patience=5)
    return rounded(boosting.predict(test, model, GK, K3_FEATURES, keep=["ts", "y"]))


# K7: a linear model per (zone, hour) is fitted anew for every day on the days before it.
WINDOW_DAYS = 730


@query("k7_rolling_forecast")
def k7_rolling_forecast(spark, sf):
    """K7 (rows-only): quantiles of every evaluation day from the model fitted on its
    trailing window, all days in one job; the sums of a window are differences of running
    sums, so no row is copied into the windows that hold it."""
    d = design(spark, sf)
    fits = rolling.trailing_fits(d, GK, "date", P, WINDOW_DAYS, least_rows=2 * P)
    test = d.where(F.col("date") >= F.lit(fx.span(spark, sf).evaluation))
    return rounded(rolling.predict_quantiles(test, fits, GK, "date", keep=["ts"]).select("zone", "hour", F.col("date").alias("pred_date"), "q", "pred"))


# The same over seven years of orders: daily totals per priority, a level and a trend.
_DAILY_SQL = """SELECT o_orderpriority AS zone, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1e5 AS y FROM orders GROUP BY 1, 2"""


def daily_orders(spark, sf):
    """Daily totals per priority with a weekly cycle as features: x = [1, weekend, day / 365]."""
    o = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("zone"), F.to_date("o_orderdate").alias("date")).agg((F.sum("o_totalprice") / 1e5).alias("y"))
    weekend = (F.weekday("date") >= 5).cast("double")
    return o.withColumn("x", F.array(F.lit(1.0), weekend, F.datediff("date", F.lit(dt.date(1995, 1, 1))) / 365.0))


_ROLL_SQL = f"""WITH d AS (SELECT zone, date, y, CASE WHEN isodow(date) >= 6 THEN 1.0::DOUBLE ELSE 0.0 END AS w, date_diff('day', DATE '1995-01-01', date) / 365.0::DOUBLE AS t FROM ({_DAILY_SQL})),
s AS (SELECT a.zone, a.date, any_value(a.w) AS w0, any_value(a.t) AS t0, count(*) AS n, sum(b.w) AS sw, sum(b.t) AS st, sum(b.w * b.w) AS sww, sum(b.w * b.t) AS swt, sum(b.t * b.t) AS stt, sum(b.y) AS sy, sum(b.w * b.y) AS swy, sum(b.t * b.y) AS sty, sum(b.y * b.y) AS syy
  FROM d a JOIN d b ON a.zone = b.zone AND b.date < a.date AND b.date >= a.date - {WINDOW_DAYS} GROUP BY a.zone, a.date HAVING count(*) >= 200),
c AS (SELECT *, sww - sw * sw / n AS cww, swt - sw * st / n AS cwt, stt - st * st / n AS ctt, swy - sw * sy / n AS cwy, sty - st * sy / n AS cty, syy - sy * sy / n AS cyy FROM s),
f AS (SELECT *, (cwy * ctt - cty * cwt) / (cww * ctt - cwt * cwt) AS bw, (cty * cww - cwy * cwt) / (cww * ctt - cwt * cwt) AS bt FROM c)
SELECT zone, date, n, {r("sy / n - bw * sw / n - bt * st / n + bw * w0 + bt * t0", "loc", 5)}, {r("sqrt(greatest(cyy - bw * cwy - bt * cty, 0) / (n - 3))", "scale", 5)} FROM f"""


@query("k7_rolling_730_days", _ROLL_SQL)
def k7_rolling_730_days(spark, sf):
    """K7 over B3/B4: for each priority and day with at least 200 days of history, location and
    scale of the day's total from the linear model of the 730 days before it."""
    d = daily_orders(spark, sf)
    fits = rolling.trailing_fits(d, ["zone"], "date", 3, WINDOW_DAYS, least_rows=200)
    return rounded(rolling.predict(d, fits, ["zone"], "date").select("zone", "date", "n", "loc", "scale"), 5)


@query(
    "k9_sign_by_state",
    with_fixtures(
        "SELECT model, run_id, zone, hour, state, "
        + r("CASE WHEN state = 'up_regulation' THEN abs(mean) WHEN state = 'down_regulation' THEN -abs(mean) ELSE mean END", "mean_signed")
        + " FROM (SELECT model, run_id, zone, hour, avg(x) AS mean,"
        " CASE WHEN avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) > avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END) THEN 'up_regulation'"
        " WHEN avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END) > avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) THEN 'down_regulation'"
        " ELSE 'normal' END AS state FROM samples GROUP BY model, run_id, zone, hour)",
        "samples",
    ),
)
def k9_sign_by_state(spark, sf):
    s = fx.samples(spark, sf)
    keys = ["model", "run_id", "zone", "hour"]
    st = scores.exceedance(s, keys).join(s.groupBy(*keys).agg(F.avg("x").alias("mean")), on=keys)
    return rounded(st.select(*keys, "state", models.sign_by_state(F.col("mean"), F.col("state")).alias("mean_signed")))


# ------------------------------------------------------------ benchmarks K10, K11
NAIVE_WEEKS = 3
ES_ALPHA, ES_DAYS, ES_RESID = 0.5, 7, 7  # fixed benchmark settings


def seasonal_naive(spark, sf):
    """samples = the same hour 1..k weeks earlier (positional, gap-free panel)."""
    h = fx.hourly(spark, sf)
    w = Window.partitionBy("zone").orderBy("ts")
    h = h.withColumns({f"_l{j}": F.lag("premium", 168 * j).over(w) for j in range(1, NAIVE_WEEKS + 1)})
    lags = F.array(*[F.struct(F.lit(j).cast("long").alias("sample_id"), F.col(f"_l{j}").alias("x")) for j in range(1, NAIVE_WEEKS + 1)])
    s = h.select("zone", "ts", F.explode(lags).alias("_s")).where(F.col("_s.x").isNotNull())
    return s.select("zone", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "_s.sample_id", "_s.x")


def exp_smoothing(spark, sf):
    """point = truncated exponential weights over the same hour of the previous
    days (normalised); samples = point + the previous days' residuals at that hour."""
    h = fx.hourly(spark, sf)
    w = Window.partitionBy("zone").orderBy("ts")
    wts = [ES_ALPHA * (1 - ES_ALPHA) ** (k - 1) for k in range(1, ES_DAYS + 1)]
    h = h.withColumns({f"_p{k}": F.lag("premium", 24 * k).over(w) for k in range(1, ES_DAYS + 1)})
    num = sum((F.lit(wk) * F.col(f"_p{k}") for k, wk in enumerate(wts, start=1)), F.lit(0.0))
    point = h.select("zone", "ts", "premium", (num / sum(wts)).alias("point"))
    point = point.withColumn("resid", F.col("premium") - F.col("point"))
    point = point.withColumns({f"_r{j}": F.lag("resid", 24 * j).over(w) for j in range(1, ES_RESID + 1)})
    lags = F.array(*[F.struct(F.lit(j).cast("long").alias("sample_id"), (F.col("point") + F.col(f"_r{j}")).alias("x")) for j in range(1, ES_RESID + 1)])
    s = point.select("zone", "ts", F.explode(lags).alias("_s")).where(F.col("_s.x").isNotNull())
    return s.select("zone", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "_s.sample_id", "_s.x")


def _bench_daily(samples, spark, sf):
    obs = fx.actuals(spark, sf)
    hs = scores.hourly_scores(samples, obs, ["zone", "date", "hour"])
    return scores.daily_metrics(hs, ["zone", "date"]).select("zone", "date", "crps", "mae", "rmse")


def _bench_sql(samples_sql: str) -> str:
    return with_fixtures(
        "SELECT zone, date, " + ", ".join([r("avg(crps)", "crps"), r("avg(ae)", "mae"), r("sqrt(avg(ae * ae))", "rmse")])
        + """ FROM (SELECT s.zone, s.date, s.hour,
                   avg(abs(s.x - a.y)) - sum((2 * s.i - s.n - 1) * s.x) / (any_value(s.n) * any_value(s.n)) AS crps,
                   abs(any_value(a.y) - avg(s.x)) AS ae
            FROM (SELECT *, row_number() OVER k AS i, count(*) OVER (PARTITION BY zone, date, hour) AS n FROM bs
                  WINDOW k AS (PARTITION BY zone, date, hour ORDER BY x)) s
            JOIN actuals a ON a.zone = s.zone AND a.date = s.date AND a.hour = s.hour
            GROUP BY s.zone, s.date, s.hour) GROUP BY zone, date""",
        "hourly",
        "actuals",
        local=[("bs", samples_sql)],
    )


_NAIVE_SQL = (
    "SELECT zone, date, hour, x FROM (SELECT zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, "
    "unnest([" + ", ".join(f"lag(premium, {168 * j}) OVER w" for j in range(1, NAIVE_WEEKS + 1)) + "]) AS x "
    "FROM hourly WINDOW w AS (PARTITION BY zone ORDER BY ts)) WHERE x IS NOT NULL"
)
_WTS = [ES_ALPHA * (1 - ES_ALPHA) ** (k - 1) for k in range(1, ES_DAYS + 1)]
_ES_SQL = (
    "SELECT zone, date, hour, x FROM (SELECT zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, "
    "unnest([" + ", ".join(f"point + lag(resid, {24 * j}) OVER w" for j in range(1, ES_RESID + 1)) + "]) AS x "
    "FROM (SELECT *, premium - point AS resid FROM (SELECT zone, ts, premium, ("
    + " + ".join(f"{wk!r} * lag(premium, {24 * k}) OVER w0" for k, wk in enumerate(_WTS, start=1))
    + f") / {sum(_WTS)!r} AS point FROM hourly WINDOW w0 AS (PARTITION BY zone ORDER BY ts))) "
    "WINDOW w AS (PARTITION BY zone ORDER BY ts)) WHERE x IS NOT NULL"
)


@query("k10_seasonal_naive", _bench_sql(_NAIVE_SQL))
def k10_seasonal_naive(spark, sf):
    return rounded(_bench_daily(seasonal_naive(spark, sf), spark, sf))


@query("k11_exp_smoothing", _bench_sql(_ES_SQL))
def k11_exp_smoothing(spark, sf):
    return rounded(_bench_daily(exp_smoothing(spark, sf), spark, sf))
