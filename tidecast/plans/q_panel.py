"""Hourly panel queries: A1, B1-B15, C1-C5, C7-C9, C11-C14, C18-C26, D7, F4-F6."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration, joins, orderstats, panel, scores
from ..session import sized_broadcast
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

PANEL = list(fx.PANEL_COLUMNS)
NON_TARGET = [c for c in PANEL if c != "premium"]
D0, D1 = dt.date(2024, 1, 5), dt.date(2024, 1, 7)
PRED_DATE = dt.date(2024, 1, 20)
WINDOW_DAYS = 7
VAL_START = dt.datetime(2024, 1, 24)
MATRIX_FEATURES = ["price_up_d2", "vol_down_d7", "hour_sin", "is_weekend"]

_P = ", ".join(r(c, c) for c in PANEL)


def _hourly(spark, sf):
    return fx.hourly(spark, sf)


def _ts_cols(df):
    return df.select("zone", "ts", *PANEL)


# ---------------------------------------------------------------- A1, B slices
@query("a1_scan_hourly", with_fixtures(f"SELECT zone, ts, {_P} FROM hourly_raw", "hourly_raw"))
def a1_scan_hourly(spark, sf):
    return rounded(_ts_cols(fx.hourly_raw(spark, sf)))


@query(
    "b1_date_slice",
    with_fixtures(f"SELECT zone, ts, {_P} FROM hourly WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-08'", "hourly"),
)
def b1_date_slice(spark, sf):
    return rounded(_ts_cols(panel.date_slice(_hourly(spark, sf), "ts", D0, D1)))


@query(
    "b2_eval_slice",
    with_fixtures(f"SELECT zone, ts, {_P} FROM hourly WHERE ts >= DATE '2024-01-05' AND ts <= TIMESTAMP '2024-01-08 00:00:00'", "hourly"),
)
def b2_eval_slice(spark, sf):
    return rounded(_ts_cols(panel.eval_slice(_hourly(spark, sf), "ts", D0, D1, closed=True)))


@query(
    "b3_training_window",
    with_fixtures(f"SELECT zone, ts, {_P} FROM hourly WHERE ts >= DATE '2024-01-13' AND ts < DATE '2024-01-21'", "hourly"),
)
def b3_training_window(spark, sf):
    h = _hourly(spark, sf)
    lo = PRED_DATE - dt.timedelta(days=WINDOW_DAYS)
    return rounded(_ts_cols(h.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.date_add(F.lit(PRED_DATE), 1)))))


_DAYCOUNT = "SELECT zone, CAST(ts AS DATE) AS date, count(*) AS n FROM hourly GROUP BY 1, 2"


@query(
    "b4_history_sufficiency",
    with_fixtures(
        """SELECT d.zone, d.date, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS history_rows,
                  coalesce(sum(h.n), 0) >= 168 AS sufficient
    FROM dc d LEFT JOIN dc h ON h.zone = d.zone AND h.date >= d.date - 7 AND h.date < d.date
    GROUP BY d.zone, d.date""",
        "hourly",
        local=[("dc", _DAYCOUNT)],
    ),
)
def b4_history_sufficiency(spark, sf):
    """B4 via an F6 range frame over day numbers — no join at all."""
    days = _hourly(spark, sf).groupBy("zone", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("zone").orderBy(F.unix_date("date")).rangeBetween(-WINDOW_DAYS, -1)
    rows = F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")
    return days.select("zone", "date", rows.alias("history_rows"), (rows >= WINDOW_DAYS * 24).alias("sufficient"))


@query(
    "b5_utc_to_local",
    with_fixtures("SELECT zone, ts, timezone('Europe/Oslo', timezone('UTC', ts)) AS local_ts FROM hourly", "hourly"),
)
def b5_utc_to_local(spark, sf):
    return _hourly(spark, sf).select("zone", "ts", panel.to_local("ts").alias("local_ts"))


_LAGS = ", ".join(
    f"lag({c}, {n}) OVER w AS {c}_{nm}" for nm, n in panel.LAG_HOURS.items() for c in NON_TARGET
)
_LAG_NAMES = [f"{c}_{nm}" for nm in panel.LAG_HOURS for c in NON_TARGET]
_LT = "timezone('Europe/Oslo', timezone('UTC', ts))"  # local time of a UTC stamp
_TIME_SQL = (
    f"sin(2 * pi() * hour({_LT}) / 24) AS hour_sin, cos(2 * pi() * hour({_LT}) / 24) AS hour_cos, "
    f"sin(2 * pi() * (isodow({_LT}) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow({_LT}) - 1) / 7) AS day_of_week_cos, "
    f"sin(2 * pi() * (month({_LT}) - 1) / 12) AS month_sin, cos(2 * pi() * (month({_LT}) - 1) / 12) AS month_cos, "
    f"CASE WHEN isodow({_LT}) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend"
)
_FEAT = [
    ("lagged", f"SELECT *, {_LAGS}, row_number() OVER w AS rn FROM hourly WINDOW w AS (PARTITION BY zone ORDER BY ts)"),
    ("warm", f"SELECT *, {_TIME_SQL}, rn - 169 AS rn0 FROM lagged WHERE rn > 168"),
    ("blk", "SELECT *, CAST(rn0 // 24 AS BIGINT) AS day_id, CAST(rn0 % 24 AS INTEGER) AS slot FROM warm"),
]


def _lagged(spark, sf):
    return panel.lag_features(_hourly(spark, sf), ["zone"], "ts", NON_TARGET)


def _blocks(spark, sf):
    warm = panel.drop_warmup(_lagged(spark, sf), ["zone"], "ts", 168)
    return panel.day_blocks(panel.time_features(warm, "ts"), ["zone"], "ts")


@query(
    "c5_lag_features",
    with_fixtures("SELECT zone, ts, " + ", ".join(r(c, c) for c in _LAG_NAMES) + " FROM lagged", "hourly", local=_FEAT[:1]),
)
def c5_lag_features(spark, sf):
    return rounded(_lagged(spark, sf).select("zone", "ts", *_LAG_NAMES))


_BY_TIME = ", ".join(f"{r(f'p{k}.premium', f'premium_{nm}')}" for k, nm in enumerate(panel.LAG_HOURS))


@query(
    "c5_lags_by_time",
    with_fixtures(
        f"SELECT h.zone, h.ts, {_BY_TIME} FROM hourly_raw h "
        + " ".join(f"LEFT JOIN hourly_raw p{k} ON p{k}.zone = h.zone AND p{k}.ts = h.ts - INTERVAL {n} HOUR" for k, n in enumerate(panel.LAG_HOURS.values())),
        "hourly_raw",
    ),
)
def c5_lags_by_time(spark, sf):
    """C5 on the panel as it is, gaps included: lags by time, not by row."""
    lagged = panel.lags_by_time(fx.hourly_raw(spark, sf), ["zone"], "ts", ["premium"])
    return rounded(lagged.select("zone", "ts", *[f"premium_{nm}" for nm in panel.LAG_HOURS]))


@query(
    "f4_row_lag",
    with_fixtures(f"SELECT zone, ts, {r('lag(premium, 24) OVER (PARTITION BY zone ORDER BY ts)', 'premium_lag24')} FROM hourly", "hourly"),
)
def f4_row_lag(spark, sf):
    w = Window.partitionBy("zone").orderBy("ts")
    return rounded(_hourly(spark, sf).select("zone", "ts", F.lag("premium", 24).over(w).alias("premium_lag24")))


@query(
    "b7_drop_warmup",
    with_fixtures("SELECT zone, ts, " + ", ".join(r(c, c) for c in _LAG_NAMES) + " FROM warm", "hourly", local=_FEAT[:2]),
)
def b7_drop_warmup(spark, sf):
    warm = panel.drop_warmup(_lagged(spark, sf), ["zone"], "ts", 168)
    return rounded(warm.select("zone", "ts", *_LAG_NAMES))


@query("c7_day_blocks", with_fixtures("SELECT zone, ts, day_id, slot FROM blk", "hourly", local=_FEAT))
def c7_day_blocks(spark, sf):
    return _blocks(spark, sf).select("zone", "ts", "day_id", "slot")


@query("f5_day_block_numbering", with_fixtures("SELECT zone, day_id, min(ts) AS day_start, count(*) AS rows FROM blk GROUP BY zone, day_id", "hourly", local=_FEAT))
def f5_day_block_numbering(spark, sf):
    return _blocks(spark, sf).groupBy("zone", "day_id").agg(F.min("ts").alias("day_start"), F.count(F.lit(1)).alias("rows"))


@query(
    "b8_full_blocks",
    with_fixtures(
        "SELECT zone, ts, day_id, slot FROM blk WHERE (zone, day_id) IN (SELECT zone, day_id FROM blk GROUP BY 1, 2 HAVING count(*) = 24)",
        "hourly",
        local=_FEAT,
    ),
)
def b8_full_blocks(spark, sf):
    return panel.full_blocks(_blocks(spark, sf), ["zone"], "day_id").select("zone", "ts", "day_id", "slot")


@query(
    "c2_calendar_parts",
    with_fixtures(
        f"SELECT zone, ts, CAST(hour({_LT}) AS INTEGER) AS hour, CAST(isodow({_LT}) - 1 AS INTEGER) AS day_of_week,"
        f" CAST(month({_LT}) AS INTEGER) AS month FROM hourly",
        "hourly",
    ),
)
def c2_calendar_parts(spark, sf):
    return panel.calendar_parts(_hourly(spark, sf).select("zone", "ts"), "ts")


_TF = list(panel.TIME_FEATURES)


@query(
    "c3_cyclical_features",
    with_fixtures("SELECT zone, ts, " + ", ".join(r(c, c) for c in _TF[:-1]) + f" FROM (SELECT zone, ts, {_TIME_SQL} FROM hourly)", "hourly"),
)
def c3_cyclical_features(spark, sf):
    return rounded(panel.time_features(_hourly(spark, sf).select("zone", "ts"), "ts").select("zone", "ts", *_TF[:-1]))


@query("c4_weekend_flag", with_fixtures(f"SELECT zone, ts, {r('CASE WHEN isodow(' + _LT + ') >= 6 THEN 1.0 ELSE 0.0 END', 'is_weekend')} FROM hourly", "hourly"))
def c4_weekend_flag(spark, sf):
    return rounded(panel.time_features(_hourly(spark, sf).select("zone", "ts"), "ts").select("zone", "ts", "is_weekend"))


@query(
    "b9_split_columns",
    with_fixtures("SELECT zone, ts, " + r("premium", "target") + ", " + ", ".join(r(c, c) for c in NON_TARGET) + " FROM hourly", "hourly"),
)
def b9_split_columns(spark, sf):
    h = _hourly(spark, sf)
    target, feats = "premium", [c for c in PANEL if c != "premium"]
    return rounded(h.select("zone", "ts", F.col(target).alias("target"), *feats))


@query(
    "b10_week_slice",
    with_fixtures(f"SELECT zone, ts, {_P} FROM hourly WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-17'", "hourly"),
)
def b10_week_slice(spark, sf):
    return rounded(_ts_cols(panel.week_slice(_hourly(spark, sf), "ts", dt.date(2024, 1, 10))))


@query(
    "b11_mean_median_fallback",
    with_fixtures(
        "SELECT model, zone, date, hour, "
        + r("coalesce(CASE WHEN hour % 4 = 0 THEN NULL ELSE mean END, median)", "mean")
        + ", "
        + r("coalesce(median, CASE WHEN hour % 4 = 0 THEN NULL ELSE mean END)", "median")
        + " FROM forecast_wide",
        "forecast_wide",
    ),
)
def b11_mean_median_fallback(spark, sf):
    """B11 with every fourth hour's mean missing (as in stats files written without it)."""
    fw = fx.forecast_wide(spark, sf).withColumn("mean", F.when(F.col("hour") % 4 == 0, F.lit(None)).otherwise(F.col("mean")))
    return rounded(
        fw.select("model", "zone", "date", "hour",
                  F.coalesce("mean", "median").alias("mean"), F.coalesce("median", "mean").alias("median"))
    )


@query(
    "b12_interval_fallback",
    with_fixtures(
        "SELECT model, zone, date, hour, " + r("coalesce(q05, q10)", "lower90") + ", " + r("coalesce(q95, q90)", "upper90")
        + " FROM (SELECT *, median AS q10, median AS q90 FROM forecast_wide)",
        "forecast_wide",
    ),
)
def b12_interval_fallback(spark, sf):
    fw = fx.forecast_wide(spark, sf).withColumns({"q10": F.col("median"), "q90": F.col("median")})
    return rounded(calibration.interval_90(fw).select("model", "zone", "date", "hour", "lower90", "upper90"))


DISPLAY = {"hist": "Historical simulation", "early": "Early window", "late": "Late window"}  # fixed display labels
ALIASES = {"t": "skewt", "studentt": "skewt", "skewt": "skewt", "normal": "normal", "jsu": "jsu"}  # fixed aliases


@query(
    "b13_label_map",
    with_fixtures(
        "SELECT DISTINCT model, CASE model "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items())
        + " END AS display_name FROM samples",
        "samples",
    ),
)
def b13_label_map(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return fx.samples(spark, sf).select("model").distinct().select("model", m[F.col("model")].alias("display_name"))


@query(
    "b14_unpivot_quantiles",
    with_fixtures(
        "SELECT model, zone, date, hour, " + r("x", "x") + ", " + r("CAST(substr(qname, 2, 2) AS DOUBLE) / 100", "q")
        + " FROM forecast_wide UNPIVOT (x FOR qname IN (q05, q25, q75, q95))",
        "forecast_wide",
    ),
)
def b14_unpivot_quantiles(spark, sf):
    fw = fx.forecast_wide(spark, sf).select("model", "zone", "date", "hour", "q05", "q25", "q75", "q95")
    return rounded(scores.unpivot_quantiles(fw, ["model", "zone", "date", "hour"]))


@query(
    "b15_full_days",
    with_fixtures("SELECT zone, CAST(ts AS DATE) AS date, count(*) AS hours FROM hourly_raw GROUP BY 1, 2 HAVING count(*) = 24", "hourly_raw"),
)
def b15_full_days(spark, sf):
    raw = fx.hourly_raw(spark, sf).select("zone", F.to_date("ts").alias("date"))
    full = panel.full_blocks(raw, ["zone"], "date")
    return full.groupBy("zone", "date").agg(F.count(F.lit(1)).alias("hours"))


# ---------------------------------------------------------------- C1, C8-C14, C19
@query("c1_hourly_spine", with_fixtures("SELECT zone, ts FROM spine", "spine"))
def c1_hourly_spine(spark, sf):
    return panel.hourly_spine(fx.hourly_raw(spark, sf), "zone", "ts")


def _fmt_list_sql(expr):
    return f"array_to_string(list_transform({expr}, lambda e: CAST(round(e + 1e-9, 6) + 0.0 AS VARCHAR)), ',')"


def _fmt_list(col):
    return F.array_join(F.transform(col, lambda e: (F.round(e + 1e-9, 6) + 0.0).cast("string")), ",")


_MAT_SQL = (
    "SELECT zone, day_id, min(ts) AS day_start, "
    + _fmt_list_sql("list(premium ORDER BY slot)")
    + " AS y, "
    + _fmt_list_sql(" || ".join(f"list(CAST({f} AS DOUBLE) ORDER BY slot)" for f in MATRIX_FEATURES))
    + " AS x FROM blk WHERE (zone, day_id) IN (SELECT zone, day_id FROM blk GROUP BY 1, 2 HAVING count(*) = 24)"
    " GROUP BY zone, day_id"
)


def _matrix(spark, sf):
    return panel.day_matrix(_blocks(spark, sf), ["zone"], "premium", MATRIX_FEATURES)


@query("c8_c9_day_matrix", with_fixtures(_MAT_SQL, "hourly", local=_FEAT))
def c8_c9_day_matrix(spark, sf):
    m = _matrix(spark, sf)
    return m.select("zone", "day_id", "day_start", _fmt_list(F.col("y")).alias("y"), _fmt_list(F.col("x")).alias("x"))


_SPLIT_SQL = (
    "SELECT zone, CAST(coalesce(min(day_id) FILTER (WHERE day_start >= TIMESTAMP '2024-01-24 00:00:00'), floor(count(*) * 0.8)) AS BIGINT) AS split_day"
    " FROM (SELECT zone, day_id, min(ts) AS day_start FROM blk WHERE (zone, day_id) IN"
    " (SELECT zone, day_id FROM blk GROUP BY 1, 2 HAVING count(*) = 24) GROUP BY zone, day_id) GROUP BY zone"
)


@query("c11_train_split", with_fixtures("SELECT * FROM sp", "hourly", local=_FEAT + [("sp", _SPLIT_SQL)]))
def c11_train_split(spark, sf):
    return panel.train_split_day(_matrix(spark, sf), ["zone"], VAL_START)


_SCALE_FEATS = ["premium", *MATRIX_FEATURES]


def _long_features(spark, sf):
    blocks = panel.full_blocks(_blocks(spark, sf), ["zone"], "day_id")
    long = blocks.select(
        "zone", "day_id", F.col("slot").alias("hour"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in _SCALE_FEATS])).alias("_f"),
    ).select("zone", "day_id", "hour", "_f.feature", "_f.v")
    split = panel.train_split_day(_matrix(spark, sf), ["zone"], VAL_START)
    return long.join(sized_broadcast(split), on="zone")


def _scaler(spark, sf):
    lf = _long_features(spark, sf)
    return panel.fit_scaler(lf.where(F.col("day_id") < F.col("split_day")), ["zone"]), lf


_LONG_SQL = (
    "SELECT b.zone, b.day_id, b.slot AS hour, f.feature, f.v, sp.split_day FROM blk b"
    " JOIN sp ON sp.zone = b.zone"
    " CROSS JOIN LATERAL (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in _SCALE_FEATS)
    + "]) AS feature, unnest(["
    + ", ".join(f"CAST(b.{f} AS DOUBLE)" for f in _SCALE_FEATS)
    + "]) AS v) f WHERE (b.zone, b.day_id) IN (SELECT zone, day_id FROM blk GROUP BY 1, 2 HAVING count(*) = 24)"
)
_SC_SQL = (
    "SELECT zone, feature, hour, avg(v) AS mu, CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS sigma"
    " FROM lf WHERE day_id < split_day GROUP BY zone, feature, hour"
)
_SCALE_LOCAL = _FEAT + [("sp", _SPLIT_SQL), ("lf", _LONG_SQL), ("sc", _SC_SQL)]


@query(
    "c12_fit_scaler",
    with_fixtures(f"SELECT zone, feature, CAST(hour AS INTEGER) AS hour, {r('mu', 'mu')}, {r('sigma', 'sigma')} FROM sc", "hourly", local=_SCALE_LOCAL),
)
def c12_fit_scaler(spark, sf):
    sc, _ = _scaler(spark, sf)
    return rounded(sc.select("zone", "feature", F.col("hour").cast("int").alias("hour"), "mu", "sigma"))


@query(
    "c13_c14_apply_scaler",
    with_fixtures(
        "SELECT lf.zone, lf.day_id, CAST(lf.hour AS INTEGER) AS hour, lf.feature, "
        + r(f"CASE WHEN lf.feature IN ({', '.join(repr(c) for c in panel.CYCLICAL)}) OR sc.mu IS NULL THEN lf.v ELSE (lf.v - sc.mu) / sc.sigma END", "v_scaled")
        + ", "
        + r(f"CASE WHEN lf.feature IN ({', '.join(repr(c) for c in panel.CYCLICAL)}) OR sc.mu IS NULL THEN lf.v ELSE ((lf.v - sc.mu) / sc.sigma) * sc.sigma + sc.mu END", "v_back")
        + " FROM lf LEFT JOIN sc ON sc.zone = lf.zone AND sc.feature = lf.feature AND sc.hour = lf.hour",
        "hourly",
        local=_SCALE_LOCAL,
    ),
)
def c13_c14_apply_scaler(spark, sf):
    sc, lf = _scaler(spark, sf)
    applied = panel.apply_scaler(lf, sized_broadcast(sc), ["zone"])
    j = applied.join(sized_broadcast(sc), on=["zone", "feature", "hour"], how="left")
    back = F.when(F.col("feature").isin(*panel.CYCLICAL) | F.col("mu").isNull(), F.col("v_scaled")).otherwise(
        panel.inverse_scale(F.col("v_scaled"), F.col("mu"), F.col("sigma"))
    )
    return rounded(j.select("zone", "day_id", F.col("hour").cast("int").alias("hour"), "feature", "v_scaled", back.alias("v_back")))


@query("c18_hashed_split")
def c18_hashed_split(spark, sf):
    """C18 (rows-only: DuckDB has no xxhash64): seeded 80/20 split of day blocks."""
    m = _matrix(spark, sf).select("zone", "day_id")
    return m.withColumn("is_train", panel.hashed_split(["zone", "day_id"], seed=42))


@query(
    "c19_daily_arrays",
    with_fixtures(
        f"SELECT zone, CAST({_LT} AS DATE) AS date, " + _fmt_list_sql("list(premium ORDER BY ts)") + " AS values FROM hourly GROUP BY 1, 2",
        "hourly",
    ),
)
def c19_daily_arrays(spark, sf):
    d = panel.daily_arrays(_hourly(spark, sf), ["zone"], "ts", "premium", panel.LOCAL_TZ)
    return d.select("zone", "date", _fmt_list(F.col("values")).alias("values"))


# ---------------------------------------------------------------- C20-C26 preprocessing
_GAPPY = "SELECT s.zone, s.ts, r.premium FROM spine s LEFT JOIN hourly_raw r ON r.zone = s.zone AND r.ts = s.ts"


def _gappy(spark, sf):
    raw = fx.hourly_raw(spark, sf)
    return panel.hourly_spine(raw, "zone", "ts").join(raw.select("zone", "ts", "premium"), on=["zone", "ts"], how="left")


@query(
    "c20_forward_fill",
    with_fixtures(
        f"SELECT zone, ts, {r('last_value(premium IGNORE NULLS) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'premium')} FROM g",
        "spine",
        "hourly_raw",
        local=[("g", _GAPPY)],
    ),
)
def c20_forward_fill(spark, sf):
    return rounded(panel.forward_fill(_gappy(spark, sf), ["zone"], "ts", ["premium"], limit=2))


@query(
    "c21_interpolate",
    with_fixtures(
        "SELECT zone, ts, "
        + r("CASE WHEN premium IS NOT NULL THEN premium ELSE pv + (t - pt) / (nt - pt) * (nv - pv) END", "premium")
        + """ FROM (SELECT zone, ts, premium, epoch(ts) AS t,
              last_value(premium IGNORE NULLS) OVER wp AS pv,
              last_value(CASE WHEN premium IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER wp AS pt,
              first_value(premium IGNORE NULLS) OVER wn AS nv,
              first_value(CASE WHEN premium IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER wn AS nt
           FROM g
           WINDOW wp AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  wn AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "spine",
        "hourly_raw",
        local=[("g", _GAPPY)],
    ),
)
def c21_interpolate(spark, sf):
    return rounded(panel.interpolate(_gappy(spark, sf), ["zone"], "ts", ["premium"]))


@query(
    "c22_winsorize",
    with_fixtures(
        f"SELECT h.zone, h.ts, {r('least(greatest(h.premium, b.lo), b.hi)', 'premium')} FROM hourly h JOIN"
        " (SELECT zone, quantile_cont(premium, 0.01) AS lo, quantile_cont(premium, 0.99) AS hi FROM hourly GROUP BY zone) b"
        " ON b.zone = h.zone",
        "hourly",
    ),
)
def c22_winsorize(spark, sf):
    h = _hourly(spark, sf)
    bounds = orderstats.quantiles_wide(h, ["zone"], "premium", (0.01, 0.99), ("lo", "hi"))
    j = h.join(sized_broadcast(bounds), on="zone")
    return rounded(j.select("zone", "ts", F.least(F.greatest("premium", "lo"), "hi").alias("premium")))


@query(
    "c23_rolling_stats",
    with_fixtures(
        "SELECT zone, ts, "
        + r("avg(premium) OVER w", "premium_roll_mean")
        + ", "
        + r("stddev_pop(premium) OVER w", "premium_roll_std")
        + " FROM hourly WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)",
        "hourly",
    ),
)
def c23_rolling_stats(spark, sf):
    return rounded(panel.rolling_stats(_hourly(spark, sf), ["zone"], "ts", "premium", 24).select("zone", "ts", "premium_roll_mean", "premium_roll_std"))


@query(
    "c24_minmax_scaling",
    with_fixtures(
        f"SELECT h.zone, h.ts, {r('CASE WHEN b.mx > b.mn THEN (h.premium - b.mn) / (b.mx - b.mn) END', 'premium_scaled')} FROM hourly h JOIN"
        " (SELECT zone, min(premium) AS mn, max(premium) AS mx FROM hourly WHERE ts < TIMESTAMP '2024-01-24 00:00:00' GROUP BY zone) b"
        " ON b.zone = h.zone",
        "hourly",
    ),
)
def c24_minmax_scaling(spark, sf):
    h = _hourly(spark, sf)
    b = h.where(F.col("ts") < F.lit(VAL_START)).groupBy("zone").agg(F.min("premium").alias("mn"), F.max("premium").alias("mx"))
    j = h.join(sized_broadcast(b), on="zone")
    scaled = F.when(F.col("mx") > F.col("mn"), (F.col("premium") - F.col("mn")) / (F.col("mx") - F.col("mn")))
    return rounded(j.select("zone", "ts", scaled.alias("premium_scaled")))


@query(
    "c25_kfold",
    with_fixtures(
        "SELECT zone, split, date, fold, CASE WHEN fold <= split THEN 'train' ELSE 'validate' END AS role"
        " FROM f JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS split) ON fold <= split + 1",
        "hourly",
        local=[("f", "SELECT zone, date, CAST(ntile(6) OVER (PARTITION BY zone ORDER BY date) AS INTEGER) AS fold"
                " FROM (SELECT DISTINCT zone, CAST(ts AS DATE) AS date FROM hourly)")],
    ),
)
def c25_kfold(spark, sf):
    days = _hourly(spark, sf).select("zone", F.to_date("ts").alias("date")).distinct()
    return panel.expanding_splits(panel.kfold_ids(days, ["zone"], "date", 6), 6).select("zone", "split", "date", "fold", "role")


@query(
    "c26_three_way_split",
    with_fixtures(
        "SELECT zone, ts, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'train' WHEN ts < TIMESTAMP '2024-01-24 00:00:00'"
        " THEN 'val' ELSE 'test' END AS split FROM hourly",
        "hourly",
    ),
)
def c26_three_way_split(spark, sf):
    h = _hourly(spark, sf)
    return h.select("zone", "ts", panel.three_way_split(F.col("ts"), dt.datetime(2024, 1, 15), VAL_START).alias("split"))


# ---------------------------------------------------------------- D7 / F6 trailing windows
_DAILY_SQL = "SELECT zone, CAST(ts AS DATE) AS date, avg(premium) AS premium FROM hourly GROUP BY 1, 2"


@query(
    "d7_trailing_window_join",
    with_fixtures(
        "SELECT t.zone, t.date AS target_date, count(*) AS hist_days, "
        + r("avg(h.premium)", "hist_mean")
        + " FROM dd t JOIN dd h ON h.zone = t.zone AND h.date >= t.date - 7 AND h.date < t.date GROUP BY t.zone, t.date",
        "hourly",
        local=[("dd", _DAILY_SQL)],
    ),
)
def d7_trailing_window_join(spark, sf):
    daily = _hourly(spark, sf).groupBy("zone", F.to_date("ts").alias("date")).agg(F.avg("premium").alias("premium"))
    targets = daily.select("zone", F.col("date").alias("target_date"))
    j = joins.trailing_window(targets, daily, ["zone"], "target_date", "date", WINDOW_DAYS)
    return rounded(j.groupBy("zone", "target_date").agg(F.count(F.lit(1)).alias("hist_days"), F.avg("premium").alias("hist_mean")))


@query(
    "f6_trailing_frame",
    with_fixtures(
        "SELECT zone, date AS target_date, "
        + r("avg(premium) OVER (PARTITION BY zone ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", "hist_mean")
        + " FROM dd",
        "hourly",
        local=[("dd", _DAILY_SQL)],
    ),
)
def f6_trailing_frame(spark, sf):
    daily = _hourly(spark, sf).groupBy("zone", F.to_date("ts").alias("date")).agg(F.avg("premium").alias("premium"))
    w = Window.partitionBy("zone").orderBy(F.unix_date("date")).rangeBetween(-WINDOW_DAYS, -1)
    return rounded(daily.select("zone", F.col("date").alias("target_date"), F.avg("premium").over(w).alias("hist_mean")))


