"""Panel operators on literal edge cases (DST days, constant features, flags)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import joins, panel


def test_dst_align_lengths(spark):
    rows = [("autumn", list(range(25))), ("spring", list(range(23))), ("normal", list(range(24))), ("short", list(range(7)))]
    df = spark.createDataFrame([(k, [float(v) for v in vs]) for k, vs in rows], "k string, v array<double>")
    got = {r["k"]: r["a"] for r in df.select("k", joins.dst_align(F.col("v")).alias("a")).collect()}
    assert got["autumn"] == [0.0, 1.0, 2.0] + [float(v) for v in range(4, 25)]
    assert got["spring"] == [0.0, 1.0, 2.0, 2.0] + [float(v) for v in range(3, 23)]
    assert got["normal"] == [float(v) for v in range(24)]
    assert got["short"] is None
    assert all(len(got[k]) == 24 for k in ("autumn", "spring", "normal"))


def test_local_time_across_dst(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 1, 30),), (dt.datetime(2024, 10, 27, 0, 30),), (dt.datetime(2024, 10, 27, 1, 30),)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(panel.to_local("ts")).collect()]
    assert got == [dt.datetime(2024, 3, 31, 3, 30), dt.datetime(2024, 10, 27, 2, 30), dt.datetime(2024, 10, 27, 2, 30)]


def test_local_days_have_23_and_25_hours(spark):
    start = dt.datetime(2024, 3, 30, 0, 0)
    hours = [(start + dt.timedelta(hours=i), float(i)) for i in range(72)]
    df = spark.createDataFrame(hours, "ts timestamp_ntz, v double").withColumn("lt", panel.to_local("ts")).withColumn("z", F.lit("a"))
    days = {r["date"]: len(r["values"]) for r in panel.daily_arrays(df, ["z"], "lt", "v").collect()}
    assert days[dt.date(2024, 3, 31)] == 23


def test_scaler_constant_feature_guard(spark):
    rows = [("z", "f", 0, float(d), 5.0) for d in range(4)]
    df = spark.createDataFrame(rows, "zone string, feature string, hour int, day double, v double")
    sc = panel.fit_scaler(df, ["zone"]).first()
    assert sc["mu"] == 5.0 and sc["sigma"] == 1.0
    out = panel.apply_scaler(df, panel.fit_scaler(df, ["zone"]), ["zone"]).select("v_scaled").distinct().collect()
    assert [r[0] for r in out] == [0.0]


def test_scaler_roundtrip(spark):
    rows = [("z", "f", h, float(d * 3 + h)) for d in range(5) for h in range(2)]
    df = spark.createDataFrame(rows, "zone string, feature string, hour int, v double")
    sc = panel.fit_scaler(df, ["zone"])
    app = panel.apply_scaler(df, sc, ["zone"]).join(sc, ["zone", "feature", "hour"])
    back = app.select((F.col("v") - panel.inverse_scale(F.col("v_scaled"), F.col("mu"), F.col("sigma"))).alias("d"))
    assert max(abs(r[0]) for r in back.collect()) < 1e-12


def _register(spark):
    feats = ["price_up", "price_up_d2", "price_up_d3", "vol_down", "vol_down_d7", "hour_sin"]
    return panel.feature_register(feats, spark)


def test_feature_register_and_families(spark):
    reg = _register(spark)
    assert [r["start_idx"] for r in reg.orderBy("pos").collect()] == [0, 24, 48, 72, 96, 120]
    fam = {r["family"]: r for r in panel.feature_families(reg).collect()}
    assert fam["price_up"]["members"] == ["price_up", "price_up_d2", "price_up_d3"]
    assert fam["price_up"]["start_idx"] == 0 and fam["vol_down"]["start_idx"] == 72 and fam["hour_sin"]["start_idx"] == 120


def test_select_groups_forces_first_when_none(spark):
    reg = _register(spark)
    none = spark.createDataFrame([("price_up", False)], "feature string, selected boolean")
    assert [r["feature"] for r in panel.select_groups(reg, none).collect()] == ["price_up"]
    some = spark.createDataFrame([("vol_down", True), ("hour_sin", True)], "feature string, selected boolean")
    assert sorted(r["feature"] for r in panel.select_groups(reg, some).collect()) == ["hour_sin", "vol_down"]


def test_sibling_selection(spark):
    reg = _register(spark)
    flags = spark.createDataFrame([("price_up_d3", True), ("price_up_d2", False)], "feature string, selected boolean")
    kept = sorted(r["feature"] for r in panel.sibling_selection(reg, flags).collect())
    assert kept == ["price_up", "price_up_d2", "price_up_d3"]


def test_expanded_names(spark):
    reg = _register(spark).where("feature = 'hour_sin'")
    names = [r["name"] for r in panel.expanded_names(reg).orderBy("hour").collect()]
    assert names[0] == "hour_sin_0" and names[-1] == "hour_sin_23" and len(names) == 24


def test_trailing_window_matches_brute_force(spark):
    days = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40) if i % 5 != 3]
    df = spark.createDataFrame(days, "zone string, date date, v double")
    t = df.select("zone", F.col("date").alias("t"))
    got = {r["t"]: (r["n"], r["s"]) for r in joins.trailing_window(t, df, ["zone"], "t", "date", 9, bucket_days=4)
           .groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    for _, d, _ in days:
        hist = [v for _, d2, v in days if d - dt.timedelta(days=9) <= d2 < d]
        if hist:
            assert got[d] == (len(hist), sum(hist))
        else:
            assert d not in got


def test_lags_by_time_skip_gaps_and_follow_the_clock(spark):
    t0 = dt.datetime(2024, 3, 29, 0)
    rows = [("z", t0 + dt.timedelta(hours=i), float(i)) for i in range(96) if i % 7 != 5]
    df = spark.createDataFrame(rows, "zone string, ts timestamp_ntz, v double")
    have = {t: v for _, t, v in rows}
    got = {r.ts: r for r in panel.lags_by_time(df, ["zone"], "ts", ["v"], {"d1": 24}).collect()}
    assert len(got) == len(rows) and all(r.v_d1 == have.get(t - dt.timedelta(hours=24)) for t, r in got.items())
    # Oslo skips 2:00 on 31 March: one local day before 12:00 (10:00 UTC) is 11:00 UTC of the 30th.
    got = {r.ts: r for r in panel.lags_by_time(df, ["zone"], "ts", ["v"], {"d1": 24}, tz=panel.LOCAL_TZ).collect()}
    assert got[dt.datetime(2024, 3, 31, 10)].v_d1 == have.get(dt.datetime(2024, 3, 30, 11))
    assert got[dt.datetime(2024, 3, 30, 10)].v_d1 == have.get(dt.datetime(2024, 3, 29, 10))


def test_clock_lag_over_the_repeated_hour_takes_the_later_one(spark):
    rows = [("z", dt.datetime(2024, 10, 26, 22) + dt.timedelta(hours=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "zone string, ts timestamp_ntz, v double")
    got = {r.ts: r.v_d1 for r in panel.lags_by_time(df, ["zone"], "ts", ["v"], {"d1": 24}, tz=panel.LOCAL_TZ).collect()}
    assert got[dt.datetime(2024, 10, 28, 1)] == 3.0  # 2:00 local a day earlier was 0:00 and 1:00 UTC
    assert panel.lags_by_time(df.limit(0), ["zone"], "ts", ["v"]).count() == 0
