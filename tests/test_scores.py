"""Scoring, ensembles, ranks and decision rules against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import decisions, ensemble, report, scores


def _samples(spark):
    rows = []
    rng = np.random.default_rng(5)
    for m, shift in (("a", 0.0), ("b", 3.0)):
        for h in (0, 1):
            for i in range(40):
                rows.append((m, "z", h, i, float(np.round(rng.normal(10 + shift, 2), 2))))
    rows.append(("a", "z", 2, 0, 7.0))  # single-sample key
    s = spark.createDataFrame(rows, "model string, zone string, hour int, sample_id int, x double")
    a = spark.createDataFrame([("z", "2024-01-01", 0, 11.0), ("z", "2024-01-01", 1, 8.5), ("z", "2024-01-01", 2, 7.5)], "zone string, date string, hour int, y double")
    return rows, s, a


def test_crps_equals_pairwise_definition(spark):
    rows, s, a = _samples(spark)
    hs = {(r["model"], r["hour"]): r for r in scores.hourly_scores(s, a, ["model", "zone", "hour"]).collect()}
    ys = {0: 11.0, 1: 8.5, 2: 7.5}
    for (m, h), r in hs.items():
        xs = np.array([x for mm, _, hh, _, x in rows if mm == m and hh == h])
        y = ys[h]
        crps = np.mean(np.abs(xs - y)) - 0.5 * np.mean(np.abs(xs[:, None] - xs[None, :]))
        assert r["crps"] == pytest.approx(crps, abs=1e-9)
        med = np.median(xs)
        assert r["pinball_q50"] == pytest.approx(0.5 * abs(y - med), abs=1e-9)
        lo, hi = np.percentile(xs, [5, 95])
        w = (hi - lo) + (2 / 0.9) * max(lo - y, 0) + (2 / 0.9) * max(y - hi, 0)
        assert r["winkler"] == pytest.approx(w, abs=1e-9)
    assert hs[("a", 2)]["crps"] == pytest.approx(0.5)  # n = 1: CRPS = |x - y|


def test_one_member_horizontal_is_that_member(spark):
    rows, s, _ = _samples(spark)
    h = ensemble.horizontal(s.where("model = 'a' AND hour = 0"), ["zone", "hour"], "model", "x", 100, min_members=1).collect()
    xs = np.array([x for m, _, hh, _, x in rows if m == "a" and hh == 0])
    for r in h:
        assert r["value"] == pytest.approx(float(np.quantile(xs, r["q"])), abs=1e-9)


def test_min_members_skips(spark):
    _, s, _ = _samples(spark)
    keys = {r["hour"] for r in ensemble.horizontal(s, ["zone", "hour"], "model", "x", 10).select("hour").distinct().collect()}
    assert keys == {0, 1}  # hour 2 has one member only


def test_vertical_exceedance_is_mean_of_members(spark):
    _, s, _ = _samples(spark)
    th = 11.0
    # members of unequal size count the same
    pool = ensemble.mixture_stats(ensemble.vertical(s, ["zone", "hour"]), ["zone", "hour"], "x", (), (), threshold=th).where("hour = 0").first()
    per = scores.exceedance(s.where("hour = 0"), ["model"], threshold=th).collect()
    assert pool["up_prob"] == pytest.approx(np.mean([r["up_prob"] for r in per]))


def test_vertical_gives_members_of_unequal_size_the_same_weight(spark):
    rows = [("k", "a", 0.0)] * 10 + [("k", "b", 10.0)] * 1000 + [("only", "a", 1.0)]
    s = spark.createDataFrame(rows, "key string, model string, x double")
    got = ensemble.mixture_stats(ensemble.vertical(s, ["key"]), ["key"], "x", (0.4, 0.6), ("lo", "hi")).collect()
    assert [(r["key"], round(r["mean"], 9), round(r["std"], 9), r["lo"], r["hi"], round(r["up_prob"], 9)) for r in got] == [("k", 5.0, 5.0, 0.0, 10.0, 0.5)]


def test_ties_take_minimum_rank(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "model string, crps double")
    ranks = {r["model"]: r["crps_rank"] for r in scores.rank_models(t, ["crps"]).collect()}
    assert ranks == {"a": 1, "b": 1, "c": 3}


def test_prob_threshold_rule_edges(spark):
    fc = spark.createDataFrame(
        [("m", 1, 40.0, 41.0, 30.0, 35.0, 45.0, 55.0),  # no quantile above 60 -> P = 0 -> no bid
         ("m", 2, 80.0, 79.0, 65.0, 70.0, 90.0, 99.0)],  # q05 above 60 -> P = 0.95 -> bid at median
        "model string, hour int, mean double, median double, q05 double, q25 double, q75 double, q95 double")
    st = spark.createDataFrame([("PT", "prob_threshold", "m", 60.0, 0.7, None, None, None),
                                ("CV", "cvar", "m", None, None, 60.0, 0.95, 0.3)],
                               "strategy string, rule string, model string, threshold double, prob double, da_price double, alpha double, risk double")
    got = {(r["strategy"], r["hour"]): (r["bid"], r["bid_price"]) for r in decisions.decisions(fc, st).collect()}
    assert got[("PT", 1)] == (False, 0.0)
    assert got[("PT", 2)] == (True, 79.0)
    assert got[("CV", 2)] == (True, 80.0)  # 80 - 0.3 * (80 - 99) = 85.7 > 60
    assert got[("CV", 1)][0] is False


def test_heat_bands_exclusion(spark):
    t = spark.createDataFrame([("naive", "crps", 10.0), ("a", "crps", 1.0), ("b", "crps", 2.0), ("c", "crps", 1.5)], "model string, metric string, value double")
    hb = {r["model"]: r for r in report.heat_bands(t, "metric", "value", "model", exclude=["naive"]).collect()}
    assert hb["a"]["band"] == 1 and hb["a"]["is_best"] and hb["b"]["band"] == 7 and hb["naive"]["band"] == 7
    assert hb["c"]["norm"] == pytest.approx(0.5) and hb["c"]["band"] == 4
    _ = F


def test_forecasts_of_one_date_meet_only_their_own_observation(spark):
    rng = np.random.default_rng(8)
    xs = {(d, h): np.round(rng.normal(d, 1 + h, 5 + d), 2) for d in range(4) for h in range(3)}
    s = spark.createDataFrame([("m", d, h, float(x)) for (d, h), v in xs.items() for x in v], "model string, date int, hour int, x double")
    ys = {(d, h): float(xs[d, h][0]) if h == 0 and d < 4 else d + 0.25 for d in range(5) for h in range(3)} | {(3, 2): None}
    a = spark.createDataFrame([(d, h, y) for (d, h), y in ys.items()], "date int, hour int, y double")
    got = {(r["date"], r["hour"]): r for r in scores.hourly_scores(s, a, ["model", "date", "hour"]).collect()}
    assert set(got) == set(xs)  # no forecast for day 4
    for k, x in xs.items():
        if ys[k] is None:
            assert got[k]["crps"] is None and got[k]["abs_err"] is None
            continue
        want = np.mean(np.abs(x - ys[k])) - 0.5 * np.mean(np.abs(x[:, None] - x[None, :]))
        assert got[k]["crps"] == pytest.approx(want, abs=1e-9) and got[k]["n"] == len(x)


def test_order_index_equals_rank_with_ties_nulls_and_a_hot_key(spark):
    from tidecast.operators import orderstats

    rows = [("hot", i, float(i % 37)) for i in range(500)] + [("hot", 900, None), ("cold", 1, 2.0), ("cold", 2, 2.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double")
    got = sorted(map(str, orderstats.order_index(df, ["k"], "x", per_bucket=5).select("k", "id", "i").collect()))
    df.createOrReplaceTempView("order_rows")
    want = spark.sql("SELECT k, id, rank() OVER (PARTITION BY k ORDER BY x) AS i FROM order_rows").collect()
    assert got == sorted(map(str, want))
