"""Skew-safe order statistics: with and without buckets == brute force."""

import itertools
import random

import numpy as np
import pytest

from tidecast.operators import orderstats


def _data(spark, hot=400, cold=7, ties=True):
    rnd = random.Random(7)
    rows = []
    for i in range(hot):  # one hot key holding most rows, with ties
        v = round(rnd.gauss(50, 20), 1 if ties else 6)
        rows.append(("hot", i, v))
    for k in range(5):
        for i in range(cold):
            rows.append((f"k{k}", i, float(rnd.randint(0, 3))))
    rows.append(("single", 0, 4.2))
    return rows, spark.createDataFrame(rows, "key string, sid long, x double")


def _brute(rows, levels):
    out = {}
    for key, grp in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        xs = np.array([r[2] for r in grp])
        n = len(xs)
        gini = sum(abs(a - b) for a in xs for b in xs) / 2  # = sum_i (2i-n-1) x_(i)
        out[key] = (n, gini, [float(np.percentile(xs, q * 100)) for q in levels])
    return out


@pytest.mark.parametrize("per_bucket", [1_000_000, 25])
def test_summary_matches_brute_force(spark, per_bucket):
    rows, df = _data(spark)
    levels = [0.0, 0.05, 0.1, 0.5, 0.9, 0.95, 1.0]
    names = [f"p{i}" for i in range(len(levels))]
    got = {r["key"]: r for r in orderstats.summary(df, ["key"], "x", levels, names, per_bucket=per_bucket).collect()}
    want = _brute(rows, levels)
    assert set(got) == set(want)
    for k, (n, gini, qs) in want.items():
        assert got[k]["n"] == n
        assert got[k]["gini_sum"] == pytest.approx(gini, rel=1e-9, abs=1e-9)
        for nm, q in zip(names, qs):
            assert got[k][nm] == pytest.approx(q, rel=1e-12, abs=1e-12)


def test_bucketed_uses_many_buckets(spark):
    _, df = _data(spark)
    ranked = orderstats.bucketed(df, ["key"], "x", per_bucket=25)
    nb = ranked.where("key = 'hot'").select("_b").distinct().count()
    assert nb >= 10  # the hot key is split across many window partitions


@pytest.mark.parametrize("per_bucket", [1_000_000, 30])
def test_quantiles_long_many_levels(spark, per_bucket):
    rows, df = _data(spark)
    levels = [float(v) for v in np.linspace(0, 1, 100)]
    got = orderstats.quantiles_long(df, ["key"], "x", levels, per_bucket=per_bucket).collect()
    want = _brute(rows, levels)
    assert len(got) == len(want) * len(levels)
    for r in got:
        assert r["value"] == pytest.approx(want[r["key"]][2][r["level_idx"]], rel=1e-12, abs=1e-12)


def test_buckets_stay_small_for_point_masses_and_outliers(spark):
    """60 % zeros and one far outlier, a constant key: no bucket holds more than a small
    multiple of the bound once equal values are one row."""
    rng = np.random.default_rng(0)
    rows = [("hot", 0.0)] * 3000 + [("hot", float(v)) for v in rng.normal(size=1999)] + [("hot", 1e9)] + [("flat", 2.5)] * 500
    df = spark.createDataFrame(rows, "key string, x double")
    ranked = orderstats.bucketed(df, ["key"], "x", per_bucket=100)
    sizes = [r["count"] for r in ranked.groupBy("key", "_b").count().collect()]
    assert max(sizes) <= 250 and len(sizes) >= 15
    got = {r["key"]: r for r in orderstats.summary(df, ["key"], "x", (0.5, 0.99), ("q50", "q99"), per_bucket=100).collect()}
    x = np.sort([v for k, v in rows if k == "hot"])
    assert got["hot"]["q50"] == pytest.approx(np.quantile(x, 0.5)) and got["hot"]["q99"] == pytest.approx(np.quantile(x, 0.99))
    i = np.arange(1, len(x) + 1)
    assert got["hot"]["gini_sum"] == pytest.approx(((2 * i - len(x) - 1) * x).sum())
    assert got["flat"]["gini_sum"] == pytest.approx(0.0) and got["flat"]["q50"] == 2.5


@pytest.mark.parametrize("per_bucket", [1_000_000, 25])
def test_marks_meet_samples_in_one_pass(spark, per_bucket):
    """Counts and sums strictly below any value, present or not, in hot and cold keys."""
    rows, df = _data(spark)
    wanted = [("hot", float(v)) for v in np.linspace(-40, 140, 61)] + [("k1", 1.0), ("k1", -1.0), ("single", 4.2), ("k2", None)]
    marks = spark.createDataFrame(wanted, "key string, x double")
    got = {(r["key"], r["x"]): r for r in orderstats.ranked(df, ["key"], "x", per_bucket, marks=marks).collect()}
    for k, v in wanted[:-1]:
        x = np.array([r[2] for r in rows if r[0] == k])
        r = got[k, v]
        assert (r["_before"], r["_n"], r["_c"]) == ((x < v).sum(), len(x), (x == v).sum())
        assert r["_sbefore"] == pytest.approx(x[x < v].sum())


def test_planning_runs_no_job(spark):
    _, df = _data(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning-only", "")
    orderstats.summary(df, ["key"], "x", [0.5], ["m"], per_bucket=25)
    orderstats.quantiles_long(df, ["key"], "x", [i / 99 for i in range(100)])
    assert not tracker.getJobIdsForGroup("planning-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
