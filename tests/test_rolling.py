"""Sliding-sum fits equal refitting every window, on gaps, trends and awkward rows."""

import datetime as dt

import numpy as np
import pytest

from tidecast.operators import ensemble, rolling
from tidecast.sources import fixtures as fx

D0 = dt.date(2020, 1, 1)


def _rows(n_days=900, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for g in ("a", "b"):
        for i in range(n_days):
            if i % 11 == 3 or 300 <= i < 330:  # gaps
                continue
            for _ in range(1 + (g == "a") * (i % 3)):
                t = 1e4 + i / 365
                f = float(rng.normal())
                out.append((g, D0 + dt.timedelta(days=i), [1.0, f, t], float(1e6 + 5 * f + 30 * t + rng.normal())))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, d date, x array<double>, y double").repartition(6)


@pytest.mark.parametrize("days", [30, 730])
def test_equals_refitting_each_day(spark, days):
    rows = _rows()
    df = _frame(spark, rows)
    fits = rolling.trailing_fits(df, ["g"], "d", 3, days, least_rows=20)
    got = {(r.g, r.d): r for r in rolling.predict(df.dropDuplicates(["g", "d"]), fits, ["g"], "d", keep=["x"]).collect()}
    for g in ("a", "b"):
        for d in sorted({r[1] for r in rows if r[0] == g}):
            w = [r for r in rows if r[0] == g and d - dt.timedelta(days=days) <= r[1] < d]
            if len(w) < 20:
                assert (g, d) not in got
                continue
            x, y = np.array([r[2] for r in w]), np.array([r[3] for r in w])
            m = x.mean(axis=0) * [0, 1, 1]
            beta = np.linalg.lstsq(x - m, y - y.mean(), rcond=None)[0]
            r = got[g, d]
            assert r.n == len(w)
            assert r.loc == pytest.approx(y.mean() + (np.array(r.x) - m) @ beta, rel=1e-9)
            left = y - y.mean() - (x - m) @ beta
            assert r.scale == pytest.approx(np.sqrt(left @ left / (len(w) - 3)), rel=1e-6)


def test_awkward_rows(spark):
    rows = [("a", D0, None, 1.0), ("a", D0, [1.0, None], 1.0), ("a", None, [1.0, 1.0], 1.0), (None, D0, [1.0, 1.0], 1.0), ("a", D0, [1.0, 1.0], None)]
    rows += [("a", D0 + dt.timedelta(days=i), [1.0, 2.0], 7.0) for i in range(9)]  # constant: collinear with the intercept
    df = _frame(spark, rows)
    fits = rolling.trailing_fits(df, ["g"], "d", 2, 4, least_rows=3)
    got = {r.d: r for r in rolling.predict(df.where("x is not null and d is not null"), fits, ["g"], "d").collect()}
    assert sorted((d - D0).days for d in got) == [3, 4, 5, 6, 7, 8]
    assert all(r.loc == pytest.approx(7.0) and r.scale == pytest.approx(0.0, abs=1e-9) and r.n == min((r.d - D0).days, 4) for r in got.values())
    assert rolling.trailing_fits(df.limit(0), ["g"], "d", 2, 4, 1).count() == 0


def test_quantiles_are_normal_around_the_location(spark):
    df = _frame(spark, _rows(60))
    fits = rolling.trailing_fits(df, ["g"], "d", 3, 40, least_rows=10)
    one = df.dropDuplicates(["g", "d"])
    loc = {(r.g, r.d): r for r in rolling.predict(one, fits, ["g"], "d").collect()}
    for r in rolling.predict_quantiles(one, fits, ["g"], "d", (0.05, 0.5, 0.95)).collect():
        z = {0.05: -1.6448536269514722, 0.5: 0.0, 0.95: 1.6448536269514722}[r.q]
        assert r.pred == pytest.approx(loc[r.g, r.d].loc + z * loc[r.g, r.d].scale, rel=1e-9)


def test_windows_follow_the_dates_of_the_table():
    a, b = fx.Span(dt.date(2024, 1, 1), dt.date(2024, 1, 30)), fx.Span(dt.date(2031, 5, 4), dt.date(2031, 6, 2))
    assert (a.evaluation, a.validation) == (dt.date(2024, 1, 22), dt.date(2024, 1, 24))
    assert [(m, str(x), str(y)) for m, _, x, y in a.windows] == [("hist", "2024-01-01", "2024-01-21"), ("early", "2024-01-01", "2024-01-10"), ("late", "2024-01-11", "2024-01-21")]
    shift = b.first - a.first
    assert [x + shift for _, _, x, _ in a.windows] == [x for _, _, x, _ in b.windows] and b.validation == a.validation + shift


def test_a_key_that_one_member_lacks_is_not_pooled(spark):
    rows = [("z", h, m, float(v)) for h, m in ((0, "early"), (0, "late"), (3, "early")) for v in range(4)]
    pool = ensemble.vertical(spark.createDataFrame(rows, "zone string, hour int, model string, x double"), ["zone", "hour"], "model")
    assert {(r.zone, r.hour) for r in pool.collect()} == {("z", 0)}
