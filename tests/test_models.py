"""Property checks for grouped models (rows-only operators in the registry)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import models


def _rows(spark, n=300, groups=("g1", "g2")):
    rnd = random.Random(3)
    data = []
    for g in groups:
        for i in range(n):
            x1 = rnd.uniform(-2, 2)
            y = 5.0 + 2.0 * x1 + rnd.gauss(0, 1 + 0.5 * abs(x1))
            data.append((g, y, [1.0, x1]))
    return data, spark.createDataFrame(data, "g string, y double, x array<double>")


def _pinball(q, y, pred):
    e = y - pred
    return np.mean(np.maximum(q * e, (q - 1) * e))


def test_intercept_only_is_a_quantile(spark):
    data, df = _rows(spark)
    df1 = df.withColumn("x", F.array(F.lit(1.0)))
    coefs = models.quantile_regression(df1, ["g"], 1, quantiles=(0.1, 0.5, 0.9)).collect()
    for r in coefs:
        ys = np.array([d[1] for d in data if d[0] == r["g"]])
        b = r["beta"][0]
        # the fit minimises the pinball loss: it must be as good as the empirical quantile
        assert _pinball(r["q"], ys, b) <= _pinball(r["q"], ys, np.quantile(ys, r["q"])) + 1e-3


def test_quantile_regression_beats_intercept_and_covers(spark):
    data, df = _rows(spark)
    coefs = models.quantile_regression(df, ["g"], 2, quantiles=(0.1, 0.5, 0.9))
    pr = models.predict_quantiles(df, coefs, ["g"]).collect()
    for q in (0.1, 0.5, 0.9):
        sel = [r for r in pr if r["q"] == q]
        ys = np.array([r["y"] for r in sel])
        preds = np.array([r["pred"] for r in sel])
        assert _pinball(q, ys, preds) <= _pinball(q, ys, np.quantile(ys, q)) + 1e-9
        assert abs(np.mean(ys <= preds) - q) < 0.05  # in-sample coverage


def test_l1_penalty_shrinks_slope(spark):
    _, df = _rows(spark)
    free = models.quantile_regression(df, ["g"], 2, quantiles=(0.5,)).where("g = 'g1'").first()["beta"][1]
    pen = models.quantile_regression(df, ["g"], 2, quantiles=(0.5,), alpha=0.5).where("g = 'g1'").first()["beta"][1]
    assert abs(pen) < abs(free)


def test_location_scale_recovers_heteroscedasticity(spark):
    _, df = _rows(spark, n=2000, groups=("g1",))
    df = df.withColumn("x", F.array(F.lit(1.0), F.abs(F.col("x")[1])))
    coefs = models.location_scale(df, ["g"], 2)
    row = coefs.first()
    assert row["beta_scale"][1] > 0  # spread grows with |x1|


def test_wls_matches_numpy(spark):
    data, df = _rows(spark, n=200, groups=("g1",))
    beta = models.wls(df, ["g"], 2).first()["beta"]
    xs = np.array([d[2] for d in data])
    ys = np.array([d[1] for d in data])
    ref = np.linalg.lstsq(xs, ys, rcond=None)[0]
    assert beta == pytest.approx(list(ref), rel=1e-6, abs=1e-6)
