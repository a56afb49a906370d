"""Special functions and densities against independent references."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import dist, special


def test_norm_ppf_matches_python(spark):
    ps = [1e-6, 1e-3, 0.01, 0.02425, 0.03, 0.2, 0.5, 0.77, 0.97, 0.999, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(special.norm_ppf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=2e-9, abs=2e-9)


def test_lgamma_matches_math(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 3.5, 7.0, 12.3, 60.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(special.lgamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), abs=1e-10)


def _integrate(spark, expr_builder, lo, hi, n=200001):
    xs = np.linspace(lo, hi, n)
    df = spark.range(n).select((F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1))).alias("y"))
    dens = df.select(F.exp(expr_builder(F.col("y"))).alias("d")).agg(F.sum("d")).first()[0]
    return dens * (xs[1] - xs[0])


@pytest.mark.parametrize("a,b", [(2.0, 2.0), (3.0, 3.0), (5.0, 3.0)])
def test_skewt_density_integrates_to_one(spark, a, b):
    mass = _integrate(spark, lambda y: dist.skewt_logpdf(y, F.lit(0.0), F.lit(1.0), F.lit(a), F.lit(b)), -50, 50)
    assert mass == pytest.approx(1.0, abs=2e-3)  # tails beyond |z| = 50 are clamped


def test_jsu_density_integrates_to_one(spark):
    mass = _integrate(spark, lambda y: dist.jsu_logpdf(y, F.lit(1.0), F.lit(2.0), F.lit(1.5), F.lit(0.3)), -200, 200)
    assert mass == pytest.approx(1.0, abs=1e-4)


def test_jsu_sampler_and_density_agree(spark):
    # median of the sampler law: u = 0.5 -> loc + scale * sinh(-skew / tail)
    med = spark.range(1).select(dist.jsu_quantile(F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.3))).first()[0]
    assert med == pytest.approx(math.sinh(-0.3 / 2.0), rel=1e-9)
    cdf_half = _integrate(spark, lambda y: dist.jsu_logpdf(y, F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.3)), -200, med)
    assert cdf_half == pytest.approx(0.5, abs=1e-3)  # endpoint-weight error of the sum


def test_zero_inflated_branch(spark):
    row = spark.range(1).select(
        dist.zero_inflated_logpdf(F.lit(0.0005), F.lit(0.3), F.lit(-1.0)).alias("zero"),
        dist.zero_inflated_logpdf(F.lit(-0.0005), F.lit(0.3), F.lit(-1.0)).alias("zero2"),
        dist.zero_inflated_logpdf(F.lit(2.0), F.lit(0.3), F.lit(-1.0)).alias("base"),
    ).first()
    assert row["zero"] == pytest.approx(math.log(0.3 + 1e-8))
    assert row["zero2"] == pytest.approx(math.log(0.3 + 1e-8))
    assert row["base"] == pytest.approx(math.log(0.7 + 1e-8) - 1.0)


def test_skewt_expand_moments(spark):
    params = spark.createDataFrame([("k", 0.0, 1.0, 4.0, 4.0), ("s", 1.0, 2.0, 6.0, 3.0)], "key string, loc double, scale double, a double, b double")
    xs = dist.skewt_expand(params, ["key"], 2000).groupBy("key").agg(F.avg("x").alias("m")).collect()
    got = {r["key"]: r["m"] for r in xs}
    assert got["k"] == pytest.approx(0.0, abs=0.01)  # symmetric when a = b
    # mean of JF skew-t: (a-b) sqrt(a+b) Gamma(a-1/2) Gamma(b-1/2) / (2 Gamma(a) Gamma(b))
    a, b = 6.0, 3.0
    mean_t = (a - b) * math.sqrt(a + b) * math.gamma(a - 0.5) * math.gamma(b - 0.5) / (2 * math.gamma(a) * math.gamma(b))
    assert got["s"] == pytest.approx(1.0 + 2.0 * mean_t, rel=0.02)
