"""Distribution families as column expressions (survey I1-I12).

Conventions fixed here (see README): the JSU law is defined by its sampler,
``X = loc + scale * sinh((eps - skewness) / tailweight)`` with ``eps ~ N(0, 1)``, and
its density is derived from that; the Jones-Faddy skew-t uses the published
normalising constant; sampling is by quantile (inverse-CDF) at given ``u``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import LN_2PI, clamp, lgamma, midpoint_u, norm_ppf, sigmoid, softplus

FLOOR = -100.0  # fixed: log-density floor
ZERO_BAND = 1e-3  # fixed: |y| below this is the zero point mass
EPS = 1e-8  # fixed: stabiliser inside logs

# Raw-score to parameter maps per family — (offset, lower clamp, upper clamp).
PARAM_LAYERS = {
    "normal": {"scale": (1e-3, 1e-3, 10.0)},
    "jsu": {"scale": (1e-3, 1e-6, 1e2), "tailweight": (1.0, 1e-6, 1e2)},
    "skewt": {"scale": (1e-2, 1e-3, 1e2), "a": (2.0, 2.0, 30.0), "b": (2.0, 2.0, 30.0)},
    "zi_normal": {"scale": (1e-3, 1e-4, 10.0)},
    "zi_jsu": {"scale": (1e-3, 1e-4, 10.0), "tailweight": (0.5, 0.1, 20.0)},
    "zi_skewt": {"scale": (1e-2, 1e-3, 1e2), "a": (2.0, 2.0, 30.0), "b": (2.0, 2.0, 30.0)},
}
INPUT_CLAMP = {"normal": 1e6, "jsu": 1e6, "zi_normal": 1e6, "zi_jsu": 1e6, "skewt": 20.0, "zi_skewt": 20.0}
LS_DECAY, LS_REDUCTION = 5.0, 0.5  # fixed defaults of the location-scale layers


# ---------------------------------------------------------------- log densities
def asinh(z: Column) -> Column:
    """``sign(z) * ln(|z| + sqrt(z^2 + 1))`` — accurate for large |z| on both signs."""
    a = F.abs(z)
    return F.signum(z) * F.log(a + F.sqrt(a * a + 1))



def normal_logpdf(y: Column, loc: Column, scale: Column) -> Column:
    """I5; undefined (null) for a degenerate scale <= 0."""
    z = (y - loc) / scale
    return F.when(scale > 0, -0.5 * LN_2PI - F.log(scale) - 0.5 * z * z)


def jsu_logpdf(y: Column, loc: Column, scale: Column, tail: Column, skew: Column) -> Column:
    """Density of the sampler-defined JSU law, floored at -100."""
    sc = clamp(scale, 1e-6)
    tw = clamp(tail, 1e-6)
    z = (y - loc) / sc
    eps = skew + tw * asinh(z)
    lp = F.log(tw) - F.log(sc) - 0.5 * F.log1p(z * z) - 0.5 * eps * eps - 0.5 * LN_2PI
    return F.greatest(lp, F.lit(FLOOR))


def skewt_logpdf(y: Column, loc: Column, scale: Column, a: Column, b: Column) -> Column:
    """Jones-Faddy skew-t with the published constant
    ``-(a+b-1) ln 2 - ln B(a,b) - 1/2 ln(a+b)``; clamps a, b to [2, 30], scale to
    [1e-3, 1e2], z to [-50, 50]; result clamped to [-100, 100]."""
    a = clamp(a, 2.0, 30.0)
    b = clamp(b, 2.0, 30.0)
    sc = clamp(scale, 1e-3, 1e2)
    z = clamp((y - loc) / sc, -50.0, 50.0)
    root = F.sqrt(a + b + z * z + EPS)
    t1 = clamp(1 + z / root, EPS)
    t2 = clamp(1 - z / root, EPS)
    log_c = -(a + b - 1) * F.log(F.lit(2.0)) - (lgamma(a) + lgamma(b) - lgamma(a + b)) - 0.5 * F.log(a + b)
    lp = log_c + (a + 0.5) * F.log(t1) + (b + 0.5) * F.log(t2) - F.log(sc)
    return clamp(lp, FLOOR, 100.0)


def zero_inflated_logpdf(y: Column, p0: Column, base_logpdf: Column) -> Column:
    """I8: point mass ``p0`` at zero (|y| < 1e-3), else ``(1 - p0) * base``."""
    return F.when(F.abs(y) < ZERO_BAND, F.log(p0 + EPS)).otherwise(F.log(1 - p0 + EPS) + base_logpdf)


# ---------------------------------------------------------------- quantile functions
def normal_quantile(u: Column, loc: Column, scale: Column) -> Column:
    """I1/I12."""
    return loc + scale * norm_ppf(u)


def jsu_quantile(u: Column, loc: Column, scale: Column, tail: Column, skew: Column) -> Column:
    """I2."""
    return loc + scale * F.sinh((norm_ppf(u) - skew) / tail)


def zero_inflated_quantile(u: Column, p0: Column, base_quantile) -> Column:
    """``u <= p0`` is the zero mass, else the base law at ``(u - p0) / (1 - p0)``."""
    return F.when(u <= p0, F.lit(0.0)).otherwise(base_quantile((u - p0) / (1 - p0)))


def expand(params: DataFrame, keys, n: int, quantile) -> DataFrame:
    """``n`` deterministic samples per parameter row at the midpoint
    grid; ``quantile(u)`` builds the sample expression from the row's columns."""
    g = params.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_id"))
    u = midpoint_u(F.col("sample_id"), n)
    return g.select(*keys, F.col("sample_id").cast("long").alias("sample_id"), quantile(u).alias("x"))


def skewt_expand(params: DataFrame, keys, n: int, grid: int = 2000) -> DataFrame:
    """Skew-t samples ``loc + scale * sqrt(a+b)(2B-1) / (2 sqrt(B(1-B)))`` with
    ``B`` the Beta(a, b) quantile at ``u``.

    The Beta quantile is found numerically per parameter row: the Beta density on a
    ``grid``-point midpoint grid of (0, 1) gives the CDF at the grid edges (running
    sum); the sample levels ``u`` are merged with those edges in one window ordered
    by probability, where each ``u`` reads its neighbouring edges (``last`` / ``first``
    ignoring nulls) and interpolates.  A window partition holds one row's grid and
    samples (``grid + n`` rows), so it is bounded."""
    keys = list(keys)
    a, b = F.col("a"), F.col("b")
    base = params.select(*keys, "loc", "scale", "a", "b")
    g = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("_j"))
    bmid = (F.col("_j") - 0.5) / grid
    log_norm = lgamma(a) + lgamma(b) - lgamma(a + b)
    dens = F.when(F.col("_j") == 0, F.lit(0.0)).otherwise(
        F.exp((a - 1) * F.log(bmid) + (b - 1) * F.log(1 - bmid) - log_norm) / grid
    )
    run = Window.partitionBy(*keys).orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    edges = g.withColumn("_d", dens).select(
        *keys, "loc", "scale", "a", "b",
        (F.sum("_d").over(run) / F.sum("_d").over(Window.partitionBy(*keys))).alias("_v"),
        (F.col("_j") / grid).alias("_B"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("sample_id"),
    )
    pts = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_id")).select(
        *keys, "loc", "scale", "a", "b",
        midpoint_u(F.col("sample_id"), n).alias("_v"),
        F.lit(None).cast("double").alias("_B"),
        F.lit(1).alias("_kind"),
        F.col("sample_id").cast("long").alias("sample_id"),
    )
    both = edges.unionByName(pts)
    # both lookups use growing frames (linear); the "next edge" reads in descending order
    below = Window.partitionBy(*keys).orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.col("_v").desc(), F.col("_kind").asc()).rowsBetween(Window.unboundedPreceding, 0)
    is_edge = F.col("_kind") == 0
    m = both.withColumns(
        {
            "_v0": F.last(F.when(is_edge, F.col("_v")), ignorenulls=True).over(below),
            "_b0": F.last(F.when(is_edge, F.col("_B")), ignorenulls=True).over(below),
            "_v1": F.last(F.when(is_edge, F.col("_v")), ignorenulls=True).over(above),
            "_b1": F.last(F.when(is_edge, F.col("_B")), ignorenulls=True).over(above),
        }
    ).where(F.col("_kind") == 1)
    bq = F.when(F.col("_v1") > F.col("_v0"),
                F.col("_b0") + (F.col("_v") - F.col("_v0")) / (F.col("_v1") - F.col("_v0")) * (F.col("_b1") - F.col("_b0"))
                ).otherwise(F.col("_b0"))
    bq = clamp(bq, 1e-12, 1 - 1e-12)
    t = F.sqrt(a + b) * (2 * bq - 1) / (2 * F.sqrt(bq * (1 - bq)))
    return m.select(*keys, "sample_id", (F.col("loc") + F.col("scale") * t).alias("x"))


# ---------------------------------------------------------------- raw scores -> params
def raw_to_params(family: str, raw: dict[str, Column]) -> dict[str, Column]:
    """Map unconstrained scores to valid parameters (softplus + offset, clamps;
    location and skewness clipped; zero probability through a sigmoid)."""
    lim = INPUT_CLAMP[family]
    rc = {k: clamp(v, -lim, lim) for k, v in raw.items()}
    out = {"loc": rc["loc"]}
    for p, (off, lo, hi) in PARAM_LAYERS[family].items():
        out[p] = clamp(F.lit(off) + softplus(rc[p]), lo, hi)
    if "skewness" in rc and family in ("jsu", "zi_jsu"):
        out["skewness"] = clamp(rc["skewness"], -10.0, 10.0)
    if family.startswith("zi_"):
        out["zero_prob"] = sigmoid(raw["zero"])
    return out


def ls_shrink(scale: Column, loc: Column, decay: float = LS_DECAY, reduction: float = LS_REDUCTION) -> Column:
    """``scale * (1 - reduction * exp(-decay * |loc|))``."""
    return scale * (1 - reduction * F.exp(-decay * F.abs(loc)))
