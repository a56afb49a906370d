"""Distribution expansions and densities over fitted parameter tables: I1-I12, E19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist
from ..functions.special import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW
from ..operators import ensemble
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

PK = ["model", "zone", "hour"]
N_SAMPLES = 20


# ------------------------------------------------------------------ oracle text
def _horner_sql(coefs, x, tail_one=False):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * {x} + {c!r}"
    if tail_one:
        acc = f"({acc}) * {x} + 1.0"
    return acc


def ppf_sql(p: str) -> str:
    lo = "sqrt(-2 * ln(" + p + "))"
    hi = "sqrt(-2 * ln(1 - " + p + "))"
    qc = f"({p} - 0.5)"
    rc = f"({qc} * {qc})"
    return (
        f"(CASE WHEN {p} < {PPF_LOW!r} THEN ({_horner_sql(PPF_C, lo)}) / ({_horner_sql(PPF_D, lo, True)})"
        f" WHEN {p} > 1 - {PPF_LOW!r} THEN -({_horner_sql(PPF_C, hi)}) / ({_horner_sql(PPF_D, hi, True)})"
        f" ELSE ({_horner_sql(PPF_A, rc)}) * {qc} / ({_horner_sql(PPF_B, rc, True)}) END)"
    )


_GRID = [("g", f"SELECT p.*, i AS sample_id, (CAST(i AS DOUBLE) - 0.5) / {N_SAMPLES} AS u FROM param_fc p, range(1, {N_SAMPLES + 1}) t(i)")]


def _expand_sql(expr):
    return with_fixtures(f"SELECT model, zone, hour, sample_id, {r(expr, 'x')} FROM g", "param_fc", local=_GRID)


def _params(spark, sf):
    return fx.param_fc(spark, sf)


# ------------------------------------------------------------------ expansions
@query("i1_expand_normal", _expand_sql(f"loc + scale * {ppf_sql('u')}"))
def i1_expand_normal(spark, sf):
    out = dist.expand(_params(spark, sf), PK, N_SAMPLES, lambda u: dist.normal_quantile(u, F.col("loc"), F.col("scale")))
    return rounded(out)


@query("i2_expand_jsu", _expand_sql(f"loc + scale * sinh(({ppf_sql('u')} - skewness) / tailweight)"))
def i2_expand_jsu(spark, sf):
    q = lambda u: dist.jsu_quantile(u, F.col("loc"), F.col("scale"), F.col("tailweight"), F.col("skewness"))
    return rounded(dist.expand(_params(spark, sf), PK, N_SAMPLES, q))


@query("i3_expand_skewt")
def i3_expand_skewt(spark, sf):
    """I3 (rows-only check): skew-t samples by numeric Beta-quantile inversion."""
    return rounded(dist.skewt_expand(_params(spark, sf), PK, N_SAMPLES))


_I4 = [
    ("qa", "SELECT model, zone, hour, list(q ORDER BY q) AS qs, list(value ORDER BY q) AS vs FROM quantile_fc GROUP BY model, zone, hour"),
    (
        "qg",
        f"""SELECT model, zone, hour, qs, vs, i AS sample_id, (CAST(i AS DOUBLE) - 0.5) / {N_SAMPLES} AS u,
           len(qs) AS nq FROM qa, range(1, {N_SAMPLES + 1}) t(i)""",
    ),
    ("qk", "SELECT *, len(list_filter(qs, lambda q: q <= u)) AS k FROM qg"),
]


@query(
    "i4_quantile_sampling",
    with_fixtures(
        "SELECT model, zone, hour, sample_id, "
        + r("CASE WHEN k = 0 THEN vs[1] WHEN k >= nq THEN vs[nq] WHEN qs[k + 1] = qs[k] THEN vs[k]"
            " ELSE vs[k] + (u - qs[k]) / (qs[k + 1] - qs[k]) * (vs[k + 1] - vs[k]) END", "x")
        + " FROM qk",
        "quantile_fc",
        local=_I4,
    ),
)
def i4_quantile_sampling(spark, sf):
    s = ensemble.sample_quantile_function(fx.quantile_fc(spark, sf), PK, N_SAMPLES)
    return rounded(s.select(*PK, "sample_id", "x"))


# ------------------------------------------------------------------ densities at the actuals
_SKEWT_SQL = """least(greatest(
      -(ca + cb - 1) * ln(2.0) - (lgamma(ca) + lgamma(cb) - lgamma(ca + cb)) - 0.5 * ln(ca + cb)
      + (ca + 0.5) * ln(greatest(1 + z / sqrt(ca + cb + z * z + 1e-8), 1e-8))
      + (cb + 0.5) * ln(greatest(1 - z / sqrt(ca + cb + z * z + 1e-8), 1e-8)) - ln(csc), -100.0), 100.0)"""
_JSU_SQL = """greatest(ln(greatest(tailweight, 1e-6)) - ln(greatest(scale, 1e-6))
      - 0.5 * ln(1 + zj * zj) - 0.5 * pow(skewness + greatest(tailweight, 1e-6) * (sign(zj) * ln(abs(zj) + sqrt(zj * zj + 1))), 2)
      - 0.5 * ln(2 * pi()), -100.0)"""
_NORM_SQL = "CASE WHEN scale > 0 THEN -0.5 * ln(2 * pi()) - ln(scale) - 0.5 * pow((y - loc) / scale, 2) END"
_DENS = [
    (
        "pj",
        """SELECT p.*, a.date, a.y,
           least(greatest(p.a, 2.0), 30.0) AS ca, least(greatest(p.b, 2.0), 30.0) AS cb,
           least(greatest(p.scale, 1e-3), 1e2) AS csc,
           (a.y - p.loc) / greatest(p.scale, 1e-6) AS zj
    FROM param_fc p JOIN actuals a ON a.zone = p.zone AND a.hour = p.hour""",
    ),
    ("pz", "SELECT *, least(greatest((y - loc) / csc, -50.0), 50.0) AS z FROM pj"),
    ("dens", f"SELECT *, {_NORM_SQL} AS lp_normal, {_JSU_SQL} AS lp_jsu, {_SKEWT_SQL} AS lp_skewt FROM pz"),
]


def _densities(spark, sf):
    j = _params(spark, sf).join(fx.actuals(spark, sf), on=["zone", "hour"])
    y, loc, sc = F.col("y"), F.col("loc"), F.col("scale")
    return j.withColumns(
        {
            "lp_normal": dist.normal_logpdf(y, loc, sc),
            "lp_jsu": dist.jsu_logpdf(y, loc, sc, F.col("tailweight"), F.col("skewness")),
            "lp_skewt": dist.skewt_logpdf(y, loc, sc, F.col("a"), F.col("b")),
        }
    )


def _dens_query(name, col):
    sql = with_fixtures(f"SELECT model, zone, date, hour, {r(col, col)} FROM dens", "param_fc", "actuals", local=_DENS)

    def build(spark, sf):
        return rounded(_densities(spark, sf).select("model", "zone", "date", "hour", col))

    build.__doc__ = f"{name}: log-density of the observed value under the fitted law."
    query(name, sql)(build)


_dens_query("i5_normal_logpdf", "lp_normal")
_dens_query("i6_jsu_logpdf", "lp_jsu")
_dens_query("i7_skewt_logpdf", "lp_skewt")


@query(
    "e19_mean_nll",
    with_fixtures(
        "SELECT model, zone, "
        + ", ".join(r(f"avg(-{c})", f"nll_{c[3:]}") for c in ("lp_normal", "lp_jsu", "lp_skewt"))
        + " FROM dens GROUP BY model, zone",
        "param_fc",
        "actuals",
        local=_DENS,
    ),
)
def e19_mean_nll(spark, sf):
    d = _densities(spark, sf)
    return rounded(
        d.groupBy("model", "zone").agg(
            *[F.avg(-F.col(c)).alias(f"nll_{c[3:]}") for c in ("lp_normal", "lp_jsu", "lp_skewt")]
        )
    )


# zero-inflated: p0 = share of samples below 1.0 per key (a data-derived point-mass weight)
def _zi_params(spark, sf):
    p0 = fx.samples(spark, sf).groupBy(*PK).agg(F.avg((F.col("x") < 1.0).cast("double")).alias("zero_prob"))
    return _params(spark, sf).join(p0, on=PK)


_ZI = [
    ("z0", "SELECT model, zone, hour, avg(CASE WHEN x < 1.0 THEN 1.0 ELSE 0.0 END) AS zero_prob FROM samples GROUP BY model, zone, hour"),
    ("zp", "SELECT p.*, z0.zero_prob FROM param_fc p JOIN z0 USING (model, zone, hour)"),
]


@query(
    "i8_zero_inflated_logpdf",
    with_fixtures(
        "SELECT model, zone, date, hour, "
        + r(f"CASE WHEN abs(y) < 1e-3 THEN ln(zero_prob + 1e-8) ELSE ln(1 - zero_prob + 1e-8) + {_NORM_SQL} END", "lp")
        + " FROM (SELECT zp.*, a.date, a.y FROM zp JOIN actuals a ON a.zone = zp.zone AND a.hour = zp.hour)",
        "param_fc",
        "samples",
        "actuals",
        local=_ZI,
    ),
)
def i8_zero_inflated_logpdf(spark, sf):
    j = _zi_params(spark, sf).join(fx.actuals(spark, sf), on=["zone", "hour"])
    lp = dist.zero_inflated_logpdf(F.col("y"), F.col("zero_prob"), dist.normal_logpdf(F.col("y"), F.col("loc"), F.col("scale")))
    return rounded(j.select("model", "zone", "date", "hour", lp.alias("lp")))


@query(
    "i9_zero_inflated_expand",
    with_fixtures(
        "SELECT model, zone, hour, sample_id, "
        + r(f"CASE WHEN u <= zero_prob THEN 0.0 ELSE loc + scale * {ppf_sql('((u - zero_prob) / (1 - zero_prob))')} END", "x")
        + f" FROM (SELECT zp.*, i AS sample_id, (CAST(i AS DOUBLE) - 0.5) / {N_SAMPLES} AS u FROM zp, range(1, {N_SAMPLES + 1}) t(i))",
        "param_fc",
        "samples",
        local=_ZI,
    ),
)
def i9_zero_inflated_expand(spark, sf):
    q = lambda u: dist.zero_inflated_quantile(u, F.col("zero_prob"), lambda v: dist.normal_quantile(v, F.col("loc"), F.col("scale")))
    return rounded(dist.expand(_zi_params(spark, sf), PK, N_SAMPLES, q))


_RAW = {"loc": "loc", "scale": "scale - 30", "tailweight": "tailweight - 2", "skewness": "skewness * 5", "a": "a - 5", "b": "b - 5", "zero": "skewness"}


def _sp_sql(x):
    return f"(CASE WHEN ({x}) > 30 THEN ({x}) ELSE ln(1 + exp({x})) END)"


def _cl(x, lim):
    return f"least(greatest({x}, {-lim!r}), {lim!r})"


def _i10_sql():
    items = []
    for fam in ("normal", "jsu", "skewt", "zi_jsu"):
        lim = dist.INPUT_CLAMP[fam]
        for p, (off, lo, hi) in dist.PARAM_LAYERS[fam].items():
            items.append(r(f"least(greatest({off!r} + {_sp_sql(_cl(_RAW[p], lim))}, {lo!r}), {hi!r})", f"{fam}_{p}"))
    items.append(r("1 / (1 + exp(-(skewness)))", "zi_jsu_zero_prob"))
    items.append(r("scale * (1 - 0.5 * exp(-5.0 * abs(loc)))", "ls_scale"))
    return with_fixtures("SELECT model, zone, hour, " + ", ".join(items) + " FROM param_fc", "param_fc")


def _raw_cols():
    return {k: F.expr(v) for k, v in _RAW.items()}


@query("i10_raw_to_params", _i10_sql())
def i10_raw_to_params(spark, sf):
    p = _params(spark, sf)
    cols = []
    for fam in ("normal", "jsu", "skewt", "zi_jsu"):
        out = dist.raw_to_params(fam, _raw_cols())
        cols += [out[k].alias(f"{fam}_{k}") for k in dist.PARAM_LAYERS[fam]]
    cols.append(dist.raw_to_params("zi_jsu", _raw_cols())["zero_prob"].alias("zi_jsu_zero_prob"))
    cols.append(dist.ls_shrink(F.col("scale"), F.col("loc")).alias("ls_scale"))
    return rounded(p.select(*PK, *cols))


@query(
    "i11_ls_shrinkage",
    with_fixtures(f"SELECT model, zone, hour, {r('scale * (1 - 0.5 * exp(-5.0 * abs(loc / scale)))', 'ls_scale')} FROM param_fc WHERE scale > 0", "param_fc"),
)
def i11_ls_shrinkage(spark, sf):
    """I11 on the location in units of the scale."""
    p = _params(spark, sf).where("scale > 0")
    return rounded(p.select(*PK, dist.ls_shrink(F.col("scale"), F.col("loc") / F.col("scale")).alias("ls_scale")))


@query(
    "i12_normal_from_summary",
    with_fixtures(
        f"SELECT model, zone, date, hour, sample_id, {r('mean + std * ' + ppf_sql('u'), 'x')}"
        f" FROM (SELECT *, i AS sample_id, (CAST(i AS DOUBLE) - 0.5) / {N_SAMPLES} AS u FROM forecast_wide, range(1, {N_SAMPLES + 1}) t(i))",
        "forecast_wide",
    ),
)
def i12_normal_from_summary(spark, sf):
    fw = fx.forecast_wide(spark, sf)
    out = dist.expand(fw, ["model", "zone", "date", "hour"], N_SAMPLES, lambda u: dist.normal_quantile(u, F.col("mean"), F.col("std")))
    return rounded(out)
