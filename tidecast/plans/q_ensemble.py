"""Ensembles across forecasters: J1-J6 (members = the ``model`` column)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, scores
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

EK = ["zone", "hour"]
LEVELS = ensemble.horizontal_levels(100)
LV_SQL = "[" + ", ".join(repr(v) for v in LEVELS) + "]::DOUBLE[]"
J5_LEVELS = (0.1, 0.25, 0.75, 0.9)  # fixed: ensemble statistics percentiles
J5_NAMES = ("p10", "p25", "p75", "p90")
N_OUT = 200
WEIGHTS = {"hist": 0.5, "early": 0.25, "late": 0.25}

_MQ = [
    (
        "mq",
        f"""SELECT model, zone, hour, unnest(range(0, 100)) AS level_idx, unnest({LV_SQL}) AS q,
           unnest(quantile_cont(x, {LV_SQL})) AS value
    FROM samples GROUP BY model, zone, hour""",
    ),
    (
        "hz",
        """SELECT zone, hour, level_idx, any_value(q) AS q, avg(value) AS value, count(DISTINCT model) AS members
    FROM mq GROUP BY zone, hour, level_idx HAVING count(DISTINCT model) >= 2""",
    ),
]


def _h(spark, sf, weights=None):
    w = ensemble.weights_table(spark, weights) if weights else None
    return ensemble.horizontal(fx.samples(spark, sf), EK, "model", "x", 100, 2, w)


@query(
    "j1_horizontal_ensemble",
    with_fixtures(
        f"SELECT zone, hour, CAST(level_idx AS INTEGER) AS level_idx, {r('q', 'q')}, {r('value', 'value')}, members FROM hz",
        "samples",
        local=_MQ,
    ),
)
def j1_horizontal_ensemble(spark, sf):
    return rounded(_h(spark, sf).select(*EK, "level_idx", "q", "value", "members"))


_W = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in WEIGHTS.items()) + ") t(model, weight)"


@query(
    "j6_weighted_ensemble",
    with_fixtures(
        f"SELECT zone, hour, CAST(level_idx AS INTEGER) AS level_idx, {r('any_value(q)', 'q')},"
        f" {r('sum(weight * value) / sum(weight)', 'value')}, count(DISTINCT model) AS members"
        " FROM mq JOIN w USING (model) GROUP BY zone, hour, level_idx HAVING count(DISTINCT model) >= 2",
        "samples",
        local=_MQ[:1] + [("w", _W)],
    ),
)
def j6_weighted_ensemble(spark, sf):
    return rounded(_h(spark, sf, WEIGHTS).select(*EK, "level_idx", "q", "value", "members"))


# J2-J4 pool the two members that share no samples (the third is their union).
MEMBERS = ("early", "late")
_MS = ("ms", "SELECT * FROM samples WHERE model IN ('early', 'late')")
_POOL = [
    _MS,
    ("mn", "SELECT zone, hour, model, count(*) AS n FROM ms GROUP BY zone, hour, model"),
    ("mk", "SELECT zone, hour, count(*) AS members FROM mn GROUP BY zone, hour HAVING count(*) >= 2"),
    ("pool", "SELECT ms.*, 1.0 / (mk.members * mn.n) AS w FROM ms JOIN mn USING (zone, hour, model) JOIN mk USING (zone, hour)"),
    ("pc", """SELECT zone, hour, x, sum(sum(w)) OVER (PARTITION BY zone, hour ORDER BY x) AS c,
           sum(sum(w)) OVER (PARTITION BY zone, hour) AS t FROM pool GROUP BY zone, hour, x"""),
    ("pq", "SELECT zone, hour, " + ", ".join(f"min(CASE WHEN c >= t * {q!r} - 1e-9 THEN x END) AS {nm}" for q, nm in zip((0.5, *J5_LEVELS), ("median", *J5_NAMES))) + " FROM pc GROUP BY zone, hour"),
    ("pm", """SELECT zone, hour, any_value(mx) AS loc, sum(w * pow(x - mx, 2)) / sum(w) AS m2, sum(w * pow(x - mx, 3)) / sum(w) AS m3,
           sum(w * pow(x - mx, 4)) / sum(w) AS m4, sum(CASE WHEN x > 0.5 THEN w ELSE 0.0 END) / sum(w) AS up_prob,
           sum(CASE WHEN x < -0.5 THEN w ELSE 0.0 END) / sum(w) AS down_prob
    FROM (SELECT *, sum(w * x) OVER (PARTITION BY zone, hour) / sum(w) OVER (PARTITION BY zone, hour) AS mx FROM pool) GROUP BY zone, hour"""),
]


def _members(spark, sf):
    return fx.samples(spark, sf).where(F.col("model").isin(*MEMBERS))


def _pool(spark, sf):
    return ensemble.vertical(_members(spark, sf), EK, "model")


@query(
    "j3_member_check",
    with_fixtures(
        "SELECT zone, hour, count(DISTINCT model) AS members, count(DISTINCT model) >= 2 AS kept FROM ms GROUP BY zone, hour",
        "samples",
        local=[_MS],
    ),
)
def j3_member_check(spark, sf):
    m = _members(spark, sf).groupBy(*EK).agg(F.countDistinct("model").alias("members"))
    return m.withColumn("kept", F.col("members") >= 2)


def _stats_sql(src: str) -> str:
    return (
        "SELECT zone, hour, "
        + ", ".join(
            [
                r("avg(x)", "mean"),
                r("quantile_cont(x, 0.5)", "median"),
                r("stddev_pop(x)", "std"),
                *[r(f"quantile_cont(x, {q!r})", nm) for q, nm in zip(J5_LEVELS, J5_NAMES)],
                r("avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END)", "up_prob"),
                r("avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END)", "down_prob"),
                r("1.0 - avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END)", "normal_prob"),
            ]
        )
        + ", CASE WHEN avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) > avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END) THEN 'up_regulation'"
        " WHEN avg(CASE WHEN x < -0.5 THEN 1.0 ELSE 0.0 END) > avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) THEN 'down_regulation'"
        f" ELSE 'normal' END AS state FROM {src} GROUP BY zone, hour"
    )


_J5_COLS = ("mean", "median", "std", *J5_NAMES, "up_prob", "down_prob", "normal_prob", "state")


def _ens_stats(samples):
    return scores.forecast_stats(samples, EK, "x", J5_LEVELS, J5_NAMES).select(*EK, *_J5_COLS)


@query(
    "j2_vertical_stats",
    with_fixtures(
        "SELECT zone, hour, "
        + ", ".join([r("loc", "mean"), r("median", "median"), r("sqrt(m2)", "std"), *[r(nm, nm) for nm in J5_NAMES], r("up_prob", "up_prob"), r("down_prob", "down_prob"), r("1.0 - up_prob - down_prob", "normal_prob")])
        + ", CASE WHEN up_prob > down_prob THEN 'up_regulation' WHEN down_prob > up_prob THEN 'down_regulation' ELSE 'normal' END AS state FROM pm JOIN pq USING (zone, hour)",
        "samples",
        local=_POOL,
    ),
)
def j2_vertical_stats(spark, sf):
    return rounded(ensemble.mixture_stats(_pool(spark, sf), EK, "x", J5_LEVELS, J5_NAMES).select(*EK, *_J5_COLS))


_FIT = """SELECT zone, hour, loc, sqrt(m2) AS scale,
       1 + least(greatest(coalesce(ku, 0.0) / 2, 0.0), 10.0) AS tailweight,
       least(greatest(coalesce(sk, 0.0), -10.0), 10.0) AS skewness,
       3 + CASE WHEN sk > 0 THEN least(sk, 5.0) ELSE 0.0 END AS a,
       3 + CASE WHEN sk < 0 THEN least(-sk, 5.0) ELSE 0.0 END AS b
FROM (SELECT *, CASE WHEN sqrt(m2) > 1e-9 * (1 + abs(loc)) THEN m3 / pow(m2, 1.5) END AS sk,
             CASE WHEN sqrt(m2) > 1e-9 * (1 + abs(loc)) THEN m4 / (m2 * m2) - 3 END AS ku FROM pm)"""


@query(
    "j4_fit_parameters",
    with_fixtures(
        "SELECT zone, hour, " + ", ".join(r(c, c) for c in ("loc", "scale", "tailweight", "skewness", "a", "b")) + " FROM fit",
        "samples",
        local=_POOL + [("fit", _FIT)],
    ),
)
def j4_fit_parameters(spark, sf):
    return rounded(ensemble.fit_parameters(_pool(spark, sf), EK))


_HS = [
    ("ha", "SELECT zone, hour, list(q ORDER BY q) AS qs, list(value ORDER BY q) AS vs FROM hz GROUP BY zone, hour"),
    (
        "hg",
        f"""SELECT zone, hour, qs, vs, (CAST(i AS DOUBLE) - 0.5) / {N_OUT} AS u, len(qs) AS nq
    FROM ha, range(1, {N_OUT + 1}) t(i)""",
    ),
    ("hk", "SELECT *, len(list_filter(qs, lambda q: q <= u)) AS k FROM hg"),
    (
        "hsamp",
        """SELECT zone, hour, CASE WHEN k = 0 THEN vs[1] WHEN k >= nq THEN vs[nq] WHEN qs[k + 1] = qs[k] THEN vs[k]
           ELSE vs[k] + (u - qs[k]) / (qs[k + 1] - qs[k]) * (vs[k + 1] - vs[k]) END AS x FROM hk""",
    ),
]


@query("j5_horizontal_stats", with_fixtures(_stats_sql("hsamp"), "samples", local=_MQ + _HS))
def j5_horizontal_stats(spark, sf):
    qf = _h(spark, sf).select(*EK, "q", "value")
    return rounded(_ens_stats(ensemble.sample_quantile_function(qf, EK, N_OUT)))
