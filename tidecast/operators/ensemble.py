"""Forecast ensembles (survey J1-J6) and quantile-function sampling (I4).

* Horizontal (quantile averaging): each member's quantile function on a level grid,
  averaged level by level across members (optionally weighted), then read back by
  linear interpolation.
* Vertical (mixture): the members' samples pooled with weights that give every member
  the same share; the pool is the limit of drawing equally often from each member, so no
  draw is made.

Sampling from a quantile function uses the deterministic midpoint grid
``u_i = (i - 1/2) / n`` instead of uniform random draws, so results do not depend on
partitioning or seeds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast
from . import orderstats

QUANTILE_MODEL_LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)  # fixed: quantile-model levels


def horizontal_levels(n: int = 100) -> list[float]:
    """The level grid ``linspace(0, 1, n)`` (fixed: 100 levels)."""
    return [float(v) for v in np.linspace(0.0, 1.0, n)]


def member_quantiles(samples: DataFrame, keys: Sequence[str], member: str, value: str, levels: Sequence[float]) -> DataFrame:
    """Each member's exact quantiles at ``levels``: ``keys, member, level_idx, q, value``."""
    return orderstats.quantiles_long(samples, [*keys, member], value, levels)


def horizontal(
    samples: DataFrame,
    keys: Sequence[str],
    member: str = "model",
    value: str = "x",
    n_levels: int = 100,
    min_members: int = 2,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Averaged quantile function per key: ``keys, level_idx, q, value,
    members``.  Keys with fewer than ``min_members`` members are skipped (J3).
    ``weights`` (``member, weight``) turns the mean into ``sum(w v) / sum(w)``."""
    keys = list(keys)
    mq = member_quantiles(samples, keys, member, value, horizontal_levels(n_levels))
    if weights is not None:
        mq = mq.join(sized_broadcast(weights), on=member, how="inner")
        avg = F.sum(F.col("weight") * F.col("value")) / F.sum("weight")
    else:
        avg = F.avg("value")
    out = mq.groupBy(*keys, "level_idx").agg(
        F.first("q").alias("q"), avg.alias("value"), F.countDistinct(member).alias("members")
    )
    return out.where(F.col("members") >= min_members)


def quantile_arrays(qf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A quantile function as two sorted arrays per key (levels are few, so bounded)."""
    return qf.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_qv")).select(
        *keys,
        F.transform("_qv", lambda s: s["q"]).alias("qs"),
        F.transform("_qv", lambda s: s["value"]).alias("vs"),
    )


def interp_quantile(u: Column, qs: Column, vs: Column) -> Column:
    """I4: linear interpolation of ``(qs, vs)`` at ``u``; flat outside
    ``[qs[0], qs[-1]]`` (NumPy ``interp`` semantics)."""
    k = F.size(F.filter(qs, lambda q: q <= u))  # levels <= u
    n = F.size(qs)
    q0, q1 = F.element_at(qs, F.greatest(k, F.lit(1))), F.element_at(qs, F.least(k + 1, n))
    v0, v1 = F.element_at(vs, F.greatest(k, F.lit(1))), F.element_at(vs, F.least(k + 1, n))
    inner = v0 + (u - q0) / (q1 - q0) * (v1 - v0)
    return (
        F.when(k == 0, F.element_at(vs, 1))
        .when(k >= n, F.element_at(vs, -1))
        .when(q1 == q0, v0)
        .otherwise(inner)
    )


def sample_quantile_function(qf: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """I4: ``n`` samples per key at ``u_i = (i - 1/2) / n``: ``keys, sample_id, u, x``."""
    arr = quantile_arrays(qf, keys)
    grid = arr.select(*keys, "qs", "vs", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample_id"))
    u = (F.col("sample_id") - 0.5) / n
    return grid.select(*keys, F.col("sample_id").cast("long").alias("sample_id"), u.alias("u"),
                       interp_quantile(u, F.col("qs"), F.col("vs")).alias("x"))


def vertical(samples: DataFrame, keys: Sequence[str], member: str = "model", min_members: int = 2) -> DataFrame:
    """The pooled samples of all members with the weight ``w`` = 1 / (members x
    samples of the member), so every member counts the same however many samples it has;
    keys with fewer than ``min_members`` members are skipped."""
    per = samples.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_n"))
    members = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= min_members)
    # one row per (key, member): broadcast after the size check, so the samples are not
    # shuffled by key (a hot key would otherwise land in one task)
    weights = per.join(members, on=list(keys)).select(*keys, member, (1.0 / (F.col("_m") * F.col("_n"))).alias("w"))
    return samples.join(sized_broadcast(weights), on=[*keys, member])


def _moments(pool: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    """Weighted mean and central moments 2 to 4 (two passes, as raw moments cancel)."""
    x, w = F.col(value), F.col("w")
    rows = pool.where(x.isNotNull())
    mean = rows.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("_mx"))
    d = x - F.col("_mx")
    return rows.join(sized_broadcast(mean), on=list(keys)).groupBy(*keys).agg(
        F.first("_mx").alias("mean"),
        *[(F.sum(w * F.pow(d, k)) / F.sum(w)).alias(f"_m{k}") for k in (2, 3, 4)],
        *more,
    )


def mixture_quantiles(pool: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Percentiles of the mixture: the smallest value whose cumulative weight reaches the
    level (a step function; no interpolation).  Ordered in value buckets, so one key may hold
    all rows."""
    rows = orderstats.ranked(pool, keys, value, weight="w")
    reached = F.col(orderstats.BEFORE) + F.col(orderstats.C)
    at = [F.min(F.when(reached >= F.col(orderstats.N) * q - 1e-9, F.col(value))).alias(nm) for q, nm in zip(levels, names)]
    return rows.groupBy(*keys).agg(*at)


def mixture_stats(pool: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """J2 on :func:`vertical`: mean, std, median and percentiles, exceedance probabilities
    and state of the equal-weight mixture."""
    from .scores import market_state

    x, w = F.col(value), F.col("w")
    p = lambda c: F.sum(F.when(c, w).otherwise(0.0)) / F.sum(w)
    m = _moments(pool, keys, value, p(x > threshold).alias("up_prob"), p(x < -threshold).alias("down_prob"))
    q = mixture_quantiles(pool, keys, value, [0.5, *levels], ["median", *names])
    return m.join(q, on=list(keys)).withColumns({
        "std": F.sqrt("_m2"),
        "normal_prob": 1.0 - F.col("up_prob") - F.col("down_prob"),
        "state": market_state(F.col("up_prob"), F.col("down_prob")),
    })


# Fixed: the clips of the moment fit.
TAIL_CLIP, SKEW_CLIP, DEGREES, DEGREE_CLIP = 10.0, 10.0, 3.0, 5.0


def fit_parameters(samples: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """Moment fit of every family to samples (weighted by ``w`` if there is one).

    Normal ``loc = mean, scale = population std``; JSU adds
    ``tailweight = 1 + clip(kurtosis / 2, 0, 10)``, ``skewness = clip(skew, -10, 10)``;
    skew-t ``a = 3 + clip(skew, 0, 5)``, ``b = 3 + clip(-skew, 0, 5)``.  Skewness and
    (excess) kurtosis are population moments; when the spread is numerically zero
    they are undefined and taken as 0 (symmetric, tail 1, a = b = 3).  All moments are
    mergeable partial aggregates."""
    rows = samples if "w" in samples.columns else samples.withColumn("w", F.lit(1.0))
    m = _moments(rows, keys, value).select(*keys, F.col("mean").alias("loc"), F.sqrt("_m2").alias("scale"), "_m2", "_m3", "_m4")
    spread_ok = F.col("scale") > 1e-9 * (1 + F.abs(F.col("loc")))
    sk = F.when(spread_ok, F.col("_m3") / F.pow("_m2", F.lit(1.5)))
    ku = F.when(spread_ok, F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3)
    clip = lambda c, lo, hi: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(lo)), F.lit(hi))
    return m.select(
        *keys,
        "loc",
        "scale",
        (1 + clip(ku / 2, 0.0, TAIL_CLIP)).alias("tailweight"),
        clip(sk, -SKEW_CLIP, SKEW_CLIP).alias("skewness"),
        (DEGREES + clip(sk, 0.0, DEGREE_CLIP)).alias("a"),
        (DEGREES + clip(-sk, 0.0, DEGREE_CLIP)).alias("b"),
    )


def fit_quantile_model(samples: DataFrame, keys: Sequence[str], value: str = "x", levels: Sequence[float] = QUANTILE_MODEL_LEVELS) -> DataFrame:
    """J4 (quantile family): the seven model levels of the samples, long form."""
    return orderstats.quantiles_long(samples, keys, value, levels)


def weights_table(spark, weights: Mapping[str, float], member: str = "model") -> DataFrame:
    """A member weight table from a mapping."""
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{member} string, weight double")
