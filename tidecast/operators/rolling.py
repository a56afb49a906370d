"""Linear models on trailing windows of days by sliding sums (survey K7 with B3, B4, D7, F6).

The least-squares fit of a window needs only ``n``, ``X'X``, ``X'y`` and ``y'y`` of its rows.
Rows are summed once per (keys, day) with partial aggregates; the sums of the window
``[day - days, day)`` are one range frame over the daily sums.  A frame of sums, not a
difference of two running totals, keeps each window's rounding error at that of its own rows.
So the windows of all days cost one pass over the rows and one sort of the daily table
(days times keys), where joining every row to the windows that hold it would copy it
``days`` times; a key with most rows has no more days than any other.

The result equals fitting every window by itself.  Every day of the input is a target; days
without ``least_rows`` earlier rows in their window have no fit.  Rows with a null key, day,
target or feature are left out.  Sums are taken of features centred on the key's mean,
which keeps trends (large means, small spread) well conditioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import norm_ppf
from ..session import materialize, sized_broadcast
from .quantreg import QUANTILES

_DAY = "_day"


def _sums(p: int) -> dict[str, Column]:
    x, y = F.col("_x"), F.col("_y")
    out = {"n": F.count(F.lit(1)).cast("double"), "yy": F.sum(y * y)}
    for i in range(p):
        out[f"b{i}"] = F.sum(x[i] * y)
        out |= {f"a{i}_{j}": F.sum(x[i] * x[j]) for j in range(i, p)}
    return out


def daily_sums(rows: DataFrame, keys: Sequence[str], day: str, p: int, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(keys, day, sums) of the rows with features and target taken from their key's means
    (column 0, the intercept, stays 1), and (keys, centre) with these means."""
    keys = list(keys)
    full = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())).dropna(subset=[*keys, day])
    base = full.select(*keys, F.col(day).alias(_DAY), F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    mean = [F.lit(0.0) if i == 0 else F.avg(F.col("_x")[i]) for i in range(p)]
    centre = materialize(base.groupBy(*keys).agg(F.array(*mean, F.avg("_y")).alias("centre")))
    moved = base.join(sized_broadcast(centre, materialized=True), on=keys)
    moved = moved.select(*keys, _DAY, F.zip_with("_x", F.slice("centre", 1, p), lambda a, m: a - m).alias("_x"), (F.col("_y") - F.col("centre")[p]).alias("_y"))
    return moved.groupBy(*keys, _DAY).agg(*[c.alias(f"_{k}") for k, c in _sums(p).items()]), centre


def trailing_fits(rows: DataFrame, keys: Sequence[str], day: str, p: int, days: int, least_rows: int, x: str = "x", y: str = "y") -> DataFrame:
    """``keys, day, n, beta, scale, inverse``: per day the fit on the ``days`` days before it.
    ``scale`` is the residual deviation with n - p degrees of freedom, ``inverse`` the row-major
    inverse of X'X (for the variance of a prediction), both for centred features."""
    keys = list(keys)
    per_day, centre = daily_sums(rows, keys, day, p, x, y)
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(_DAY)).rangeBetween(-days, -1)  # a row per day
    names = list(_sums(p))
    sums = per_day.select(*keys, F.col(_DAY).alias(day), *[F.sum(f"_{k}").over(frame).alias(f"_{k}") for k in names])
    ready = sums.where(F.col("_n") >= max(least_rows, p + 1)).select(*keys, day, F.array(*[F.col(f"_{k}") for k in names]).alias("sums"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    at = {k: i for i, k in enumerate(names)}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["sums"]:
                a = np.array([[s[at[f"a{min(i, j)}_{max(i, j)}"]] for j in range(p)] for i in range(p)])
                b = np.array([s[at[f"b{i}"]] for i in range(p)])
                d = np.sqrt(np.maximum(np.diag(a), 1e-300))
                inverse = np.linalg.pinv(a / d[:, None] / d, rcond=1e-12, hermitian=True) / d[:, None] / d
                beta = inverse @ b
                left = max(0.0, s[at["yy"]] - float(beta @ b))
                out.append((int(s[at["n"]]), beta.tolist(), float(np.sqrt(left / (s[at["n"]] - p))), inverse.ravel().tolist()))
            got = pd.DataFrame(out, columns=["n", "beta", "scale", "inverse"])
            for k in reversed([*keys, day]):
                got.insert(0, k, pdf[k].to_numpy())
            yield got

    fits = ready.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, day]) + ", n long, beta array<double>, scale double, inverse array<double>")
    return materialize(fits.join(sized_broadcast(centre, materialized=True), on=keys))


def predict(rows: DataFrame, fits: DataFrame, keys: Sequence[str], day: str, x: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """``keys, day, keep, n, loc, scale``: the rows of days with a fit."""
    keys = list(keys)
    j = rows.select(*keys, day, *keep, F.col(x).alias("_x")).join(fits, on=[*keys, day])
    p = F.size("beta")
    away = F.zip_with("_x", F.slice("centre", F.lit(1), p), lambda a, m: a - m)
    loc = F.aggregate(F.zip_with(away, "beta", lambda a, b: a * b), F.element_at("centre", -1), lambda s, v: s + v)
    return j.select(*keys, day, *keep, "n", loc.alias("loc"), "scale")


def predict_quantiles(rows: DataFrame, fits: DataFrame, keys: Sequence[str], day: str, quantiles: Sequence[float] = QUANTILES, keep: Sequence[str] = ()) -> DataFrame:
    """``keys, day, keep, q, pred``: Normal quantiles around the location."""
    levels = F.array(*[F.struct(F.lit(float(q)).alias("q"), norm_ppf(F.lit(float(q))).alias("z")) for q in quantiles])
    out = predict(rows, fits, keys, day, keep=keep).withColumn("_l", F.explode(levels))
    return out.select(*keys, day, *keep, F.col("_l.q").alias("q"), (F.col("loc") + F.col("_l.z") * F.col("scale")).alias("pred"))
