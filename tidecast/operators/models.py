"""Distributed baseline models (survey K1-K11).

All fits are *grouped*: the group key (e.g. zone, hour, quantile level, candidate,
prediction date) is an ordinary column, so one Spark job fits every group at once.

Linear models reduce to weighted normal equations.  For ``p`` features a group's
sufficient statistics are ``X'WX`` (p*p) and ``X'Wy`` (p): one partial aggregate over
the rows, independent of the group's size — a hot group costs no more memory than a
cold one.  The small per-group systems are solved in batches with NumPy inside
``mapInPandas`` over the aggregated table (one row per group), so nothing passes
through the driver.  Quantile regression is in :mod:`quantreg`, boosted trees in
:mod:`boosting`, trailing windows by running sums in :mod:`rolling`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.feature import StringIndexer, VectorAssembler

from ..session import materialize, sized_broadcast
from . import orderstats, quantreg
from .quantreg import QUANTILES

LOG_CHISQ1_MEAN = -1.2704  # E[log chi^2_1]: bias fix of the log-squared-residual model


def dot(x: Column, beta: Column) -> Column:
    """K2: ``x . beta`` for two equal-length arrays."""
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def normal_equations(
    rows: DataFrame, keys: Sequence[str], p: int, x: str = "x", y: str = "y", w: Column | None = None
) -> DataFrame:
    """Per group: ``xtx`` (row-major p*p), ``xty`` (p), ``n``, ``sw`` (sum of weights)."""
    wt = w if w is not None else F.lit(1.0)
    xc = F.col(x)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(wt).alias("sw")]
    for i in range(p):
        for j in range(i, p):
            aggs.append(F.sum(wt * xc[i] * xc[j]).alias(f"_a{i}_{j}"))
        aggs.append(F.sum(wt * xc[i] * F.col(y)).alias(f"_b{i}"))
    g = rows.groupBy(*keys).agg(*aggs)
    xtx = F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    xty = F.array(*[F.col(f"_b{i}") for i in range(p)])
    return g.select(*keys, "n", "sw", xtx.alias("xtx"), xty.alias("xty"))


def solve_groups(neq: DataFrame, keys: Sequence[str], p: int, penalty: DataFrame | None = None) -> DataFrame:
    """Batched solve of ``(xtx / sw + P) beta = xty / sw`` per group.

    ``penalty`` (optional, joined by ``keys``) holds ``pen`` — an array of p diagonal
    additions (plain ridge).  A tiny jitter keeps all-zero columns solvable.  Runs in ``mapInPandas`` on the aggregated table (one row per group)."""
    keys = list(keys)
    src = neq if penalty is None else neq.join(penalty, on=keys, how="left")
    if penalty is None:
        src = src.withColumn("pen", F.array_repeat(F.lit(0.0), p))
    src = src.select(*keys, "sw", "xtx", "xty", "pen")
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + ", beta array<double>"

    def solve(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            sw = pdf["sw"].to_numpy(dtype=float).reshape(-1, 1)
            a = np.stack(pdf["xtx"].map(np.asarray).to_list()).reshape(-1, p, p) / sw[:, :, None]
            b = np.stack(pdf["xty"].map(np.asarray).to_list()) / sw
            pen = np.stack(pdf["pen"].map(lambda v: np.zeros(p) if v is None else np.asarray(v, dtype=float)).to_list())
            a = a + np.einsum("ij,jk->ijk", pen, np.eye(p)) + 1e-9 * np.eye(p)[None]
            try:
                beta = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                beta = np.stack([np.linalg.lstsq(ai, bi, rcond=None)[0] for ai, bi in zip(a, b)])
            out = pdf[keys].copy()
            out["beta"] = list(beta)
            yield out

    return src.mapInPandas(solve, schema)


def wls(rows: DataFrame, keys: Sequence[str], p: int, x: str = "x", y: str = "y", w: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """Grouped (weighted) least squares: ``keys, beta``."""
    neq = normal_equations(rows, keys, p, x, y, w)
    pen = None
    if ridge:
        pen = neq.select(*keys, F.array(F.lit(0.0), *[F.lit(float(ridge))] * (p - 1)).alias("pen"))
    return solve_groups(neq, keys, p, pen)


def quantile_regression(
    rows: DataFrame, keys: Sequence[str], p: int, quantiles: Sequence[float] = QUANTILES, alpha: float = 0.0, x: str = "x", y: str = "y"
) -> DataFrame:
    """K1: L1-penalised linear quantile regression for every (group, q) at once, to proven
    optimality (see :mod:`quantreg`).  Returns ``keys, q, beta, n, loss, gap, converged``."""
    return quantreg.fit(rows, keys, p, quantreg.problems(p, quantiles, alpha), x, y).drop("candidate", "alpha")


def predict_quantiles(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """K2: predicted quantile per row and level (join on the group keys)."""
    j = rows.join(sized_broadcast(coefs), on=list(keys), how="inner")
    return j.withColumn("pred", dot(F.col(x), F.col("beta")))


def coefficient_loss(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """K5: mean pinball of coefficient sets (``keys, by, q, beta``) over ``rows``: a group's
    sets lie in one array, which its rows meet once; sums per set leave the rows' tasks."""
    by = list(by)
    sets = coefs.groupBy(*keys).agg(F.collect_list(F.struct(*by, "q", "beta")).alias("_sets"))  # a struct per problem
    e = F.col(y) - dot(F.col(x), F.col("_c.beta"))
    j = rows.where(F.col(y).isNotNull()).select(*keys, x, y).join(sized_broadcast(sets), on=list(keys)).withColumn("_c", F.explode("_sets"))
    loss = F.greatest(F.col("_c.q") * e, (F.col("_c.q") - 1) * e)
    return j.groupBy(*[F.col(f"_c.{b}").alias(b) for b in by]).agg(F.avg(loss).alias("val_pinball"))


def coefficient_importance(coefs: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean absolute coefficient per feature over all (hour, q) fits."""
    ex = coefs.select(*keys, F.posexplode("beta").alias("j", "coef"))
    names_arr = F.array(*[F.lit(n) for n in names])
    return ex.groupBy(F.element_at(names_arr, F.col("j") + 1).alias("feature")).agg(
        F.avg(F.abs("coef")).alias("importance")
    )


def location_scale(rows: DataFrame, keys: Sequence[str], p: int, x: str = "x", y: str = "y") -> DataFrame:
    """K4: two-step heteroscedastic regression per group: least squares for the
    location, then least squares of ``log r^2`` for the log-variance with the
    ``E[log chi^2_1]`` bias fix; returns ``keys, beta_loc, beta_scale``."""
    keys = list(keys)
    b1 = materialize(wls(rows, keys, p, x, y)).withColumnRenamed("beta", "beta_loc")
    j = rows.join(sized_broadcast(b1), on=keys)
    res = j.withColumn("_lr2", F.log(F.pow(F.col(y) - dot(F.col(x), F.col("beta_loc")), 2) + 1e-12))
    b2 = wls(res, keys, p, x, "_lr2").withColumnRenamed("beta", "beta_scale")
    return b1.join(b2, on=keys)


def predict_location_scale(rows: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """K4 prediction: ``loc = x b_loc``, ``scale = exp((x b_scale - E log chi2_1) / 2)``."""
    j = rows.join(sized_broadcast(coefs), on=list(keys))
    return j.withColumns(
        {
            "loc": dot(F.col(x), F.col("beta_loc")),
            "scale": F.exp((dot(F.col(x), F.col("beta_scale")) - LOG_CHISQ1_MEAN) / 2),
        }
    )


def tree_quantiles(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    y: str,
    keys_out: Sequence[str],
    quantiles: Sequence[float] = QUANTILES,
    max_depth: int = 5,
    seed: int = 42,
    categories: Sequence[str] = (),
) -> DataFrame:
    """K3: quantile leaves.  One MLlib regression tree on all groups at once (the
    group columns are features; ``categories`` are indexed, an unseen value is a class of
    its own), then exact quantiles of the training targets in each leaf (skew-safe order
    statistics) — a leaf is the conditional distribution.  A null feature takes the
    feature's training mean, so every test row gets its leaf's quantiles; training rows
    without target are left out.  Returns ``keys_out, q, pred``."""
    means = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    fill = {c: float(means[c] if means[c] is not None else 0.0) for c in features}
    train, test = train.where(F.col(y).isNotNull()).fillna(fill), test.fillna(fill)
    for c in categories:
        ix = StringIndexer(inputCol=c, outputCol=f"_ix_{c}", handleInvalid="keep").fit(train)
        train, test = ix.transform(train), ix.transform(test)
    va = VectorAssembler(inputCols=[*features, *[f"_ix_{c}" for c in categories]], outputCol="_fv", handleInvalid="error")
    tr = va.transform(train)
    model = DecisionTreeRegressor(featuresCol="_fv", labelCol=y, maxDepth=max_depth, seed=seed, leafCol="leaf").fit(tr)
    leaves = model.transform(tr).select("leaf", y)
    lq = orderstats.quantiles_long(leaves, ["leaf"], y, quantiles).select("leaf", "q", F.col("value").alias("pred"))
    te = model.transform(va.transform(test)).select(*keys_out, "leaf")
    return te.join(sized_broadcast(lq), on="leaf").select(*keys_out, "q", "pred")


def sign_by_state(x: Column, state: Column) -> Column:
    """K9: up-regulation hours take ``|x|``, down-regulation ``-|x|``."""
    return F.when(state == "up_regulation", F.abs(x)).when(state == "down_regulation", -F.abs(x)).otherwise(x)

