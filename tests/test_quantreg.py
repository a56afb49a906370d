"""Quantile regression: optimality by the dual, both plans, penalties, masks, awkward rows."""

import numpy as np
import pytest

from tidecast.operators import models, quantreg


def _data(n, seed=0, p=4):
    rng = np.random.default_rng(seed)
    x = np.c_[np.ones(n), rng.normal(size=(n, p - 1)) * [1, 5, 20][: p - 1]]
    y = x @ np.array([1, 2, 0, 0.3])[:p] + rng.standard_t(3, size=n) * (1 + 0.3 * np.abs(x[:, 1])) * 10
    return x, y


def _frame(spark, groups):
    rows = [(g, float(v), [float(u) for u in r]) for g, (x, y) in groups.items() for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "g string, y double, x array<double>").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 7, 60, 900])
@pytest.mark.parametrize("target", ["noise", "ties", "constant", "zero"])
def test_program_closes_the_gap_and_its_bound_is_a_bound(n, target):
    x, y = _data(n)
    y = {"noise": y, "ties": np.round(y, -1), "constant": np.full(n, 3.0), "zero": np.zeros(n)}[target]
    for q in (0.05, 0.5, 0.95):
        for alpha in (0.0, 0.05, 2.0):
            problem = quantreg.Problem(0, q, alpha, (True,) * 4)
            beta, bound = quantreg.program(x, y, problem, n)
            loss = quantreg.pinball(y - x @ beta, q) + quantreg.penalty(beta, problem, n)
            assert loss - bound <= 1e-6 * max(loss, 1e-6 * np.abs(y).sum(), 1e-12)
            rng = np.random.default_rng(1)
            for _ in range(50):  # no other coefficients are below the bound
                other = beta + rng.normal(size=4) * 10.0 ** rng.integers(-6, 1)
                assert quantreg.pinball(y - x @ other, q) + quantreg.penalty(other, problem, n) >= bound - 1e-9 * (1 + abs(bound))


def test_small_and_large_plans_reach_the_same_loss(spark):
    groups = {"hot": _data(6000, 1), "b": _data(700, 2), "c": _data(40, 3)}
    x, y = groups["b"]
    groups["mass"] = (x, np.where(np.arange(len(y)) % 5 < 3, 0.0, y))  # 60 % at one value
    df = _frame(spark, groups)
    todo = [*quantreg.problems(4), quantreg.Problem(1, 0.5, 0.3, (True, True, False, True)), quantreg.Problem(2, 0.9, 0.05, (True, False, False, False))]
    whole = {(r.g, r.candidate, r.q): r for r in quantreg.fit(df, ["g"], 4, todo, most=10_000).collect()}
    parts = {(r.g, r.candidate, r.q): r for r in quantreg.fit(df, ["g"], 4, todo, most=300).collect()}
    assert set(whole) == set(parts) and len(whole) == 4 * len(todo)
    for k, r in whole.items():
        assert r.converged and parts[k].converged, k
        assert r.n == len(groups[r.g][1]) and 0 <= r.gap <= 1e-6
        assert parts[k].loss == pytest.approx(r.loss, rel=2e-6)
        gx, gy = groups[r.g]
        problem = next(t for t in todo if (t.candidate, t.q) == k[1:])
        for row in (r, parts[k]):
            b = np.array(row.beta)
            assert row.loss == pytest.approx(quantreg.pinball(gy - gx @ b, r.q) + quantreg.penalty(b, problem, r.n), rel=1e-9, abs=1e-9)
            assert all(b[j] == 0 for j in range(4) if not problem.mask[j])


def test_intercept_only_is_the_exact_quantile(spark):
    x, y = _data(501)
    df = _frame(spark, {"g": (x[:, :1], y)})
    for r in models.quantile_regression(df, ["g"], 1, quantiles=(0.1, 0.5, 0.9)).collect():
        assert r.loss == pytest.approx(quantreg.pinball(y - np.quantile(y, r.q, method="inverted_cdf"), r.q), rel=1e-7)


def test_awkward_rows(spark):
    rows = [("a", None, [1.0, 2.0]), ("a", 1.0, None), ("a", 1.0, [1.0, None]), ("a", float("nan"), [1.0, 1.0]), ("a", 2.0, [1.0, 5.0]), ("a", 2.0, [1.0, 5.0]), (None, 4.0, [1.0, 0.0]), ("b", None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, y double, x array<double>")
    got = {r.g: r for r in models.quantile_regression(df, ["g"], 2, quantiles=(0.5,)).collect()}
    assert got["a"].n == 2 and got["a"].converged and np.dot(got["a"].beta, [1, 5]) == pytest.approx(2.0)
    assert set(got) == {"a"}
    assert models.quantile_regression(df.limit(0), ["g"], 2, quantiles=(0.5,)).count() == 0


def test_losses_of_candidates_equal_a_loop(spark):
    x, y = _data(300)
    df = _frame(spark, {"g": (x, y), "h": _data(200, 5)})
    todo = [quantreg.Problem(c, q, a, m) for c, (a, m) in enumerate([(0.0, (True,) * 4), (0.2, (True, True, False, False))]) for q in (0.25, 0.75)]
    coefs = quantreg.fit(df, ["g"], 4, todo)
    got = {r.candidate: r.val_pinball for r in models.coefficient_loss(df, coefs, ["g"], ["candidate"]).collect()}
    data = {"g": (x, y), "h": _data(200, 5)}
    for c in (0, 1):
        sets = [r for r in coefs.collect() if r.candidate == c]
        total = sum(quantreg.pinball(data[r.g][1] - data[r.g][0] @ np.array(r.beta), r.q) for r in sets)
        assert got[c] == pytest.approx(total / (2 * 500))
