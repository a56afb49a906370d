"""Linear quantile regression with a proof of optimality (survey K1, K2, K5-K7).

A *problem* is a level, an L1 penalty and a set of features; all problems of all groups are
fitted together, and the number of Spark jobs does not grow with their number.

The fit of one problem is a linear program with bounded multipliers: minimise
``sum(pinball_q(y - x b)) + n * alpha * sum_{j>0} |b_j|``; its dual is ``max a'y`` over
``X'a = 0, q - 1 <= a <= q`` (a penalty is one more row ``x = e_j, y = 0`` bounded by
``n * alpha``).  Any feasible ``a`` bounds the optimum from below, so ``gap``, the relative
distance of the two values, proves how good the coefficients are (relative to the loss, or to
a millionth of sum |y| where the fit is perfect).

* A group of at most ``most`` rows is solved in one task by a primal-dual interior point
  method, all its problems one after another.
* A larger group is never gathered; it is fitted by a few passes over its rows, which all its
  problems share.  From the fit of a sample of ``most`` rows, Newton steps on the loss with a
  rounded corner (a quadratic within ``width`` of the plane) move the plane; each pass sums
  gradient and curvature at a few step lengths and the width shrinks until about ``most``
  rows lie within.  Then rows farther away keep their side, and the loss of rows on one side
  is the loss of their sum: a pass hands on the rows within the width and the sums of
  ``SHELLS`` ranges of distance on both sides, and the program of these rows and weighted sums
  is solved exactly.  The loss of a sum is never above the sum of losses, so its dual value
  is a bound for the whole group, and the next pass, which adds up the loss of the new
  coefficients, gives the gap.  A problem whose gap is closed leaves the passes; one whose gap
  stays open goes on from its best coefficients with twice the width.

Rows with a null key, target or feature are left out.  Features that are constant or collinear
within a group share their effect (least-norm steps).  Groups without rows give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, sized_broadcast

MOST = 4000
TOL = 1e-6
SALTS = 16
SHELLS = 6
STEPS = (1.0, 0.5, 0.25, 0.05)
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)  # fixed: quantile-model levels


@dataclass(frozen=True)
class Problem:
    """Level, L1 penalty per row and feature mask (column 0 is the intercept)."""

    candidate: int
    q: float
    alpha: float
    mask: tuple[bool, ...]


def problems(p: int, quantiles: Sequence[float] = QUANTILES, alpha: float = 0.0) -> list[Problem]:
    """One problem a level with all ``p`` features."""
    return [Problem(0, float(q), float(alpha), (True,) * p) for q in quantiles]


# ------------------------------------------------------------------ one program


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric system, scaled to a unit diagonal; least-norm where it is singular."""
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scaled = a / d[:, None] / d
    try:
        x = np.linalg.solve(scaled, b / d)
        if np.all(np.isfinite(x)) and np.linalg.cond(scaled) < 1e12:
            return x / d
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(scaled, b / d, rcond=1e-12)[0] / d


def solve(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, multipliers) of ``max a'y, x'a = 0, low <= a <= high``, by Mehrotra's
    predictor-corrector steps."""
    n, p = x.shape
    width = high - low
    k = -x.T @ low
    s = width / 2
    t = width - s
    b = _least((x * width[:, None]).T @ x, (x * width[:, None]).T @ y)
    r = y - x @ b
    pad = max(float(np.abs(r).mean()), 1e-12 * (1 + float(np.abs(y).mean())))
    v, z = np.maximum(r, 0) + pad, np.maximum(-r, 0) + pad
    scale = float(np.abs(r) @ width) + 1e-12 * (1 + float(np.abs(y) @ width))
    for _ in range(rounds):
        rd, rp = y - x @ b - v + z, k - x.T @ s
        gap = float(s @ z + t @ v)
        if gap <= 1e-10 * scale:
            break
        d = 1.0 / (v / t + z / s)
        m = (x * d[:, None]).T @ x

        def step(cz, cv):
            xi = rd - cv / t + cz / s
            db = _least(m, x.T @ (d * xi) - rp)
            ds = d * (xi - x @ db)
            return db, ds, (cz - z * ds) / s, (cv + v * ds) / t

        def length(u, du):
            down = du < 0
            return min(1.0, float((u[down] / -du[down]).min(initial=np.inf)) * 0.99995)

        db, ds, dz, dv = step(-s * z, -t * v)
        a1, a2 = min(length(s, ds), length(t, -ds)), min(length(z, dz), length(v, dv))
        after = float((s + a1 * ds) @ (z + a2 * dz) + (t - a1 * ds) @ (v + a2 * dv))
        mu = (after / gap) ** 3 * gap / (2 * n)
        db, ds, dz, dv = step(mu - s * z - ds * dz, mu - t * v + ds * dv)
        a1, a2 = min(length(s, ds), length(t, -ds)), min(length(z, dz), length(v, dv))
        s, b, z, v = s + a1 * ds, b + a2 * db, z + a2 * dz, v + a2 * dv
        t = width - s
        floor = 1e-300
        s, t, z, v = np.maximum(s, floor), np.maximum(t, floor), np.maximum(z, floor), np.maximum(v, floor)
    return b, low + s


def pinball(r: np.ndarray, q: float) -> float:
    return float(np.where(r >= 0, q * r, (q - 1) * r).sum())


def program(x: np.ndarray, y: np.ndarray, problem: Problem, n: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients of a problem over rows that count ``weight`` times (default once), ``n``
    rows in all, and the dual value."""
    use = np.flatnonzero(problem.mask)
    xs = x[:, use]
    w = np.ones(len(y)) if weight is None else weight
    low, high = w * (problem.q - 1), w * problem.q
    if problem.alpha > 0:  # |b_j| as rows of their own
        pen = np.eye(len(use))[use > 0]
        xs = np.vstack([xs, pen])
        y = np.append(y, np.zeros(len(pen)))
        low, high = np.append(low, np.full(len(pen), -n * problem.alpha)), np.append(high, np.full(len(pen), n * problem.alpha))
    unit = np.sqrt((xs * xs).mean(axis=0)) if len(xs) else np.ones(len(use))
    unit[unit == 0] = 1.0
    b, a = solve(xs / unit, y, low, high)
    beta = np.zeros(x.shape[1])
    beta[use] = b / unit
    return beta, max(float(a @ y), 0.0)  # no loss is below 0, whatever the dual value is rounded to


def penalty(beta: np.ndarray, problem: Problem, n: float) -> float:
    return n * problem.alpha * float(np.abs(beta[1:]).sum())


# ------------------------------------------------------------------ groups


_OUT = "problem int, beta array<double>, loss double, bound double"


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)


def _whole(rows: DataFrame, keys: list[str], todo: list[Problem]) -> DataFrame:
    """Every problem of groups that one task holds."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(pdf)
        out = []
        for i, problem in enumerate(todo):
            beta, bound = program(x, y, problem, len(y))
            out.append((i, beta.tolist(), pinball(y - x @ beta, problem.q) + penalty(beta, problem, len(y)), bound))
        got = pd.DataFrame(out, columns=["problem", "beta", "loss", "bound"])
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    return rows.groupBy(*keys).applyInPandas(fit, f"{_key_schema(rows, keys)}, {_OUT}")


def _rounded(r: np.ndarray, q: float, h: float) -> float:
    """Pinball loss with a quadratic corner of half-width ``h``."""
    return float(np.where(np.abs(r) < h, (q - 0.5) * r + r * r / (4 * h) + h / 4, np.where(r > 0, q * r, (q - 1) * r)).sum())


def _newton_sums(x: np.ndarray, y: np.ndarray, q: float, beta: np.ndarray, move: np.ndarray, h: float) -> np.ndarray:
    """Per step length: rounded loss, loss, rows in the corner, gradient and curvature."""
    upper, out = np.triu_indices(x.shape[1]), []
    for step in STEPS:
        r = y - x @ (beta + step * move)
        near = np.abs(r) < h
        xn = x[near]
        out.append(np.concatenate([[_rounded(r, q, h), pinball(r, q), near.sum()], np.clip(q - 0.5 + r / (2 * h), q - 1, q) @ x, (xn.T @ xn / (2 * h))[upper]]))
    return np.concatenate(out)


def _shell_sums(x: np.ndarray, y: np.ndarray, r: np.ndarray, h: float) -> np.ndarray:
    """Per side and range of distance beyond ``h``: rows, sums of x and of y."""
    shell = np.clip(np.log(np.abs(r) / h) / np.log(4.0), 0, SHELLS - 1).astype(int) + SHELLS * (r > 0)
    return np.stack([np.bincount(shell, c, 2 * SHELLS) for c in (None, *x.T, y)], axis=1).ravel()


def _pass(rows: DataFrame, guess: DataFrame, keys: list[str], todo: list[Problem], p: int) -> DataFrame:
    """One pass over the rows: per problem the sums of its stage and, in the last stage, the
    rows near the plane.  Sums and rows leave a task once per batch."""
    joined = rows.join(sized_broadcast(guess, materialized=True), on=keys)
    size = max(len(STEPS) * (3 + p + p * (p + 1) // 2), 2 + 2 * SHELLS * (p + 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(keys, sort=False):
                x, y = _matrix(g)
                for part in g["guess"].iloc[0]:
                    i, h, beta = int(part["problem"]), part["width"], np.asarray(part["beta"], float)
                    near = np.zeros(len(y), bool)
                    if part["last"]:
                        r = y - x @ beta
                        near = np.abs(r) <= h
                        sums = np.concatenate([[pinball(r, todo[i].q), near.sum()], _shell_sums(x[~near], y[~near], r[~near], h)])
                    else:
                        sums = _newton_sums(x, y, todo[i].q, beta, np.asarray(part["move"], float), h)
                    out.append((*(key if isinstance(key, tuple) else (key,)), i, np.pad(sums, (0, size - len(sums))), list(x[near]), y[near]))
            yield pd.DataFrame(out, columns=[*keys, "problem", "sums", "xs", "ys"])

    parts = joined.mapInPandas(run, f"{_key_schema(rows, keys)}, problem int, sums array<double>, xs array<array<double>>, ys array<double>")
    return parts.groupBy(*keys, "problem").agg(
        F.array(*[F.sum(F.col("sums")[j]) for j in range(size)]).alias("sums"),
        F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"),  # rows within the width
    )


def _newton(r: dict, problem: Problem, p: int, most: int) -> dict:
    """The next step of a problem from the sums of a pass."""
    beta, move, h, n = np.asarray(r["beta"], float), np.asarray(r["move"], float), r["width"], r["size"]
    use = np.array(problem.mask)
    per = np.asarray(r["sums"], float)[: len(STEPS) * (3 + p + p * (p + 1) // 2)].reshape(len(STEPS), -1)
    corner = h / np.maximum(np.asarray(r["unit"], float), 1e-300)  # of each |b_j|
    free = np.arange(p) > 0

    def rounded_penalty(b):
        return n * problem.alpha * float(np.sqrt(b * b + corner * corner)[free].sum())

    k = int(np.argmin([s[0] + rounded_penalty(beta + t * move) for s, t in zip(per, STEPS)]))
    beta = beta + STEPS[k] * move
    near, g = per[k][2], per[k][3 : 3 + p].copy()
    curve = np.zeros((p, p))
    curve[np.triu_indices(p)] = per[k][3 + p :]
    curve = curve + np.triu(curve, 1).T
    if problem.alpha > 0:
        root = np.sqrt(beta * beta + corner * corner)
        g[free] -= n * problem.alpha * (beta / root)[free]
        curve += np.diag(np.where(free, n * problem.alpha * corner**2 / root**3, 0.0))
    move = np.zeros(p)
    move[use] = _least(curve[np.ix_(use, use)], g[use])
    r = r | {"beta": beta, "move": move}
    if near < 2 * p:
        return r | {"move": np.zeros(p), "width": 4 * h}
    if move @ g / h < max(1.0, 0.02 * near):
        if near <= 2 * most:
            return r | {"beta": beta + move, "move": np.zeros(p), "width": 1.5 * h, "last": True}
        return r | {"width": h / min(4.0, max(1.2, near / most))}
    return r


def _exact(r: dict, problem: Problem, p: int, most: int, tol: float) -> dict:
    """Gap of a problem's coefficients, and the next ones from the rows near their plane."""
    beta, n = np.asarray(r["beta"], float), r["size"]
    loss, near = r["sums"][0] + penalty(beta, problem, n), r["sums"][1]
    if loss <= r["loss"]:
        r = r | {"loss": loss, "best": beta}
    if max(0.0, r["loss"] - r["bound"]) <= tol * max(r["loss"], 1e-6 * r["scale"]):
        return r | {"done": True}
    if np.isfinite(r["bound"]):  # solved before, and not closed: again from the best, wider
        return r | {"beta": r["best"], "width": 2 * r["width"], "bound": -np.inf} if near < 16 * most else r | {"beta": r["best"], "last": False, "width": r["width"] / 4, "bound": -np.inf}
    x, y = np.array([np.asarray(v, float) for v in r["xs"]]).reshape(-1, p), np.asarray(r["ys"], float)
    far = np.asarray(r["sums"][2 : 2 + 2 * SHELLS * (p + 2)], float).reshape(2 * SHELLS, p + 2)
    far = far[far[:, 0] > 0]
    xs, ys = np.vstack([x, far[:, 1:-1] / far[:, :1]]), np.append(y, far[:, -1] / far[:, 0])
    new, dual = program(xs, ys, problem, n, np.append(np.ones(len(y)), far[:, 0]))
    return r | {"beta": new, "bound": dual}


def _large(rows: DataFrame, keys: list[str], todo: list[Problem], p: int, most: int, tol: float, rounds: int) -> DataFrame:
    """Groups of more than ``most`` rows: (keys, problem, beta, loss, bound)."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)))
    rows = materialize(salted.repartition(*keys, "salt").sortWithinPartitions(*keys).drop("salt"))
    unit = F.array(*[F.sqrt(F.avg(F.col("x")[j] * F.col("x")[j])) for j in range(p)])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("size"), F.sum(F.abs("y")).alias("scale"), unit.alias("unit"))
    share = F.pmod(F.xxhash64("y", "x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(sized_broadcast(sizes), on=keys).where(share < F.lit(float(most)) / F.col("size"))
    names = ["problem", "beta", "move", "width", "last", "loss", "bound", "best", "size", "scale", "unit", "done"]
    schema = f"{_key_schema(rows, keys)}, problem int, beta array<double>, move array<double>, width double, last boolean, loss double, bound double, best array<double>, size double, scale double, unit array<double>, done boolean"

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(pdf)
        size, scale, unit = (pdf[c].iloc[0] for c in ("size", "scale", "unit"))
        out = []
        for i, problem in enumerate(todo):
            beta, _ = program(x, y, problem, len(y))
            away = np.sort(np.abs(y - x @ beta))
            h = float(away[len(away) // 4]) or float(away.mean()) or 1e-9 * (1 + scale / size)  # a point mass is at distance 0
            out.append((i, beta, np.zeros(p), h, False, np.inf, -np.inf, beta, size, scale, unit, False))
        got = pd.DataFrame(out, columns=names)
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_exact(r, todo[r["problem"]], p, most, tol) if r["last"] else _newton(r, todo[r["problem"]], p, most) for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[*keys, *names])

    state = materialize(picked.groupBy(*keys).applyInPandas(start, schema))
    for _ in range(rounds):
        left = state.where("not done")
        if left.isEmpty():
            break
        guess = materialize(left.groupBy(*keys).agg(F.collect_list(F.struct("problem", "beta", "move", "width", "last")).alias("guess")))
        moved = left.join(_pass(rows, guess, keys, todo, p), on=[*keys, "problem"]).mapInPandas(advance, schema)
        state = materialize(state.where("done").unionByName(moved))
    return state.select(*keys, "problem", F.col("best").alias("beta"), "loss", "bound")


def fit(rows: DataFrame, keys: Sequence[str], p: int, todo: Sequence[Problem], x: str = "x", y: str = "y", most: int = MOST, tol: float = TOL, rounds: int = 40) -> DataFrame:
    """``keys, candidate, q, alpha, beta, n, loss, gap, converged``: every problem of every
    group.  ``loss`` is the minimised sum, ``gap`` its relative distance from the dual bound
    and ``converged`` whether that is within ``tol``."""
    keys, todo = list(keys), list(todo)
    whole = ~F.exists(F.col(x), lambda v: v.isNull() | F.isnan(v)) & F.col(y).isNotNull() & ~F.isnan(y)
    base = materialize(rows.where(F.col(x).isNotNull() & whole).select(*keys, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")))
    sizes = materialize(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("y")).alias("scale")))
    is_large = F.col("n") > most
    out = _whole(base.join(sized_broadcast(sizes.where(~is_large), materialized=True), on=keys).drop("n", "scale"), keys, todo)
    if not sizes.where(is_large).isEmpty():
        large = base.join(sized_broadcast(sizes.where(is_large), materialized=True), on=keys).drop("n", "scale")
        out = materialize(out).unionByName(_large(large, keys, todo, p, most, tol, rounds))
    names = F.array(*[F.struct(F.lit(t.candidate).alias("candidate"), F.lit(t.q).alias("q"), F.lit(t.alpha).alias("alpha")) for t in todo])
    gap: Column = F.greatest(F.lit(0.0), F.col("loss") - F.col("bound")) / F.greatest(F.col("loss"), F.col("scale") * 1e-6, F.lit(1e-300))
    out = out.join(sized_broadcast(sizes, materialized=True), on=keys).withColumn("_t", names[F.col("problem")])
    return materialize(out.select(*keys, "_t.candidate", "_t.q", "_t.alpha", "beta", "n", "loss", gap.alias("gap"), (gap <= tol).alias("converged")))
