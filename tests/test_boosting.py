"""Boosted quantile trees against a small NumPy booster, and on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import boosting, models

LEVELS = (0.1, 0.5, 0.9)
FEATURES = ["a", "b", "c"]


def _rows(groups=("g", "h"), n=260, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for g in groups:
        for i in range(n):
            a, b, c = rng.uniform(-2, 2), float(rng.integers(0, 4)), rng.normal()
            y = 2 * np.sin(1.5 * a) + 0.7 * b + 1.2 * c + rng.normal() * (0.2 + 0.4 * (b == 2))
            y = y if g == "g" else 1 - 2 * y
            out.append((g, i, float(a) if i % 17 else None, b, float(c), float(y), i % 4 == 0))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "g string, i int, a double, b double, c double, y double, val boolean").repartition(4)


def _lower(values, q):
    """The percentile that Spark's sketch gives while it is exact: an element at rank ceil(q n)."""
    v = np.sort(values)
    return float(v[max(int(np.ceil(q * len(v))) - 1, 0)])


class Booster:
    """The same trees, one group at a time."""

    def __init__(self, rows, rounds, depth, rate, bins, ridge, least):
        train = [r for r in rows if not r[6] and r[5] is not None]
        self.depth = depth
        self.cuts = []
        for f in (2, 3, 4):
            v = [r[f] for r in train if r[f] is not None]
            self.cuts.append(sorted({_lower(v, k / bins) for k in range(1, bins)}) if v else [])
        x = np.array([self.bins(r) for r in train])
        y = np.array([r[5] for r in train])
        self.base = [_lower(y, q) for q in LEVELS]
        f = np.tile(self.base, (len(y), 1))
        self.trees = []
        for _ in range(rounds):
            level_trees = []
            for l, q in enumerate(LEVELS):
                g = np.where(y > f[:, l], q, q - 1)
                splits = {}
                node = np.zeros(len(y), int)
                for d in range(depth):
                    for k in set(node.tolist()):
                        best = None
                        at = node == k
                        for j in range(3):
                            for c in sorted(set(x[at, j].tolist())):
                                left = at & (x[:, j] <= c)
                                nl, nt = left.sum(), at.sum()
                                if nl < least or nt - nl < least:
                                    continue
                                gl, gt = g[left].sum(), g[at].sum()
                                gain = round(gl**2 / (nl + ridge) + (gt - gl) ** 2 / (nt - nl + ridge) - gt**2 / (nt + ridge), 9)
                                if gain > 0 and (best is None or gain > best[0]):
                                    best = (gain, j, c)
                        if best:
                            splits[k] = best[1:]
                    node = np.array([self.step(splits, k, r) for k, r in zip(node, x)])
                leaves = {k: rate * _lower((y - f[:, l])[node == k], q) for k in set(node.tolist())}
                f[:, l] += [leaves[k] for k in node]
                level_trees.append((splits, leaves))
            self.trees.append(level_trees)

    def bins(self, r):
        return [0 if r[f] is None else 1 + sum(c < r[f] for c in cuts) for f, cuts in zip((2, 3, 4), self.cuts)]

    @staticmethod
    def step(splits, k, x):
        return 2 * k + 1 + int(k in splits and x[splits[k][0]] > splits[k][1])

    def predict(self, r):
        x, f = self.bins(r), list(self.base)
        for trees in self.trees:
            for l, (splits, leaves) in enumerate(trees):
                k = 0
                for _ in range(self.depth):
                    k = self.step(splits, k, x)
                f[l] += leaves.get(k, 0.0)
        return sorted(f)


def test_equals_a_numpy_booster(spark):
    rows = _rows()
    args = dict(rounds=3, depth=2, rate=0.3, bins=8, ridge=1.0, least_rows=5)
    df = _frame(spark, rows)
    model = boosting.fit(df.where("not val"), ["g"], FEATURES, quantiles=LEVELS, **args)
    got = {}
    for r in boosting.predict(df, model, ["g"], FEATURES, LEVELS, 2, ["i"]).orderBy("q").collect():
        got.setdefault((r.g, r.i), []).append(r.pred)
    assert len(got) == len(rows)
    for g in ("g", "h"):
        mine = [r for r in rows if r[0] == g]
        want = Booster(mine, 3, 2, 0.3, 8, 1.0, 5)
        for r in mine:
            assert got[g, r[1]] == pytest.approx(want.predict(r), abs=1e-9)


def _pinball(rows, preds):
    e = np.array([[r[5] - p for p in preds[r[0], r[1]]] for r in rows])
    q = np.array(LEVELS)
    return float(np.maximum(q * e, (q - 1) * e).mean())


def test_held_out_loss_is_below_the_single_tree_and_rounds_stop(spark):
    rows = _rows(n=500)
    train, test = [r for r in rows if r[1] % 5], [r for r in rows if not r[1] % 5]
    df = _frame(spark, train)
    model = boosting.fit(df, ["g"], FEATURES, quantiles=LEVELS, rounds=12, rate=0.4, validation=F.col("val"), patience=4)
    m = {r.g: r for r in model.collect()}
    for r in m.values():
        assert r.rounds == int(np.argmin(r.losses)) == len(r.trees) and r.losses[r.rounds] < r.losses[0]
    preds, tree = {}, {}
    for r in boosting.predict(_frame(spark, test), model, ["g"], FEATURES, LEVELS, keep=["i"]).orderBy("q").collect():
        preds.setdefault((r.g, r.i), []).append(r.pred)
    single = models.tree_quantiles(df, _frame(spark, test), FEATURES, "y", ["g", "i"], LEVELS, categories=["g"])
    for r in single.orderBy("q").collect():
        tree.setdefault((r.g, r.i), []).append(r.pred)
    assert len(preds) == len(test) and all(len(v) == 3 and v == sorted(v) for v in preds.values())
    assert _pinball(test, preds) < _pinball(test, tree)


def test_awkward_rows(spark):
    rows = [("g", i, None, 1.0, float("nan"), 5.0, False) for i in range(20)] + [("g", 99, 1.0, 1.0, 1.0, None, False), (None, 1, 1.0, 1.0, 1.0, 1.0, False), ("v", 1, 1.0, 1.0, 1.0, 1.0, True)]
    df = _frame(spark, rows)
    model = boosting.fit(df, ["g"], FEATURES, quantiles=LEVELS, rounds=2, validation=F.col("val"))
    got = boosting.predict(df, model, ["g"], FEATURES, LEVELS, keep=["i"]).collect()
    assert {(r.g, r.pred) for r in got} == {("g", 5.0)} and len(got) == 21 * 3
    none = boosting.fit(df.limit(0), ["g"], FEATURES, quantiles=LEVELS, rounds=1)
    assert none.count() == 0 and boosting.predict(df, none, ["g"], FEATURES, LEVELS).count() == 0
