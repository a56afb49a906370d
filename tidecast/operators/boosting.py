"""Boosted quantile trees for every group and level at once (survey K3).

One model per group (e.g. zone and hour) with one tree per level and round: each tree is grown
on the gradient of the pinball loss and its leaves move by quantiles of the residuals, times
the learning rate.  No group is gathered; a round is ``depth`` + 2 Spark jobs whatever the number
of groups and levels:

* features are cut once into at most ``bins`` ranges per group (approximate percentiles of the
  training rows); rows keep small integers.  A null feature is range 0;
* per depth, the counts and gradient sums of (group, level, node, feature, range) are one
  grouped aggregate with partial sums, running sums over the ranges give every split's gain,
  and the best split of a node is one row;
* leaf values are percentiles of (group, level, leaf) residuals, which merge from partial
  sketches (exact up to ``ACCURACY`` rows a leaf, within n / ``ACCURACY`` ranks beyond);
* new predictions and the loss of the validation rows are one pass, written to the shared
  folder, so a lost executor costs a re-read of the last round.

Every ``patience`` rounds the validation losses are looked at, and rounds end when no group's
has fallen since the last look; every group
keeps the rounds up to its own best one.  Without validation rows all rounds are kept.

Ties between splits go to the lower feature, then the lower cut.  Training rows with a null
target or key are left out; a group without training rows has no model and no predictions.
A node with a pure gradient or too few rows is not split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_max_rows, materialize, sized_broadcast
from .quantreg import QUANTILES

ACCURACY = 10_000


def _bins(features: Sequence[str], cuts: str = "cuts") -> Column:
    """Range numbers of a row: 0 for null, else 1 + the cuts below the value."""

    def range_of(value: Column, edges: Column) -> Column:
        return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.size(F.filter(edges, lambda c: c < value)) + 1)

    return F.array(*[range_of(F.col(f).cast("double"), F.col(cuts)[i]) for i, f in enumerate(features)])


def _node(tree: Column, bins: Column, depth: int) -> Column:
    """Heap number of the node that a row reaches after ``depth`` splits (root 0): a node
    without a split (feature -1) sends all rows to the left."""
    node: Column = F.lit(0)
    for _ in range(depth):
        feature, cut = tree["feature"][node], tree["cut"][node]
        right = (feature >= 0) & (F.get(bins, feature) > cut)
        node = node * 2 + 1 + right.cast("int")
    return node


def _gradient(q: Column, y: Column, f: Column) -> Column:
    """Negative gradient of the pinball loss."""
    return F.when(y > f, q).otherwise(q - 1)


def _levels(quantiles: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(q)) for q in quantiles])


def _split(rows: DataFrame, trees: DataFrame, held: Callable, keys: list[str], depth: int, quantiles: Sequence[float], ridge: float, least_rows: int) -> DataFrame:
    """``trees`` (keys, tree: array of (feature, cut) per level) with the nodes of one more
    depth."""
    width = 2**depth
    j = rows.where("part = 'train'").join(held(trees), on=keys)
    per_level = j.select(*keys, "bins", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(quantiles) - 1)), lambda i: F.struct(
        _node(F.col("tree")[i], F.col("bins"), depth).alias("node"), _gradient(_levels(quantiles)[i], F.col("y"), F.col("f")[i]).alias("g")))).alias("level", "s"))
    cells = per_level.select(*keys, "level", F.col("s.node").alias("node"), F.col("s.g").alias("g"), F.posexplode("bins").alias("feature", "bin"))
    node = [*keys, "level", "node"]
    sums = cells.groupBy(*node, "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"))
    upto = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    whole = Window.partitionBy(*node, "feature")
    s = sums.select(*node, "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("g").over(upto).alias("gl"), F.sum("n").over(whole).alias("nt"), F.sum("g").over(whole).alias("gt"))
    nr, gr = F.col("nt") - F.col("nl"), F.col("gt") - F.col("gl")
    gain = F.col("gl") ** 2 / (F.col("nl") + ridge) + gr**2 / (nr + ridge) - F.col("gt") ** 2 / (F.col("nt") + ridge)
    good = s.withColumn("gain", F.round(gain, 9)).where((F.col("nl") >= least_rows) & (nr >= least_rows) & (F.col("gain") > 0))
    best = good.groupBy(*node).agg(F.max(F.struct("gain", (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"))).alias("b"))
    split = best.groupBy(*keys, "level").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct((-F.col("b.feature")).alias("feature"), (-F.col("b.bin")).alias("cut"))))).alias("m"))
    split = split.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", "m"))).alias("m"))
    first = width - 1
    deeper = lambda t, i: F.struct(*[F.concat(t[part], F.transform(F.sequence(F.lit(first), F.lit(first + width - 1)), lambda k: F.coalesce(F.col("m")[i][k][part], F.lit(-1)))).alias(part) for part in ("feature", "cut")])
    return materialize(trees.join(split, on=keys, how="left").select(*keys, F.transform("tree", deeper).alias("tree")))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def fit(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], y: str = "y", quantiles: Sequence[float] = QUANTILES, rounds: int = 50, depth: int = 3,
    rate: float = 0.1, bins: int = 32, ridge: float = 1.0, least_rows: int = 5, validation: Column | None = None, patience: int = 5,
) -> DataFrame:
    """The model, a row per group: ``keys, cuts, base, trees, rounds, losses``.  ``cuts`` are the
    range borders per feature, ``base`` the training quantiles, ``trees`` per round and level
    the splits and leaf values (already times ``rate``), ``losses`` the validation loss after
    0, 1, ... rounds.  ``validation``: a condition on ``rows`` (those rows do not train)."""
    keys, features = list(keys), list(features)
    levels, n_levels = _levels(quantiles), len(quantiles)
    part = F.when(F.coalesce(validation, F.lit(False)), "check").otherwise("train") if validation is not None else F.lit("train")
    names, keys = keys, [f"_k{i}" for i in range(len(keys))]  # apart from the columns made here
    known = rows.where(F.col(y).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(names, keys)], F.col(y).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)], part.alias("part"))
    known = known.dropna(subset=keys)
    edges = [i / bins for i in range(1, bins)]
    train = F.col("part") == "train"
    cut = lambda c: F.coalesce(F.array_distinct(F.percentile_approx(F.when(train, F.nanvl(c, F.lit(None).cast("double"))), edges, ACCURACY)), F.array().cast("array<double>"))
    groups = known.groupBy(*keys).agg(F.array(*[cut(F.col(f"_f{i}")) for i in range(len(features))]).alias("cuts"), F.percentile_approx(F.when(train, F.col("y")), [float(q) for q in quantiles], ACCURACY).alias("base"))
    groups = materialize(groups.where(F.col("base").isNotNull()))
    # Tables of a row per group: counted once, broadcast where they are few and small.
    few = groups.limit(broadcast_max_rows(rows.sparkSession) // 100 + 1).count() <= broadcast_max_rows(rows.sparkSession) // 100
    held = F.broadcast if few else lambda df: df
    work = known.join(held(groups), on=keys)
    work = materialize(work.select(*keys, "y", "part", _bins([f"_f{i}" for i in range(len(features))]).alias("bins"), F.col("base").alias("f")))
    empty = F.array_repeat(F.struct(F.array().cast("array<int>").alias("feature"), F.array().cast("array<int>").alias("cut")), n_levels)

    def loss(df: DataFrame, k: int) -> DataFrame:
        e = lambda f, i: F.greatest(F.get(levels, i) * (F.col("y") - f), (F.get(levels, i) - 1) * (F.col("y") - f))
        total = F.aggregate(F.transform("f", e), F.lit(0.0), lambda a, v: a + v)
        return df.where("part = 'check'").groupBy(*keys).agg(F.lit(k).alias("k"), F.avg(total / n_levels).alias("loss"))

    grown, losses = [], [loss(work, 0)]
    for k in range(1, rounds + 1):
        trees = materialize(groups.select(*keys, empty.alias("tree")))
        for d in range(depth):
            trees = _split(work, trees, held, keys, d, quantiles, ridge, least_rows)
        at = F.transform("tree", lambda t: _node(t, F.col("bins"), depth) - (2**depth - 1))
        placed = work.join(held(trees), on=keys).withColumn("leaf", at)
        resid = placed.where("part = 'train'").select(*keys, F.posexplode(F.transform("f", lambda f, i: F.struct(F.col("leaf")[i].alias("leaf"), (F.col("y") - f).alias("r")))).alias("level", "s"))
        value = resid.groupBy(*keys, "level", F.col("s.leaf").alias("leaf")).agg(F.percentile_approx("s.r", [float(q) for q in quantiles], ACCURACY).alias("r"))
        value = value.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("level", "leaf"), F.col("r")[F.col("level")] * rate))).alias("m"))
        leaf = lambda t, i: F.struct(t["feature"].alias("feature"), t["cut"].alias("cut"), F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda v: F.coalesce(F.col("m")[F.struct(i.cast("int").alias("level"), v.alias("leaf"))], F.lit(0.0))).alias("leaf"))
        trees = materialize(trees.join(value, on=keys).select(*keys, F.transform("tree", leaf).alias("tree")))
        moved = placed.drop("tree").join(held(trees), on=keys)
        work = materialize(moved.select(*keys, "y", "part", "bins", F.transform("f", lambda f, i: f + F.col("tree")[i]["leaf"][F.col("leaf")[i]]).alias("f")))
        grown.append(trees.withColumn("k", F.lit(k)))
        losses.append(loss(work, k))
        if validation is not None and k % patience == 0:
            losses = [materialize(_union(losses))]
            best = losses[0].groupBy(*keys).agg(F.min_by("k", F.struct("loss", "k")).alias("k")).agg(F.max("k")).first()[0]
            if best is None or best <= k - patience:
                break
    every = _union(losses)
    best = every.groupBy(*keys).agg(F.min_by("k", F.struct("loss", "k")).alias("rounds"), F.transform(F.sort_array(F.collect_list(F.struct("k", "loss"))), lambda s: s["loss"]).alias("losses"))
    forest = _union(grown)
    forest = forest.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "tree"))), lambda s: s["tree"]).alias("trees"))  # a row per round
    model = groups.join(forest, on=keys).join(best, on=keys, how="left").withColumn("rounds", F.coalesce("rounds", F.lit(len(grown))).cast("int"))
    return materialize(model.select(*named_back(keys, names), "cuts", "base", F.slice("trees", 1, F.col("rounds")).alias("trees"), "rounds", "losses"))


def predict(rows: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str], quantiles: Sequence[float] = QUANTILES, depth: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """``keys, keep, q, pred``: a row per row of ``rows`` (of a group with a model) and level.
    The levels of a row are put in ascending order, so quantiles do not cross."""
    keys, keep = list(keys), list(keep)
    own, inputs = [f"_k{i}" for i in range(len(keys))], [f"_f{i}" for i in range(len(features))]
    named = [F.col(c).alias(k) for c, k in zip(keys, own)]
    mine = rows.select(*named, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f) for c, f in zip(features, inputs)])
    j = mine.join(sized_broadcast(model.select(*named, "cuts", "base", "trees")), on=own).withColumn("_bins", _bins(inputs))
    step = lambda acc, tree: F.zip_with(acc, tree, lambda f, t: f + t["leaf"][_node(t, F.col("_bins"), depth) - (2**depth - 1)])
    pred = F.array_sort(F.aggregate(F.col("trees"), F.col("base"), step))
    pairs = F.arrays_zip(_levels(quantiles).alias("q"), pred.alias("pred"))
    out = [*named_back(own, keys), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]]
    return j.withColumn("_p", F.explode(pairs)).select(*out, F.col("_p")["q"].alias("q"), F.col("_p")["pred"].alias("pred"))


def named_back(own: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(c) for k, c in zip(own, names)]
