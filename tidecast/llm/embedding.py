"""Exact near-duplicates among embeddings by cosine, compared tile by tile in PCA order.

1. Vectors are rotated into the principal axes of the whole table (a grouped sum of outer
   products; the driver sees one d x d matrix per dimension d).  Equal vectors become one.
2. A k-d tree over the leading axes, fitted on a bounded sample of ``SAMPLE`` vectors, deals
   all vectors into groups of about ``GROUP``; a group that came out larger is split by
   hash.  Each group is cut into tiles of ``TILE`` vectors with bounding boxes.
3. A tile goes to a cell (pair of groups) only if the boxes allow the threshold.  In a cell,
   two tiles are compared on the leading ``STEPS`` dimensions first: partial products plus
   the product of the suffix norms bound the cosine, and a pair goes on only while that
   bound reaches the threshold.  What is left is decided in double precision.
4. A cell returns, per vector, how many vectors it is linked with and one representative of
   its linked set, never the pairs; components are joined by :func:`common.components`.

Vectors that are null, empty, zero or hold null or non-finite values link with nothing, nor
do vectors of different lengths.  Repeated rows are copies of each other.  Rows without id
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, stored

GROUP = 8192
TILE = 512
STEPS = (16, 32)
BOX = 8  # leading axes in the bounding boxes
SAMPLE = 16_384
SLACK = 1e-5  # for the single precision of the bounds
ROW_SCHEMA = "vec_id long, digest binary, dim int, x binary"


def _parse(rows: DataFrame) -> DataFrame:
    """(vec_id, digest, dim, x): x the values as packed doubles; digest null if invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, dims, xs = [], [], []
            lists = b.column(1)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null -> nan
            at, given = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(lists)):
                v = values[at[i] : at[i + 1]] if given[i] else values[:0]
                ok = len(v) > 0 and np.isfinite(v).all() and v.any()
                x = (v + 0.0).tobytes() if ok else None  # -0 as 0
                digests.append(xxhash.xxh3_128_digest(x) if ok else None)
                dims.append(len(v))
                xs.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], ["vec_id", "digest", "dim", "x"])

    return stored(rows.mapInArrow(run, ROW_SCHEMA), "vectors")


def _unit(x: bytes | list[bytes]) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest value first, against overflow."""
    m = np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, largest share first) per dimension."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, g in pdf.groupby("dim"):
                u = _unit(g["x"].tolist())
                sums[d] = sums.get(d, 0.0) + u.T @ u
        for d, m in sums.items():
            yield pd.DataFrame({"dim": d, "row": np.arange(d), "v": [r.tobytes() for r in m]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "row": [pdf["row"].iloc[0]], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

    rows = vectors.where("digest is not null").select("dim", "x").mapInPandas(moments, "dim int, row int, v binary").groupBy("dim", "row").applyInPandas(add, "dim int, row int, v binary").toPandas()
    out = {}
    for d, g in rows.groupby("dim"):
        m = np.stack([np.frombuffer(v) for v in g.sort_values("row")["v"]])
        out[int(d)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


class Tree:
    """Median splits along the leading axes, each time the axis of widest spread."""

    def __init__(self, y: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._grow(y, leaves)

    def _grow(self, y: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if leaves <= 1 or len(y) < 2:
            self.nodes[at] = (-1, self.leaves, 0, 0)
            self.leaves += 1
            return at
        axis = int(np.argmax(y.std(axis=0)))
        low = leaves // 2
        cut = float(np.quantile(y[:, axis], low / leaves))
        left = y[:, axis] <= cut
        self.nodes[at] = (axis, cut, self._grow(y[left], low), self._grow(y[~left], leaves - low))
        return at

    def leaf(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), np.int64)
        todo = [(0, np.arange(len(y)))]
        while todo:
            at, rows = todo.pop()
            axis, cut, left, right = self.nodes[at]
            if axis < 0:
                out[rows] = cut
            else:
                low = y[rows, axis] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _bound(lo: np.ndarray, hi: np.ndarray, tail: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, tail2: np.ndarray) -> np.ndarray:
    """Largest cosine that two boxes (leading axes, largest suffix norm) allow."""
    p = np.maximum(np.maximum(lo * lo2, lo * hi2), np.maximum(hi * lo2, hi * hi2)).sum(axis=-1)
    return p + tail * tail2


def _box(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    k = min(BOX, y.shape[1])
    pad = np.zeros(BOX - k)
    tail = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", y[:, :k], y[:, :k]), 0.0)).max()
    return np.concatenate([y[:, :k].min(axis=0), pad]), np.concatenate([y[:, :k].max(axis=0), pad]), float(tail)


def _compare(u: np.ndarray, y: np.ndarray, u2: np.ndarray, y2: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two tiles with cosine >= threshold: u unit vectors, y the same rotated."""
    d = y.shape[1]
    cuts = [s for s in STEPS if s < d]
    k = cuts[0] if cuts else d
    tails = {c: [np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", m[:, :c], m[:, :c]), 0.0)) for m in (y, y2)] for c in cuts}
    acc = y[:, :k].astype(np.float32) @ y2[:, :k].astype(np.float32).T
    bound = acc + np.multiply.outer(tails[k][0].astype(np.float32), tails[k][1].astype(np.float32)) if cuts else acc
    i, j = np.nonzero(bound >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    part = acc[i, j].astype(np.float64)
    for a, b in zip(cuts, [*cuts[1:], None]):
        if b is None or not len(i):
            break
        part += np.einsum("ij,ij->i", y[i, a:b], y2[j, a:b])
        keep = part + tails[b][0][i] * tails[b][1][j] >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    cos = np.einsum("ij,ij->i", u[i], u2[j])
    return i[cos >= threshold], j[cos >= threshold]


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable over the links (i, j) among n vectors."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, threshold: float = 0.95, embedding: str = "embedding", id_col: str = "vec_id", group: int = GROUP) -> DataFrame:
    """One row per row of ``rows`` with an id: vec_id, n_links (other vectors with cosine >=
    threshold), component_id (smallest id reachable), kept (vec_id = component_id)."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold is above 0, at most 1")
    spark = rows.sparkSession
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null")
    vectors = _parse(source)
    classes = stored(vectors.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = vectors.join(classes.select("digest", F.col("rep").alias("vec_id"), "copies"), ["digest", "vec_id"]).groupBy("digest", "vec_id").agg(F.first("copies").alias("copies"), F.first("dim").alias("dim"), F.first("x").alias("x"))
    reps = stored(reps.select("vec_id", "copies", "dim", "x"), "reps")
    axes = spark.sparkContext.broadcast(_axes(vectors))

    # Groups: leaves of a tree per dimension, split by hash where the sample misjudged them.
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    picked = reps.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))).select("dim", "x").toPandas()
    trees, first = {}, 0
    for d, n in sorted(sizes.items()):
        x = picked[picked["dim"] == d]["x"].tolist()
        y = (_unit(x) @ axes.value[d])[:, :BOX] if x else np.zeros((0, min(BOX, d)))
        trees[d] = (Tree(y, -(-n // group)), first)
        first += trees[d][0].leaves
    trees = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = np.zeros(len(pdf), np.int64)
            for d, at in pdf.groupby("dim").indices.items():
                tree, base = trees.value[d]
                leaf[at] = base + tree.leaf((_unit(pdf["x"].iloc[at].tolist()) @ axes.value[d])[:, :BOX])
            yield pdf.assign(leaf=leaf)[["vec_id", "copies", "dim", "x", "leaf"]]

    dealt = stored(reps.mapInPandas(deal, "vec_id long, copies long, dim int, x binary, leaf long"), "dealt")
    parts = small(stored(dealt.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(1.5 * group)).alias("parts")), "leaves"))
    dealt = dealt.join(parts, "leaf").select("vec_id", "copies", "dim", "x", (F.col("leaf") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("g"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        g, d = int(pdf["g"].iloc[0]), int(pdf["dim"].iloc[0])
        y = _unit(pdf["x"].tolist()) @ axes.value[d]
        order = np.lexsort((pdf["vec_id"], *(y[:, k] for k in range(min(BOX, d) - 1, -1, -1))))
        box = np.concatenate([*_box(y)[:2], [_box(y)[2]]]).tolist()
        out = []
        for i in range(0, len(order), TILE):
            at = order[i : i + TILE]
            lo, hi, tail = _box(y[at])
            out.append((g, d, i // TILE, np.concatenate([lo, hi, [tail]]).tolist(), box, pdf["vec_id"].to_numpy()[at].tobytes(), pdf["copies"].to_numpy()[at].tobytes(), b"".join(pdf["x"].iloc[at])))
        return pd.DataFrame(out, columns=["g", "dim", "t", "box", "gbox", "ids", "copies", "x"])

    schema = "g long, dim int, t int, box array<double>, gbox array<double>, ids binary, copies binary, x binary"
    tiles = stored(dealt.groupBy("g").applyInPandas(tile, schema), "tiles")
    seen = tiles.select("g", "dim", "gbox").where("t = 0").orderBy("g").toPandas()  # one row per GROUP vectors
    groups = spark.sparkContext.broadcast((seen["g"].to_numpy(np.int64), seen["dim"].to_numpy(int), np.array(seen["gbox"].tolist(), float).reshape(-1, 2 * BOX + 1)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, dims, boxes = groups.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                b = np.asarray(r.box)
                fit = (dims == r.dim) & (_bound(b[:BOX], b[BOX:-1], b[-1], boxes[:, :BOX], boxes[:, BOX:-1], boxes[:, -1]) >= threshold - SLACK) | (g == r.g)
                to = g[fit]
                yield pd.DataFrame({"a": np.minimum(to, r.g), "b": np.maximum(to, r.g), "g": r.g, "dim": r.dim, "t": r.t, "box": [r.box] * len(to), "ids": r.ids, "copies": r.copies, "x": r.x})

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, d = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), int(pdf["dim"].iloc[0])
        load = lambda r: (np.asarray(r.box), np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), _unit([r.x[i : i + 8 * d] for i in range(0, len(r.x), 8 * d)]))
        sides = [[(*t, t[3] @ axes.value[d]) for t in map(load, pdf[pdf["g"] == s].sort_values("t").itertuples(index=False))] for s in (a, b)]
        all_ids = np.unique(np.concatenate([t[1] for side in sides for t in side] or [np.zeros(0, np.int64)]))
        links, li, lj = np.zeros(len(all_ids), np.int64), [], []
        for m, (box, ids, copies, u, y) in enumerate(sides[0]):
            for n, (box2, ids2, copies2, u2, y2) in enumerate(sides[1]):
                if a == b and n < m or _bound(box[:BOX], box[BOX:-1], box[-1], box2[:BOX], box2[BOX:-1], box2[-1]) < threshold - SLACK:
                    continue
                i, j = _compare(u, y, u2, y2, a == b and m == n, threshold)
                if len(i):
                    p, q = np.searchsorted(all_ids, ids[i]), np.searchsorted(all_ids, ids2[j])
                    np.add.at(links, p, copies2[j])
                    np.add.at(links, q, copies[i])
                    li.append(p)
                    lj.append(q)
        if not li:
            return pd.DataFrame({"vec_id": [], "links": [], "root": []}, dtype="int64")
        root = _roots(len(all_ids), np.concatenate(li), np.concatenate(lj), all_ids)
        have = links > 0
        return pd.DataFrame({"vec_id": all_ids[have], "links": links[have], "root": root[have]})

    sent = tiles.drop("gbox").mapInPandas(send, "a long, b long, g long, dim int, t int, box array<double>, ids binary, copies binary, x binary")
    found = stored(sent.groupBy("a", "b").applyInPandas(cell, "vec_id long, links long, root long"), "cells")
    comp = components(found, "vec_id", "root").withColumnRenamed("id", "rep")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    out = vectors.select("vec_id", "digest").join(classes, "digest", "left").join(links, "rep", "left").join(comp, "rep", "left")
    cid = F.coalesce("component_id", "rep", "vec_id")
    return out.select("vec_id", F.when(F.col("rep").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), cid.alias("component_id"), (F.col("vec_id") == cid).alias("kept"))
