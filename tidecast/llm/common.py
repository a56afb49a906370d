"""Helpers shared by the text operators: written intermediates, bounded broadcast,
bit filters and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when counted at or below this many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.  Only where
    it is unset in a local session (tests, a laptop) a scratch folder is made and used
    instead; a cluster session fails, as executors would not see such a folder."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-ckpt-")
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and a
    lost executor costs a re-read instead of a recomputation."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (cheap to count: an aggregate already stored) marked for broadcast when it has
    at most ``rows`` rows; beyond that it is returned plain and joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


# ------------------------------------------------------------------ memory of workers


def give_back() -> None:
    """Return this process's freed memory to the system (where its C library can)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextlib.contextmanager
def returned_at_once() -> Iterator[None]:
    """While this is open, the system gets back arrays from 256 KB on as soon as they are freed
    (where its C library can); else they leave holes between the arrays that stay."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    threshold = -3  # M_MMAP_THRESHOLD
    if tune:
        tune(threshold, 1 << 18)
    try:
        yield
    finally:
        if tune:
            tune(threshold, 1 << 25)  # where it gets by itself when such arrays are freed


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, after which its worker gives freed memory back.
    Workers outlive their tasks, and the idle ones share an executor's memory."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


# ------------------------------------------------------------------ bit filter

#: Most bits of a filter that keeps unneeded rows out of an exact join (8 MiB); smaller sets
#: get smaller ones.  A fuller filter lets more rows through to that join, never fewer.
FILTER_BITS = 1 << 26


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _slots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter (two probes) of a long column as packed bits, 16 for a row up to
    ``FILTER_BITS``.  ``df`` is a stored table.  Each partition makes its own bits; Spark
    ORs them slice by slice, so the driver receives one filter, not the ids."""
    slice_bytes = 1 << 16
    rows = df.select(F.col(column).cast("long").alias("id")).where("id is not null")
    size = min(FILTER_BITS, max(1 << 19, 1 << (16 * rows.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for b in batches:
            for s in _slots(b.column(0).to_numpy(zero_copy_only=False), size):
                bits[s] = True
        packed = np.packbits(bits)
        parts = [(i, packed[i : i + slice_bytes]) for i in range(0, len(packed), slice_bytes)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in parts], pa.int64()), "bits": pa.array([p for _, p in parts], pa.binary())})

    def merge(pdf):
        out = np.zeros(slice_bytes, dtype=np.uint8)
        for p in pdf["bits"]:
            out |= np.frombuffer(p, np.uint8)
        return pdf.head(1)[["at"]].assign(bits=out.tobytes())

    packed = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.mapInArrow(tidy(build), "at long, bits binary").groupBy("at").applyInPandas(merge, "at long, bits binary").collect():
        packed[r["at"] : r["at"] + slice_bytes] = np.frombuffer(r["bits"], np.uint8)
    return packed


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter; an id that was put in always is."""
    a, b = _slots(ids, 8 * len(packed))
    hit = lambda s: (packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


# ------------------------------------------------------------ connected components


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Union-find: node -> smallest node of its set, for the nodes of ``pairs``."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars with the same components."""
    for b in batches:
        root = forest(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        kids = [(x, r) for x, r in root.items() if x != r]
        yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in kids], pa.int64()), "v": pa.array([r for _, r in kids], pa.int64())})


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (id, component_id = smallest id reachable),
    one row per node of an edge.  Nulls and self-links are ignored.

    Alternating large-star and small-star rounds over distinct edges; each round groups
    with partial aggregation and joins the minimum back, so a hub's edges are never held
    in one group, and each round is written to the shared folder.  Edges are first
    thinned batch by batch with union-find."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stored(e.mapInArrow(tidy(_thin), "u long, v long").distinct(), "cc")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
