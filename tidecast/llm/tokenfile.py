"""Token ids as ORC files, and their reader.

Files hold documents in ascending order of id, one row per document with its ids as an
integer list (ORC run-length encodes them), row indexes every ``STRIDE`` rows and a Bloom
filter on ``doc_id``, so a reader works on stripes side by side and skips those that cannot
hold a document.  A manifest table beside the data (one row per file) has the ids before
each file, so a document's place in the whole sequence needs no pass over the data.

Layout: ``<path>/data`` ORC (part, doc_id, local_start, ids), ``<path>/manifest`` Parquet
(part, first_doc, last_doc, docs, tokens, base).

Null and empty texts hold the end id only.  Rows that share an id stay neighbours, in the
order of a hash of their texts; rows without id come first.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Ids, tokenizer_path

STRIDE = 1000


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, text: str = "text", id_col: str = "doc_id") -> None:
    """Encode ``docs`` and write the files."""
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, Ids.load(tokenizer_path(tokenizer))
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # so that a batch of ids stays small
                s = b.slice(lo, 256)
                packed = [encode.of(t.as_py()) + end for t in s.column(1)]
                n = np.array([len(p) // 4 for p in packed], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), s.column(0), pa.array(starts), ids], ["part", "doc_id", "local_start", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    out = rows.mapInArrow(run, "part int, doc_id long, local_start long, ids array<int>")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", STRIDE).orc(f"{path}/data")

    files = spark.read.orc(f"{path}/data").groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("docs"), F.sum(F.size("ids").cast("long")).alias("tokens")).orderBy("part").collect()
    base = itertools.accumulate([r["tokens"] for r in files], initial=0)
    spark.createDataFrame([(*r, b) for r, b in zip(files, base)], "part int, first_doc long, last_doc long, docs long, tokens long, base long").coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of all documents; filters on doc_id reach the files."""
    base = spark.read.parquet(f"{path}/manifest").select("part", "base")  # one row per file
    rows = spark.read.orc(f"{path}/data").join(F.broadcast(base), "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[at[i] : at[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
