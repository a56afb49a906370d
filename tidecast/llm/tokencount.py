"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content (runs of space, tab, line feed and
carriage return as one space, none at the ends: the counted tokenizer drops white space, so
the count is the same) and the tokenizer by the SHA-256 of its file and the library's
version.  Stored counts are joined by both digests; only distinct digests without a count
are encoded, and their counts are appended to the cache, a Parquet folder.

Texts travel compressed to one task per missing digest; copies within a task of the scan go
only once, so a text that a third of the rows hold is sent once per task.  Null and empty
texts have 0 bytes and 0 tokens.  Repeated rows and ids are counted row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Ids, tokenizer_path
from .common import fresh_path, stored

LIMIT = 2048
SCHEMA = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(name: str) -> str:
    import tokenizers

    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def content_digest(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " ")
    return F.sha2(F.trim(plain).cast("binary"), 256)


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; none where the folder is not there yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.  ``cache``: the
    folder of the stored counts (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", content_digest(F.col("text")))
    keys = stored(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    missing = stored(keys.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                k = bytes.fromhex(d)
                if k not in seen:
                    seen.add(k)
                    out.append((d, z.compress(t.as_py().encode())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["digest", "z"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = Ids.load(tokenizer_path(tokenizer)), set()
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if d not in seen:
                    seen.add(d)
                    out.append((d, len(ids.of(z.decompress(t.as_py()).decode())) // 4))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["digest", "n_tokens"])

    texts = rows.select("digest", "text").mapInArrow(squeeze, "digest string, z binary")
    fresh = texts.join(missing, "digest", "left_semi").mapInArrow(encode, "digest string, n_tokens long")
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
