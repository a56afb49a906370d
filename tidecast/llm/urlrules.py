"""URL rules in a sorted digest array.

Each rule is a host and a path prefix, written as one string (``example.org/es/``).  The
array holds the 64-bit xxhash of every rule in ascending order, with the rules' own strings
beside it.  It is written once to the shared folder, handed to every machine as a file and
memory-mapped there, so all workers of a machine share one copy.  A URL is probed with every
suffix of its host and every prefix of its path that has the length of some rule's path;
the probes of a batch go through one vectorised binary search, and a hit counts only when
the stored string equals the probe.  The longest rule wins (then the longer host).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end.  A null URL, or one without ``://``, has neither.
Where no rule fits, the verdict is ``DEFAULT``: the list blocks what it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import shared_dir

DEFAULT = "allow"
#: Most rules of one array (the driver sorts them); longer lists are a join, not an array.
MAX_RULES = 5_000_000

ENTRY = np.dtype([("key", "<u8"), ("at", "<u8"), ("len", "<u4"), ("host", "<u4"), ("block", "<u4"), ("pad", "<u4")])


def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """(verdict, host, path) rules as one file: entry count, sorted entries, strings.  A
    rule given twice counts once; if its verdicts differ, block wins."""
    by: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not path.startswith("/"):
            raise ValueError(f"no rule: {verdict} {host}{path}")
        k = (host.lower(), path)
        by[k] = "block" if "block" in (by.get(k), verdict) else verdict
    if len(by) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    entries, strings = np.zeros(len(by), ENTRY), []
    at = 0
    for i, ((host, path), verdict) in enumerate(by.items()):
        s = (host + path).encode()
        entries[i] = (xxhash.xxh64_intdigest(s), at, len(s), len(host.encode()), verdict == "block", 0)
        strings.append(s)
        at += len(s)
    return np.uint64(len(by)).tobytes() + np.sort(entries, order=["key", "at"]).tobytes() + b"".join(strings)


class Rules:
    """A memory-mapped array."""

    _open: dict[str, Rules] = {}

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        n = int(self.data[:8].view("<u8")[0])
        self.entries = self.data[8 : 8 + n * ENTRY.itemsize].view(ENTRY)
        self.keys = self.entries["key"]
        self.text = 8 + n * ENTRY.itemsize
        self.lengths = sorted({int(x) for x in np.unique(self.entries["len"] - self.entries["host"])})

    @classmethod
    def open(cls, path: str) -> Rules:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def fits(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """The longest rule that fits each (host, path), and whether it blocks."""
        probes, owner, host_len = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            p = path.encode()
            starts = [p[:n] for n in self.lengths if n <= len(p)]
            while host and starts:
                h = host.encode()
                probes += [h + s for s in starts]
                owner += [i] * len(starts)
                host_len += [len(h)] * len(starts)
                host = host.partition(".")[2]
        best: list[tuple | None] = [None] * len(hosts)
        if probes and len(self.keys):
            key = np.array([xxhash.xxh64_intdigest(x) for x in probes], np.uint64)
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            for j in np.flatnonzero(hi > lo):
                for e in self.entries[lo[j] : hi[j]]:
                    if e["host"] == host_len[j] and self.data[self.text + int(e["at"]) : self.text + int(e["at"] + e["len"])].tobytes() == probes[j]:
                        rank = (int(e["len"]), int(e["host"]), probes[j].decode(), bool(e["block"]))
                        i = owner[j]
                        if best[i] is None or rank[:2] > best[i][:2]:
                            best[i] = rank
        return [b and (b[2], b[3]) for b in best]


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the array to the shared folder and give it to every machine; returns its name."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where)
    out.write(bytearray(pack(rules)))
    out.close()
    spark.sparkContext.addFile(where.getFileSystem(conf).makeQualified(where).toString())
    return name


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", id_col: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict."""
    name = publish(pages.sparkSession, rules)

    @pandas_udf("rule string, block boolean")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = Rules.open(SparkFiles.get(name))
        for hosts, paths in batches:
            got = array.fits(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": [g and g[0] for g in got], "block": [g and g[1] for g in got]}, dtype=object)

    host, path = parts(F.col(url))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("r", fit("host", "path"))
    verdict = F.when(F.col("r.rule").isNull(), F.lit(default)).when(F.col("r.block"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
