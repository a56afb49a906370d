"""Language identification by Bayesian fusion of four kinds of evidence.

* *Text*: a multinomial model over letter triples (bytes of the lower-cased text, hashed
  into ``BUCKETS`` buckets) per language, and a uniform model for text in no known language
  (``UNKNOWN``).  Triples overlap, so their log-likelihoods count a third each; whole texts
  are read, and the mean of a long text counts as ``EFFECTIVE`` triples.
* *Declared language* (markup): P(declared | language), from counts over all rows.
* *Address suffix and host*: priors smoothed from the top down, corpus -> suffix -> host,
  from text posteriors summed per group over all rows; a row's own share is taken out of
  its host's count.

The letter models are fitted on a bounded sample: about ``PER_LANGUAGE`` rows per declared
language (by hash of the id), for the ``LANGUAGES`` most frequent declared codes.  All
counts behind the other evidence cover every row.

Null and empty texts, and texts under one triple, leave the decision to the other evidence;
null declared language, host or suffix is no evidence.  A text is accepted when it is not
blank, its language is known and its posterior is at least one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small, stored, temp_name, tidy

BUCKETS = 1 << 16
PER_LANGUAGE = 2_000
LANGUAGES = 64
EFFECTIVE = 200
STRENGTH = 20.0  # rows' worth of the level above in each smoothed prior
UNKNOWN = "und"


def _buckets(text: str) -> np.ndarray:
    d = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.uint32)
    return (((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    names: list[str]  # the known languages, then UNKNOWN
    table: np.ndarray  # (BUCKETS, languages): log-likelihoods
    declared: dict[str, np.ndarray]  # declared code -> log P(code | language)
    other: np.ndarray  # the same for codes that were never counted
    prior: np.ndarray  # corpus prior

    def text(self, text: str | None) -> np.ndarray:
        b = _buckets(text) if text else ()
        if not len(b):
            return np.zeros(len(self.names))
        return self.table[b].mean(axis=0, dtype=np.float64) * min(len(b) / 3.0, EFFECTIVE)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _code(c: Column) -> Column:
    """The primary part of a language code; empty is none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def fit_text(rows: DataFrame) -> Model:
    """Letter models from ``rows`` (id, text, declared)."""
    spark = rows.sparkSession
    known = rows.where("declared is not null and text is not null and text <> ''").groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(LANGUAGES).collect()
    names = sorted(r["declared"] for r in known)
    share = F.lit(0.0)
    for r in known:
        share = F.when(F.col("declared") == r["declared"], F.lit(min(1.0, PER_LANGUAGE / r["count"]))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, d in zip(pdf["text"], pdf["declared"]):
                if t:
                    sums.setdefault(d, np.zeros(BUCKETS, np.int64))
                    np.add.at(sums[d], _buckets(t), 1)
        for d, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"declared": d, "bucket": at, "n": s[at]})

    counts = picked.select("text", "declared").mapInPandas(tidy(count), "declared string, bucket long, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(names) + 1), 0.0)
    for i, name in enumerate(names):
        c = counts[counts["declared"] == name]
        table[c["bucket"].to_numpy(int), i] = c["n"].to_numpy()
    table[:, :-1] = np.log((table[:, :-1] + 0.5) / (table[:, :-1].sum(axis=0) + 0.5 * BUCKETS))
    table[:, -1] = -np.log(BUCKETS)
    k = len(names) + 1
    return Model([*names, UNKNOWN], table.astype(np.float32), {}, np.zeros(k), np.full(k, 1.0 / k))


def _evidence(rows: DataFrame, model) -> DataFrame:
    """Text posteriors of all rows summed by host, suffix, declared code and best language."""

    @pandas_udf("array<double>")
    @tidy
    def posterior(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for s in batches:
            yield pd.Series([_softmax(m.text(t)).tolist() for t in s])

    k = len(model.value.names)
    p = rows.select("host", "suffix", "declared", posterior("text").alias("p"))
    p = p.select("host", "suffix", "declared", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("best"), *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k)])
    return stored(p.groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]), "evidence")


def identify(docs: DataFrame, text: Column, declared: Column, host: Column, suffix: Column, ident: Column, out: str) -> DataFrame:
    """``docs`` with a column ``out``: struct(lang, confidence, text_lang, accepted)."""
    spark = docs.sparkSession
    key = {n: temp_name(docs, n) for n in ("text", "declared", "host", "suffix")}
    full = docs.withColumns({key["text"]: text, key["declared"]: _code(declared), key["host"]: host, key["suffix"]: suffix})
    rows = full.select(ident.alias("id"), *[F.col(v).alias(n) for n, v in key.items()])
    model = fit_text(rows)
    k = len(model.names)
    seen = _evidence(rows, spark.sparkContext.broadcast(model))
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]

    total = seen.agg(*sums).first()
    n = np.array([float(x or 0.0) for x in total])
    prior = (n + 1.0) / (n.sum() + k)
    told = {(r["declared"], r["best"]): r["n"] for r in seen.where(F.col("declared").isin(model.names)).groupBy("declared", "best").agg(F.sum("n").alias("n")).collect()}
    codes = sorted({d for d, _ in told})
    c = np.array([[told.get((d, i), 0) for i in range(k)] for d in codes], dtype=float).reshape(len(codes), k)
    logp = np.log((c + 1.0) / (c.sum(axis=0) + len(codes) + 1.0))
    model.prior, model.declared, model.other = prior, dict(zip(codes, logp)), np.log(1.0 / (c.sum(axis=0) + len(codes) + 1.0))

    def smoothed(values: str, above: Column) -> Column:
        """Counts of a group held to the level above by STRENGTH rows."""
        size = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(values, above, lambda x, p: (x + STRENGTH * p) / (size + STRENGTH))

    top = F.array(*[F.lit(float(p)) for p in prior])
    arr = F.array(*[F.col(f"p{i}") for i in range(k)])
    suffixes = seen.where("suffix is not null").groupBy("suffix").agg(*sums).select("suffix", arr.alias("c")).select("suffix", smoothed("c", top).alias("sp"))
    hosts = seen.where("host is not null").groupBy("host").agg(F.max("suffix").alias("suffix"), *sums).select("host", "suffix", arr.alias("hc"))
    hosts = hosts.join(suffixes, "suffix", "left").select("host", "hc", F.coalesce("sp", top).alias("hp"))
    hosts = stored(hosts, "hosts").withColumnRenamed("host", key["host"])
    suffixes = stored(suffixes, "suffixes").withColumnRenamed("suffix", key["suffix"])
    final = spark.sparkContext.broadcast(model)

    @pandas_udf("lang string, confidence double, text_lang string, accepted boolean")
    @tidy
    def fuse(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        m = final.value
        for ts, ds, cs, ps, ss in batches:
            got = []
            for t, d, hc, hp, sp in zip(ts, ds, cs, ps, ss):
                x = m.text(t)
                if hc is not None:
                    # The row's own text posterior is part of its host's sum.
                    own = np.maximum(np.asarray(hc) - _softmax(x), 0.0)
                    p = (own + STRENGTH * np.asarray(hp)) / (own.sum() + STRENGTH)
                else:
                    p = np.asarray(sp) if sp is not None else m.prior
                y = x + np.log(np.maximum(p, 1e-12))
                if d is not None:
                    y = y + m.declared.get(d, m.other)
                q = _softmax(y)
                best = int(q.argmax())
                blank = not t or t.isspace()
                got.append((m.names[best], float(q[best]), None if blank else m.names[int(x.argmax())], not blank and best < len(m.names) - 1 and q[best] >= 0.5))
            yield pd.DataFrame(got, columns=["lang", "confidence", "text_lang", "accepted"])

    extra = {n: temp_name(docs, n) for n in ("hc", "hp", "sp")}
    hosts = hosts.withColumnsRenamed({"hc": extra["hc"], "hp": extra["hp"]})
    suffixes = suffixes.withColumnRenamed("sp", extra["sp"])
    wide = full.join(small(hosts), key["host"], "left").join(small(suffixes), key["suffix"], "left")
    wide = wide.withColumn(out, fuse(key["text"], key["declared"], extra["hc"], extra["hp"], extra["sp"]))
    return wide.select(*[f"`{c}`" for c in docs.columns if c != out], out)


def host_suffix(host: Column) -> Column:
    """The last label of a host that has dots, without a port."""
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([A-Za-z][A-Za-z0-9-]*)\.?(?::\d*)?$", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def html_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]+)""", 1)


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is identified, with their columns."""
    out = temp_name(docs, "language")
    got = identify(docs, F.col(text), F.col(declared), F.col(host), host_suffix(F.col(host)), F.col(id_col), out)
    return got.where(F.col(f"`{out}`.accepted")).select(*[f"`{c}`" for c in docs.columns])


def identify_tables(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages judged together, one row per row of either."""
    host = url_host(F.col("url"))
    a = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("markup"), F.col("source").alias("host"), host_suffix(F.col("source")).alias("suffix"))
    b = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), html_text(F.col("html")).alias("text"), html_language(F.col("html")).alias("markup"), host.alias("host"), host_suffix(host).alias("suffix"))
    both = a.unionByName(b)
    got = identify(both, F.col("text"), F.col("markup"), F.col("host"), F.col("suffix"), F.xxhash64("doc_id", "page_id"), "r")
    return got.select("doc_id", "page_id", F.nullif("markup", F.lit("")).alias("declared"), "r.lang", "r.confidence", "r.text_lang", "r.accepted")
