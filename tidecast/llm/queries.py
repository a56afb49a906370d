"""The registered queries of this package and their DuckDB SQL (``QUERIES``, ``ORACLES``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, embedding, jaccard, language, lm, mixing, packing, search, tokencount, tokenfile, toxicity, urlrules
from .common import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, with their nearest examples as evidence."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 13) AS n, unnest([array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') FOR i IN range(1, greatest(len(ws) - 12, 1) + 1)]) AS win FROM b WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws FROM d, lens WHERE len(ws) >= n),
hit AS (SELECT dw.rid, dw.pos, dw.n, bw.item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = array_to_string(list_slice(dw.ws, dw.pos, dw.pos + dw.n - 1), ' ')),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


@query("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (declared: lang, host: source) and all pages (declared:
    html lang, host and suffix of the address); doc_id or page_id is null."""
    return language.identify_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


@query("op1_embedding_dedup")
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; target: documents labelled good."""
    return lm.score(table(spark, sf_dir, "documents"), lm.good_ids(table(spark, sf_dir, "labels")))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as ORC and read back."""
    path = fresh_path(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(spark, path)


# The rules that the contract of op9 states.
OP9_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

OP9_SQL = """
WITH r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (rid)
"""


@query("op9_url_filter", OP9_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page addresses against the rules."""
    return urlrules.judge(table(spark, sf_dir, "pages"), OP9_RULES)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY k),
w AS (SELECT k, ss, CAST(2 * ss AS DOUBLE) AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS DOUBLE) AS wt FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(ss) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam, row_number() OVER o AS i FROM w WINDOW o AS (ORDER BY cap / wt, k)),
t AS (SELECT k, ss, least(wt * (SELECT arg_min(lam, i) FROM l WHERE wt * lam <= cap), cap) AS target FROM l),
r AS (SELECT d.*, ss, target, size * 64 > target AS long FROM d JOIN t USING (k)),
c AS (SELECT k, long, h, CAST(sum(size) AS BIGINT) AS s, CAST(sum(sum(size)) OVER (PARTITION BY k, long ORDER BY h) AS BIGINT) AS cum FROM r WHERE size > 0 GROUP BY k, long, h),
g AS (SELECT k, ss, target, CAST(coalesce(sum(size) FILTER (WHERE long), 0) AS BIGINT) AS lw FROM r GROUP BY k, ss, target),
b1 AS (SELECT *, CASE WHEN lw > 0 THEN CAST(floor(target * lw / ss / lw) AS BIGINT) ELSE 0 END AS times, CASE WHEN lw > 0 THEN target * lw / ss - floor(target * lw / ss / lw) * lw ELSE 0 END AS budget FROM g),
x1 AS (SELECT k, arg_min(CASE WHEN cum - budget < budget - (cum - s) THEN h ELSE h - 1 END, cum) AS upto, arg_min(CASE WHEN cum - budget < budget - (cum - s) THEN cum ELSE cum - s END, cum) AS got FROM c JOIN b1 USING (k) WHERE long AND budget > 0 AND cum >= budget GROUP BY k),
b2 AS (SELECT b1.k, b1.ss, target, times AS times1, coalesce(upto, -1) AS upto1, ss - lw AS sw, least(greatest(target - (times * lw + coalesce(got, 0)), 0), (ss - lw) * 2::DOUBLE) AS left2 FROM b1 LEFT JOIN x1 USING (k)),
b3 AS (SELECT *, CASE WHEN sw > 0 THEN CAST(floor(left2 / sw) AS BIGINT) ELSE 0 END AS times2, CASE WHEN sw > 0 THEN left2 - floor(left2 / sw) * sw ELSE 0 END AS budget FROM b2),
x2 AS (SELECT k, arg_min(CASE WHEN cum - budget < budget - (cum - s) THEN h ELSE h - 1 END, cum) AS upto2 FROM c JOIN b3 USING (k) WHERE NOT long AND budget > 0 AND cum >= budget GROUP BY k)
SELECT r.doc_id, r.size, r.ss AS source_size, r.target, CAST(r.size * CASE WHEN long THEN times1 + CAST(h <= upto1 AS BIGINT) ELSE times2 + CAST(h <= coalesce(upto2, -1) AS BIGINT) END AS BIGINT) AS taken
FROM r JOIN b3 ON r.k = b3.k LEFT JOIN x2 ON r.k = x2.k
"""


@query("op13_source_mixing", OP13_SQL)
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 of 150 % of their words."""
    return mixing.decide(table(spark, sf_dir, "documents")).drop("copies")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT qid, term, count(*) AS reps FROM (SELECT qid, unnest(ws) AS term FROM b) GROUP BY qid, term),
tf AS (SELECT rid, term, n, count(*) AS tf FROM (SELECT rid, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term, n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY term, nn),
s AS (SELECT qid, rid, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY qid, rid),
r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN b USING (qid) WHERE rank <= 10
"""


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of all documents."""
    return alignment.summary(table(spark, sf_dir, "documents"))
