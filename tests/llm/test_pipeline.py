"""The corpus pipeline against brute force on the small table, and the registered queries."""

import zlib

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from tidecast.llm import bpe, common, decontaminate, toxicity

from test_operators import SF001, brute_hits, groups_of, sets_of

COLUMNS = {
    "op1": {"vec_id", "n_links", "component_id", "kept"},
    "op2": {"doc_id", "page_id", "lang"},
    "op3": {"doc_id", "score"},
    "op4": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op5": {"doc_id", "n_shingles", "component_id"},
    "op6": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op7": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9": {"page_id", "host", "path", "rule", "verdict"},
    "op10": {"doc_id", "held_out", "score", "predicted"},
    "op11": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12": {"item_id", "rank", "doc_id", "score"},
    "op13": {"doc_id", "size", "source_size", "target", "taken"},
}


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS)
    assert "pipeline" in entry.queries() and {"op6_decontaminate", "op9_url_filter", "op12_lexical_search", "op13_source_mixing"} <= set(entry.oracle_sql())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = common.table(spark, SF001, "documents")
    got = corpus_pipeline.run(spark, SF001).toPandas()

    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, common.table(spark, SF001, "labels")).collect()}
    texts = [(i, r.text) for i, r in sorted(rows.items()) if scores[i] < 0.5 and r.text and not r.text.isspace()]
    groups = groups_of(sets_of(texts, 5), 80)
    items = [(r.item_id, r.text) for r in common.table(spark, SF001, "benchmark").collect()]
    kept = {i: t for i, t in texts if groups[i][1] == i and not brute_hits(t, items, decontaminate.WINDOW)[4]}
    assert set(got.doc_id) == set(kept)
    lib = bpe.Ids.load(bpe.tokenizer_path("word_bpe_49k.json")).lib
    for i, g in got.groupby("doc_id"):
        ids, at = np.array(lib.encode(kept[i], add_special_tokens=False).ids + [1], "<u4"), 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)


def test_stages_keep_the_columns_of_documents(spark):
    docs = common.table(spark, SF001, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF001).columns == docs.columns, name


def test_stages_that_use_python_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = common.table(spark, SF001, "documents")
    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('0123456789', 500) as text")

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    own = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "benchmark_decontamination":  # DataFrame functions only
                continue
            spark.conf.unset(key)
            stage(spark, docs.limit(0), SF001)
            sizes = [r["size"] for r in long.mapInArrow(held, "size long").collect()]
            assert len(sizes) > 5 and max(sizes) < 2 * corpus_pipeline.BATCH, name
        spark.conf.set(key, "9m")  # the session's own size stays
        corpus_pipeline.pack(spark, docs.limit(0), SF001)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key)
        if own is not None:
            spark.conf.set(key, own)
