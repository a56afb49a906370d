"""Ranked lexical search against a plain integer version, its pruning, and awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import common, search

from test_operators import LONG, SF001, docs_of, lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) from (id, text) lists."""
    found = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        q = Counter(TERM.findall(lower(text)))
        scores = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, at + 1, i, s) for at, (_, _, i, s) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id string, text string, rank int, doc_id string")


def test_equals_brute_force_on_the_small_table(spark):
    docs, items = common.table(spark, SF001, "documents"), common.table(spark, SF001, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(search.rank(docs, items)) == want


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "ROUNDS", (0.5, 1.0))
    docs = [(1, None), (2, ""), (3, " .,\n"), (4, "alpha beta"), (4, "alpha beta"), (5, "Alpha BETA"), (6, LONG), (7, "alpha"), (8, "é日本 alpha-beta_gamma"), (9, "beta alpha 12")]
    docs += [(20 + i, "alpha beta gamma") for i in range(15)]  # ties beyond the limit
    items = [("a", "alpha beta"), ("b", None), ("c", " ?! "), ("d", "É日本"), ("e", "word1 word1 AND1"), ("f", "absent"), ("a", "gamma alpha alpha"), (None, "beta")]
    frame, queries = docs_of(spark, docs), items_of(spark, items)
    assert rows(search.rank(frame, queries)) == brute(docs, items)
    monkeypatch.setattr(search, "blocks", lambda *a, f=search.blocks: f(*a, most=2))
    assert rows(search.rank(frame, queries, k=3)) == brute(docs, items, 3)
    assert search.rank(docs_of(spark, []), queries).count() == 0
    assert search.rank(frame, items_of(spark, [])).count() == 0
    assert rows(search.rank(docs_of(spark, docs + [(None, "alpha")]), queries, k=99)) == brute(docs + [(None, "alpha")], items, 99)


@pytest.mark.parametrize("focus", [0.2, 0.8, 1.0])
def test_bounds_skip_buckets_and_drop_documents_but_lose_none(focus, monkeypatch):
    monkeypatch.setattr(search, "FOCUS", focus)
    rng = np.random.default_rng(5)
    w = rng.integers(1, 9000, 300)
    queries = [Counter({int(t): int(r) for t, r in zip(rng.choice(300, 12, replace=False), rng.integers(1, 3, 12))}) for _ in range(20)]
    docs = []
    for i in range(3000):
        n = int(rng.integers(1, 40)) if i % 10 else 2
        t = np.sort(rng.choice(300, n, replace=False))
        docs.append((i, t, rng.integers(1, 40 if i % 7 else 100_000, n)))
    length = np.array([math.sqrt(float((w[t] * v.astype(float) ** 2).sum())) for _, t, v in docs])
    s = search.Searcher(queries, w, 10, np.zeros(20, np.int64))
    order = np.argsort(-length)
    for lo in range(0, len(docs), 200):
        part = [docs[i] for i in order[lo : lo + 200]]
        at = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in part])])
        s.bucket([i for i, _, _ in part], np.concatenate([t for _, t, _ in part]), np.concatenate([v for _, _, v in part]), at, length[order[lo : lo + 200]])
    for q, best in zip(queries, s.best):
        scores = [(-sum(q[int(x)] * int(w[x]) * int(y) for x, y in zip(t, v) if int(x) in q), i) for i, t, v in docs]
        assert best == sorted(x for x in scores if x[0] < 0)[:10]
    assert s.skipped > 0 and s.dropped > 0
    assert s.scored < 20 * len(docs) / 2


def test_weights_and_impacts():
    assert search.weights(10, np.array([0, 1, 10])).tolist() == [math.floor(1000 * math.log(22)), math.floor(1000 * math.log(22 / 3)), math.floor(1000 * math.log(22 / 21))]
    assert search.impacts(np.array([100]), np.array([3]), 10, 1000).tolist() == [3_000_000_000 // (3000 + 8 * (25 + 75))]
