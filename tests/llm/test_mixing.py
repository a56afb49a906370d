"""Source mixing against a plain greedy version, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from tidecast.llm import common, mixing

from test_operators import SF001, docs_of

SCHEMA = "doc_id long, text string, source string, size long, KEY string, h string, copies int, target string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, "k", "h", 9, "t") for i, t, s in rows], SCHEMA)


def brute(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Per row (doc_id, size, source_size, target, taken), by sorting."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    place = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, level = set(), 0.0
    while True:
        free = [s for s in names if s not in full]
        level = (share * sum(per.values()) - sum(most * per[s] for s in full)) / sum(w[s] for s in free) if free else level
        more = {s for s in free if w[s] * level > most * per[s]}
        if not more:
            break
        full |= more
    target = {s: min(w[s] * level, most * per[s]) for s in names}

    def cut(part, budget):
        total = sum(part.values())
        times = math.floor(budget / total) if total else 0
        rest, run, upto = budget - times * total, 0, -1
        if rest > 0:
            for h in sorted(part):
                if run + part[h] >= rest:
                    upto, run = (h, run + part[h]) if run + part[h] - rest < rest - run else (h - 1, run)
                    break
                run += part[h]
        return times, upto, times * total + (run if rest > 0 else 0)

    rule = {}
    for s in names:
        parts = {True: Counter(), False: Counter()}
        for i, t, x in rows:
            if x == s and size(t):
                parts[size(t) * 64 > target[s]][place(i, t)] += size(t)
        words = sum(parts[True].values())
        a = cut(parts[True], target[s] * words / per[s] if per[s] else 0)
        b = cut(parts[False], min(max(target[s] - a[2], 0), most * (per[s] - words)))
        rule[s] = {True: a, False: b}
    out = []
    for i, t, s in rows:
        times, upto, _ = rule[s][size(t) * 64 > target[s]]
        out.append((i, size(t), per[s], target[s], size(t) * (times + (place(i, t) <= upto))))
    return out


key = lambda x: tuple((v is None, v) for v in x)


def check(spark, rows):
    got = [tuple(r)[:5] for r in mixing.decide(table_of(spark, rows)).collect()]
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_equals_sorting_on_the_small_table(spark):
    docs = common.table(spark, SF001, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = [tuple(r)[:5] for r in mixing.decide(docs.repartition(5)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_hot_source_long_documents_and_many_rows_meet_their_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), "hot" if i % 3 else f"s{i % 40}") for i in range(6000)]
    rows += [(9000 + i, "long " * 20_000, "hot") for i in range(6)] + [(9100, "x " * 5000, "s0")]
    taken, target = Counter(), {}
    by_id = {i: s for i, _, s in rows}
    for i, size, total, goal, words in check(spark, rows):
        assert 0 <= words <= 2 * size and (not size or words % size == 0)
        taken[by_id[i]] += words
        target[by_id[i]] = goal
    assert math.isclose(sum(target.values()), 1.5 * sum(len(t.split()) for _, t, _ in rows))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(target[s] / 64, 150), s


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "b"), (None, "x y", None), (None, "x y", None), (4, "one two", "a"), (4, "one two", "a"), (4, "three", "a"), (5, "  　", "b"), (6, "solo", ""), (7, "e " * 9, "é")]
    check(spark, rows)
    check(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.decide(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, [(1, "a b c"), (2, None)])
    assert {tuple(r)[:5] for r in mixing.decide(clash).collect()} == set(brute([(1, "a b c", "s"), (2, None, "s")]))


def test_many_sources_join_by_shuffle(spark, monkeypatch):
    rows = [(i, "w " * (i % 17), f"s{i % 29}") for i in range(500)]
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    check(spark, rows)


def test_mixed_table_has_each_row_as_often_as_taken(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 7}") for i in range(400)]
    frame = table_of(spark, rows)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    want = {r.doc_id: r.copies for r in mixing.decide(frame).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == Counter(want)
