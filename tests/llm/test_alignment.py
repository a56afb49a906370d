"""Token alignment against a plain version over byte offsets, and awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidecast.llm import alignment, bpe, common

from test_operators import SF001, docs_of

LETTERS = {c: b for b, c in bpe._byte_letters().items()}
A = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
A_TOKENS = {i: t for t, i in A.get_vocab().items()}


def sides(text):
    """(id, end) lists of both sides by the libraries alone."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = [(i, bytes(LETTERS[c] for c in A_TOKENS[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    ends = lambda xs: list(zip([i for i, _ in xs], np.cumsum([len(x) for _, x in xs]).tolist()))
    return ends(a), ends(b)


def brute(docs):
    rows, count = [], Counter()
    for i, t in docs:
        a, b = sides(t)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        by_end = {f: y for y, f in b}
        links = [(x, by_end[e]) for x, e in a if e in by_end]
        text, ia, ib = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][1] <= c:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][1] <= c:
                gb.append(str(b[ib][0]))
                ib += 1
            text.append(",".join(ga) + "|" + ",".join(gb))
        count.update(links)
        rows.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted([(i, na, nb, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha) for i, na, nb, g, ls, sha in rows], key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "don't I'M <|endoftext|> <s>x</s> <0x41>"), (6, "é é ﬁ 日本語 \x00\x1c\t\n\n x"), (7, "x▁y"), (8, "naïve café"), (8, "naïve café"), (8, "other text"), (None, "a null id"), (9, "\n\n<|endoftext|>\n"), (10, "word " * 30_000), (11, "👩‍👩‍👧 ok"), (12, "a")]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(alignment, "GATHERED", 1000)
    assert rows(alignment.summary(docs_of(spark, AWKWARD).repartition(3), hot=hot)) == brute(AWKWARD)
    if hot != 40:
        return
    docs = common.table(spark, SF001, "documents")
    assert rows(alignment.summary(docs, hot=hot)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert alignment.summary(docs_of(spark, [])).count() == 0
    assert alignment.overlaps(docs_of(spark, [])).count() == 0


def test_overlaps_are_the_pairs_that_share_bytes(spark):
    for r in alignment.overlaps(docs_of(spark, [x for x in AWKWARD if x[0] != 10]).coalesce(1)).collect():
        assert len(r.a_place) == len(r.b_place) and len(r.a_lead) == len(r.b_lead)
    texts = {i: t for i, t in AWKWARD if i not in (8, 10)}
    for r in alignment.overlaps(docs_of(spark, list(texts.items()))).collect():
        a, b = sides(texts[r.doc_id])
        assert r.a_ids == [i for i, _ in a] and r.b_ids == [i for i, _ in b]
        span = lambda xs: list(zip([0, *[e for _, e in xs]], [e for _, e in xs]))
        want = [(i, j) for i, (s, e) in enumerate(span(a)) for j, (u, v) in enumerate(span(b)) if s < v and u < e]
        assert list(zip(r.a_place, r.b_place)) == want
        starts = {s for s, _ in span(a)} & {s for s, _ in span(b)}
        assert r.a_lead == [i for i, (s, _) in enumerate(span(a)) if s in starts] and r.b_lead == [j for j, (s, _) in enumerate(span(b)) if s in starts]


def test_covering_in_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 7)
    rng = np.random.default_rng(3)
    x, y = (np.concatenate([[0], np.cumsum(rng.integers(1, 9, n))]) for n in (200, 90))
    assert alignment.covering(x, y).tolist() == (np.searchsorted(y, x, "right") - 1).tolist()
    assert len(alignment.covering(x[:0], y)) == 0


def test_hot_pairs_are_bounded(spark):
    pairs = spark.createDataFrame(pd.DataFrame({"pair": range(1000), "n": [2 ** (i % 10) for i in range(1000)]}))
    for most in (0, 99, 100, 350, 1000):
        c = alignment.hot_class(pairs, most)
        assert pairs.where(alignment._class(pairs.n) >= c).count() == most // 100 * 100
