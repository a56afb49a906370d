"""Cross-entropy difference between a target and a background language model.

Both models are word bigram models over one vocabulary, the words of all documents, with the
same smoothing (Dirichlet priors): p(w) = (c(w) + 1) / (N + V + 1) and
p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior).  The target model counts the documents
marked as target, the background model all documents.  A document is judged by models that
have not seen it: its own counts are taken off first.  Its score is the mean over its words
and its end of target loss minus background loss, in nats: the lower, the more like the target.

Words are lower-cased runs of letters and digits, single letters of Han and Kana, and single
other marks.  Words and bigrams are told apart by 64-bit hashes.

The models grow with the corpus and are never gathered.  A task forms blocks of about
``BLOCK`` characters of text and tells, per slice of the key space, the block's distinct words
and bigrams with their counts, as sorted keys in packed arrays.  A slice is merged in one task
(hash ranges are even; a frequent word is one entry a block, however often it occurs) and
answers every block with the counts of those keys that other blocks hold too; the others are
known to the block already.  A block is then scored beside its answers only.  Blocks are formed
twice, by the same scan; a checksum of a block's keys travels with its answers, and a scan that
comes out differently fails instead of mixing counts.

Null and empty texts, and texts without words, have no tokens and score 0.  A document marked
twice counts once per row of the documents; repeated rows are rows of their own, and each is
background to the other.  Null ids are kept and are never target.  Without target documents
all scores are 0.  A very long text is a block of its own.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Characters of text in a block, but for a longer single document.
BLOCK = 4 << 20
#: Bytes of text a slice of the key space stands for.
SLICE = 8 << 20
#: Weight of the word model in the bigram model, in occurrences.
PRIOR = 50.0
_ALONE = "぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"  # letters written without spaces
_WORD = re.compile(rf"[{_ALONE}]|[^\W_{_ALONE}]+|[^\w\s]|_")
_PLAIN = re.compile(r"[a-z0-9]+|[^a-z0-9\s]")  # the same on ASCII, without Unicode classes
_EDGE = np.uint64(0x9E3779B97F4A7C14)  # start and end of a document; even, like all words
_END = np.array([_EDGE])
_MIX, _STEP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KNOWN: dict[str, int] = {}
_REMEMBERED, _LONGEST = 1 << 17, 32  # words a worker remembers, and their longest


def words(text: str | None) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    return (_PLAIN if text.isascii() else _WORD).findall(text.lower())


def _number(word: str) -> int:
    got = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1
    if len(word) <= _LONGEST:
        if len(_KNOWN) >= _REMEMBERED:
            _KNOWN.clear()
        _KNOWN[word] = got
    return got


def keys(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the texts, their ends included: its key, and the key of the pair of it
    and the token before it (the start has the key of the end); and the tokens of each text.
    Word keys are even, pair keys odd."""
    get = _KNOWN.get
    parts, n = [], []
    for t in texts:
        w = words(t)
        n.append(len(w) + 1 if w else 0)
        if w:
            parts.append(np.array([get(x) or _number(x) for x in w], np.uint64))
            parts.append(_END)
    u = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    x = np.concatenate((_END, u[:-1])) if len(u) else u.copy()
    x *= _MIX
    x += u
    x ^= x >> np.uint64(29)
    x *= _STEP
    x ^= x >> np.uint64(32)
    x |= np.uint64(1)
    return u, x, np.array(n, np.int64)


def _targets(key: np.ndarray, u: np.ndarray, pair: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """How often the tokens that are marked, and their pairs, have each of the sorted keys."""
    out = np.zeros(len(key), np.int64)
    for x in (u, pair):
        k, c = np.unique(x[marked], return_counts=True)
        out[np.searchsorted(key, k)] = c
    return out


def _checksum(key: np.ndarray, target: np.ndarray, count: np.ndarray) -> int:
    """Of a block's tally, whatever the order of its documents."""
    return int((key * (count * 2 + target * 3 + 1).view(np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _planes(numbers: np.ndarray) -> bytes:
    """How many bytes the largest of the 64-bit numbers needs, and these bytes plane by plane."""
    planes = (int(numbers.view(np.uint64).max(initial=0)).bit_length() + 7) // 8
    return bytes([planes]) + numbers.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def _numbers(packed: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : packed[0]] = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], n).T
    return out.reshape(-1).view(kind)


def _ends(key: np.ndarray, slices: int) -> np.ndarray:
    """Where the slices of sorted keys start, and the end of the last."""
    width = (1 << 64) // slices + 1
    return np.append(np.searchsorted(key, np.array([i * width for i in range(slices)], np.uint64)), len(key))


def _rows(docs: DataFrame, target_ids: DataFrame, text: str, id_col: str) -> DataFrame:
    t = small(stored(target_ids.select("id", F.lit(True).alias("target")), "targets"))
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    # ids travel as text: pandas would make floats of long ids beside null ones
    return rows.join(t, "id", "left").select("part", F.col("id").cast("string").alias("id"), "text", F.coalesce("target", F.lit(False)).alias("target"))


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, list[pd.DataFrame]]]:
    """The blocks of a task's rows: number and frames."""
    part, at, frames, held = 0, 0, [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        part = int(pdf["part"].iat[0])
        long = held + np.cumsum([len(s) if s else 1 for s in pdf["text"]])
        start = 0
        while start < len(pdf):
            stop = int(np.searchsorted(long, size)) + 1
            frames.append(pdf.iloc[start:stop])
            if stop > len(pdf):
                held = int(long[-1])
                break
            yield (part << 32) + at, frames
            long, start, at, frames, held = long - long[stop - 1], stop, at + 1, [], 0
    if frames:
        yield (part << 32) + at, frames


def _tell(batches: Iterator[pd.DataFrame], size: int, slices: int) -> Iterator[pd.DataFrame]:
    """Per block and slice: the packed keys and counts."""
    for block, frames in _blocks(batches, size):
        u, pair, n = keys(t for f in frames for t in f["text"])
        key, count = np.unique(np.concatenate((u, pair)), return_counts=True)
        t = _targets(key, u, pair, np.repeat(np.concatenate([f["target"].to_numpy(bool) for f in frames]), n))
        del u, pair, frames
        total, ends = _checksum(key, t, count), _ends(key, slices)
        some = np.flatnonzero(np.diff(ends))
        rows = []
        for i in some.tolist():
            x = slice(ends[i], ends[i + 1])
            rows.append((int(ends[i + 1] - ends[i]), _planes(np.diff(key[x], prepend=np.uint64(0))), _planes(t[x]), _planes(count[x] - 1)))
        yield pd.DataFrame(rows, columns=["n", "keys", "t", "b"]).assign(slice=some, block=block, checksum=total)[["slice", "block", "checksum", "n", "keys", "t", "b"]]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slice: for every block a mask of its keys that others hold too, with their counts;
    and a row without block: distinct words of the slice, tokens of target and of all."""
    size = pdf["n"].to_numpy()
    every, back, blocks = np.unique(np.concatenate([np.cumsum(_numbers(k, n, np.uint64), dtype=np.uint64) for k, n in zip(pdf["keys"], size)]), return_inverse=True, return_counts=True)
    t, b = (np.bincount(back, np.concatenate([_numbers(x, n) + add for x, n in zip(pdf[c], size)]), len(every)).astype(np.int64) for c, add in (("t", 0), ("b", 1)))
    word = (every & np.uint64(1)) == 0
    out, at, shared = [(None, 0, int(word.sum()), int(t[word].sum()), int(b[word].sum()), None, None, None)], 0, blocks > 1
    for block, total, n in zip(pdf["block"], pdf["checksum"], size.tolist()):
        i = back[at : at + n]
        mask, at = shared[i], at + n
        out.append((block, total, n, 0, 0, np.packbits(mask).tobytes(), _planes(t[i[mask]]), _planes(b[i[mask]])))
    got = pd.DataFrame(out, columns=["block", "checksum", "n", "n_target", "n_all", "mask", "t", "b"])
    return got.assign(slice=int(pdf["slice"].iat[0])).astype({"block": "Int64"})


def _own(back: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often the document of each entry has the entry's key; ``count``: the same of the block."""
    out = np.ones(len(back), np.int64)
    again = np.flatnonzero(count[back] > 1)
    _, at, n = np.unique(doc[again] * len(count) + back[again], return_inverse=True, return_counts=True)
    out[again] = n[at]
    return out


def _log(count: np.ndarray, pair: np.ndarray, before: np.ndarray, total: np.ndarray, kinds: int, prior: float) -> np.ndarray:
    """Losses from the counts of the tokens, of the pairs and of the tokens before them."""
    word = (count + 1.0) / (total + kinds + 1.0)
    return -np.log((pair + prior * word) / (before + prior))


def score(docs: DataFrame, target_ids: DataFrame, text: str = "text", id_col: str = "doc_id", prior: float = PRIOR, size: int = BLOCK, slice_bytes: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens (words and the end), target_loss,
    background_loss (nats a token), score (their difference), like_target (score below 0).
    ``target_ids`` holds the distinct ids (column ``id``) of the target."""
    rows = _rows(docs, target_ids, text, id_col)
    slices = max(1, -(-int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // slice_bytes))
    told = rows.mapInPandas(lambda it: _tell(it, size, slices), "slice int, block long, checksum long, n int, keys binary, t binary, b binary")
    answers = stored(told.groupBy("slice").applyInPandas(_answer, "block long, checksum long, n long, n_target long, n_all long, mask binary, t binary, b binary, slice int"), "lm-answers")
    row = answers.where("block is null").agg(F.sum("n").alias("kinds"), F.sum("n_target").alias("t"), F.sum("n_all").alias("b")).first()
    kinds, n_target, n_all = row.kinds or 0, float(row.t or 0), float(row.b or 0)
    formed = "block long, id string, text string, target boolean"
    schema = "doc_id string, n_tokens long, target_loss double, background_loss double"

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, frames in _blocks(batches, size):
            for f in frames:
                yield f[["id", "text", "target"]].assign(block=block)[["block", "id", "text", "target"]]

    def judge(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        u, pair, n = keys(rows["text"])
        marked = np.repeat(rows["target"].to_numpy(bool), n)
        key, back, count = np.unique(np.concatenate((u, pair)), return_inverse=True, return_counts=True)
        t, b = _targets(key, u, pair, marked), count.copy()
        del u, pair
        total, ends = _checksum(key, t, b), _ends(key, slices)
        if len(found) != np.count_nonzero(np.diff(ends)) or (found["checksum"] != total).any():
            raise ValueError("the documents came out in other blocks than before; write them as a table first")
        for i, size, mask, ts, bs in zip(found["slice"], found["n"], found["mask"], found["t"], found["b"]):
            at = ends[i] + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=size))
            t[at], b[at] = _numbers(ts, len(at)), _numbers(bs, len(at))
        got = pd.DataFrame({"doc_id": rows["id"].to_numpy(), "n_tokens": n, "target_loss": 0.0, "background_loss": 0.0})
        if not len(marked):
            return got
        doc = np.repeat(np.arange(len(n)), n)
        word, both = back[: len(doc)], back[len(doc) :]
        own, own_both = _own(word, doc, count), _own(both, doc, count)
        # The token before the first is the end of the text before, whose key is the same.
        before, own_before = np.concatenate((word[-1:], word[:-1])), np.concatenate((own[-1:], own[:-1]))
        full = np.flatnonzero(n)
        start = np.cumsum(n)[full] - n[full]

        def mean_loss(c: np.ndarray, of: int | np.ndarray, all_: float) -> np.ndarray:
            loss = _log(c[word] - own * of, c[both] - own_both * of, c[before] - own_before * of, all_ - n[doc] * of, kinds, prior)
            return np.add.reduceat(loss, start) / n[full]

        got.loc[full, "background_loss"] = mean_loss(b, 1, n_all)
        got.loc[full, "target_loss"] = mean_loss(t, marked, n_target) if n_target else got["background_loss"].to_numpy()[full]
        return got

    found = answers.where("block is not null").drop("n_target", "n_all")
    got = rows.mapInPandas(form, formed).groupBy("block").cogroup(found.groupBy("block")).applyInPandas(judge, schema)
    difference = F.col("target_loss") - F.col("background_loss")
    return got.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).select("*", difference.alias("score"), (difference < 0).alias("like_target"))


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled as good quality."""
    return labels.where("quality = 1").select(F.col(id_col).alias("id")).where("id is not null").distinct()
