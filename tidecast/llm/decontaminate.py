"""Benchmark decontamination with DataFrame functions only.

Words: A-Z lower-cased, then maximal runs of letters, digits and anything beyond ASCII.
A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window.  Every word position of a document is tested in three steps, each
only where the one before passed: the hash of the first word, the hash of the first three
words, and the window's own text in the set of all windows.  The sets travel with the plan,
so the scan needs no shuffle; they are used only where the benchmark is counted at no more
than ``MAX_WINDOWS`` windows.  Beyond that the windows of the documents are joined to the
benchmark's by hash and compared as text.

Null texts have no words and no windows.  Rows are judged one by one, so repeated rows and
ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, temp_name

WINDOW = 13
MAX_WINDOWS = 50_000

_OTHERS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
_UPPER = "".join(chr(c) for c in range(0x41, 0x5B))
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_REST = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHERS, _UPPER.lower() + " " * len(_OTHERS))
    return F.array_remove(F.split(plain, " "), "")


def _with(value: Column, use) -> Column:
    """``use(x)`` with ``value`` computed once and bound to x."""
    return F.transform(F.array(value), use)[0]


def _text(ws: Column, i: Column, length: int) -> Column:
    return F.array_join(F.slice(ws, i + 1, length), " ")


def windows(benchmark: DataFrame, text: str = "text", id_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(win, len, item) for every distinct window of every item."""
    ws = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text)).alias("ws")).where("size(ws) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    n = F.least(F.size("ws"), F.lit(window))
    return ws.select("item", n.alias("len"), F.explode(F.transform(at, lambda i: F.array_join(F.slice("ws", i + 1, n), " "))).alias("win")).distinct()


def _starts(ws: Column, i: Column, length: int, n: int) -> Column:
    """Hash of the first n words of a window of ``length`` words at i."""
    return F.xxhash64(F.lit(length), *[F.get(ws, i + j) for j in range(n)])


def _hit_column(wins: DataFrame, text: Column) -> Column:
    """struct(n_words, hits array<struct<pos, len, win>>) computed within the row."""
    parts = F.split("win", " ")
    rows = wins.select("len", "win", F.xxhash64("len", F.get(parts, F.lit(0))).alias("one"), *[F.get(parts, F.lit(j)).alias(f"w{j}") for j in range(3)])
    rows = rows.select("len", "win", "one", F.xxhash64("len", F.when(F.col("len") >= 1, F.col("w0")), F.when(F.col("len") >= 2, F.col("w1")), F.when(F.col("len") >= 3, F.col("w2"))).alias("three")).distinct().collect()  # at most MAX_WINDOWS
    by: dict[int, tuple[set, set, set]] = {}
    for r in rows:
        one, three, full = by.setdefault(r["len"], (set(), set(), set()))
        one.add(r["one"])
        three.add(r["three"])
        full.add(r["win"])

    def of_length(ws: Column, length: int) -> Column:
        one, three, full = by[length]
        last = F.size(ws) - length
        hit = lambda i: _starts(ws, i, length, 1).isin(list(one)) & _starts(ws, i, length, min(3, length)).isin(list(three)) & _text(ws, i, length).isin(list(full))
        at = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hit)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), _text(ws, i, length).alias("win")))

    def found(ws: Column) -> Column:
        none = F.array().cast("array<struct<pos:int,len:int,win:string>>")
        hits = F.flatten(F.array(*[of_length(ws, n) for n in sorted(by)])) if by else none
        return F.struct(F.size(ws).cast("long").alias("n_words"), hits.alias("hits"))

    return _with(words(text), found)


def _covered(hits: Column) -> Column:
    """How many words lie in any of the hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(s, h):
        end = h["pos"] + h["len"]
        more = F.greatest(end - F.greatest(s["end"], h["pos"]), F.lit(0))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(hits), start, add, lambda s: s["n"].cast("long"))


def _scan(docs: DataFrame, wins: DataFrame, text: str, out: str, max_windows: int) -> DataFrame:
    """``docs`` with column ``out`` = struct(n_words, hits)."""
    if wins.limit(max_windows + 1).count() <= max_windows:
        return docs.withColumn(out, _hit_column(wins, F.col(text)))
    # The benchmark is too large to travel with the plan: join windows by hash instead.
    rid, ws = temp_name(docs, "row"), temp_name(docs, "words")
    rows = stored(docs.withColumn(rid, F.monotonically_increasing_id()).withColumn(ws, words(F.col(text))), "words")
    lens = [r["len"] for r in wins.select("len").distinct().orderBy("len").collect()]  # 1 to WINDOW

    def hashed(n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0)))
        return F.when(F.size(ws) >= n, F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(_text(F.col(ws), i, n)).alias("h")))).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))

    each = F.flatten(F.array(*[hashed(n) for n in lens]))
    cand = rows.select(F.col(rid).alias("rid"), F.inline(each)).join(wins.select("len", "win", F.xxhash64("win").alias("h")).distinct(), ["len", "h"])
    real = cand.join(rows.select(F.col(rid).alias("rid"), F.col(ws).alias("ws")), "rid").where(F.array_join(F.slice("ws", F.col("pos") + 1, F.col("len")), " ") == F.col("win"))
    hits = real.groupBy("rid").agg(F.collect_set(F.struct("pos", "len", "win")).alias("hits")).withColumnRenamed("rid", rid).withColumnRenamed("hits", out)
    none = F.array().cast("array<struct<pos:int,len:int,win:string>>")
    return rows.join(hits, rid, "left").withColumn(out, F.struct(F.size(ws).cast("long").alias("n_words"), F.coalesce(F.col(out), none).alias("hits"))).drop(rid, ws)


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = stored(windows(benchmark, window=window), "windows")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    seen = _scan(rows, wins, "text", "h", max_windows).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("h.n_words").alias("n_words"), _covered(F.col("h.hits")).alias("n_hit"), F.array_distinct(F.col("h.hits.win")).alias("wins"))
    seen = stored(seen, "hits")
    items = seen.where("size(wins) > 0").select("rid", F.explode("wins").alias("win")).join(wins.select("win", "item"), "win").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    got = seen.join(items, "rid", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return got.select("doc_id", "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    wins = stored(windows(benchmark, window=window), "windows")
    h = temp_name(docs, "hits")
    seen = _scan(docs, wins, text, h, max_windows)
    return seen.where(~_is_contaminated(_covered(F.col(f"`{h}`.hits")), F.col(f"`{h}`.n_words"))).drop(h)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with the hit words, each with what follows it up to the next word, cut out
    of ``text``; texts without hits stay as they are."""
    wins = stored(windows(benchmark, window=window), "windows")
    h = temp_name(docs, "hits")
    seen = _scan(docs, wins, text, h, max_windows)
    hits = F.col(f"`{h}`.hits")
    units = F.regexp_extract_all(F.col(text), F.lit(f"(?:^{_REST}+)?{_WORD}+{_REST}*"), F.lit(0))
    left = F.filter(F.transform(units, lambda u, i: F.when(F.exists(hits, lambda x: (x["pos"] <= i) & (i < x["pos"] + x["len"])), F.lit(None)).otherwise(u)), lambda u: u.isNotNull())
    return seen.withColumn(text, F.when(F.size(hits) > 0, F.array_join(left, "")).otherwise(F.col(text))).drop(h)
