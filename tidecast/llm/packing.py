"""Pack documents into fixed windows of token ids, online and in bounded space.

Each partition keeps at most ``OPEN`` windows open.  A document is cut into full windows
and a rest; the rest goes into the open window that it fills best; when none has room and
``OPEN`` windows are open, the fullest is closed and a new one begun.  What is still open
at the end of a partition is merged: the leftovers of ``MERGED`` partitions at a time are
joined and cut anew, so at most one short window is left per such group.

Null and empty texts are one id, the end id.  Rows are packed one by one; repeated rows are
packed again.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED, Ids, tokenizer_path
from .common import give_back, stored, tidy

WINDOW = 2048
OPEN = 64
MERGED = 16
#: An open window with at most this share free is closed as it is when leftovers are merged.
FULL_ENOUGH = 1 / 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

Piece = tuple  # (doc_id, start, doc_tokens, packed ids)


class Packer:
    """The open windows of one partition."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN):
        self.window, self.most = window, open_windows
        self.free: list[tuple[int, int]] = []  # (free ids, key), sorted
        self.held: dict[int, list[Piece]] = {}
        self.key = 0

    def add(self, doc_id: int, ids: bytes) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that this closes."""
        n, total, at = self.window, len(ids) // 4, 0
        while total - at >= n:
            yield [(doc_id, at, total, ids[4 * at : 4 * (at + n)])]
            at += n
        need = total - at
        if not need:
            return
        i = bisect.bisect_left(self.free, (need, -1))
        if i < len(self.free):
            room, key = self.free.pop(i)
        else:
            if len(self.free) == self.most:
                yield self.held.pop(self.free.pop(0)[1])
            room, key, self.key = n, self.key, self.key + 1
            self.held[key] = []
        self.held[key].append((doc_id, at, total, ids[4 * at :]))
        if room == need:
            yield self.held.pop(key)
        else:
            bisect.insort(self.free, (room - need, key))

    def rest(self) -> list[list[Piece]]:
        return [self.held[k] for _, k in self.free]


def _rows(window: list[Piece], sequence: int, keep: bool = False) -> list[tuple]:
    out, at = [], 0
    for doc_id, start, total, ids in window:
        n = len(ids) // 4
        out.append((doc_id, start, n, zlib.crc32(ids), total, sequence, at, ids if keep else None))
        at += n
    return out


def _refill(pieces: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Fill windows one after the other, cutting pieces where a window is full."""
    now: list[Piece] = []
    room = window
    for doc_id, start, total, ids in pieces:
        while ids:
            part, ids = ids[: 4 * room], ids[4 * room :]
            now.append((doc_id, start, total, part))
            start += len(part) // 4
            room -= len(part) // 4
            if not room:
                yield now
                now, room = [], window
    if now:
        yield now


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN, text: str = "text", id_col: str = "doc_id", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens (with the end id), sequence_id, offset (in its sequence, gapless from 0).
    A worker remembers the ids of about ``remembered`` units: fewer take less memory and more
    time, and give the same ids."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()  # what the worker held for other work, broadcasts that Spark has just dropped
        part = TaskContext.get().partitionId()
        encode, packer, made = Ids.load(tokenizer_path(tokenizer)), Packer(window, open_windows), 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _ARROW)], schema=_ARROW)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                for w in packer.add(doc_id, encode.of(t.as_py(), remembered) + end):
                    rows += _rows(w, (part << 36) + made)
                    made += 1
            yield batch(rows)
            rows = []
        encode.forget()
        for w in packer.rest():
            rows += _rows(w, (part << 36) + made, keep=True)
            made += 1
        yield batch(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        group, made, out, loose = int(pdf["sequence_id"].min() >> 36) // MERGED, 0, [], []
        for _, w in pdf.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
            pieces = list(zip(w["doc_id"].astype(object).where(w["doc_id"].notna(), None), w["start"], w["doc_tokens"], w["ids"]))
            if window - int(w["length"].sum()) <= window * FULL_ENOUGH:
                out += _rows(pieces, (1 << 62) + (group << 36) + made)
                made += 1
            else:
                loose += pieces
        for pieces in _refill(loose, window):
            out += _rows(pieces, (1 << 62) + (group << 36) + made)
            made += 1
        df = pd.DataFrame(out, columns=[f.name for f in _ARROW])
        return df.drop(columns="ids").astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = stored(rows.mapInArrow(tidy(run), SCHEMA), "packed")
    columns = [f.name for f in _ARROW if f.name != "ids"]
    loose = first.where("ids is not null").groupBy(F.expr(f"shiftright(sequence_id, 36) div {MERGED}").alias("g"))
    merged = loose.applyInPandas(lambda pdf: merge(pdf.drop(columns="g", errors="ignore")), SCHEMA.removesuffix(", ids binary"))
    return first.where("ids is null").select(*columns).unionByName(merged)
