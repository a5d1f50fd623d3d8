"""Vector bin packing of tokenised examples into fixed-length training sequences.

Each example is a vector (tokens, segments, loss-bearing tokens) and each sequence a bin with a limit in every
dimension. The open bin takes the fitting example whose demand has the largest dot product with the bin's
residual room, each dimension scaled by its limit. When no example fits whole, one is cut to fill the bin.

Packing needs no shuffle: every input partition packs its own examples from a bounded pool, so neither a hot
source nor a long text gathers in one task, and a lost task repeats with the same result from the same split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.wordtokens import WordTokenizer

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence, the pool of examples seen at once, and the least piece worth a cut."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    pool: int = 1024
    least_cut: int = 8


@dataclass
class Item:
    """What is left of an example: its ids from ``start`` on; those from ``loss_from`` on bear loss."""

    doc_id: int | None
    ids: np.ndarray
    loss_from: int
    start: int = 0

    def loss(self, start: int, end: int) -> int:
        return max(0, end - max(start, self.loss_from))


class Packer:
    """Packs a stream of items; ``rows`` holds finished pieces until they are taken."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.sequence = limits, first_sequence
        self.pool: list[Item] = []
        self.rows: list[tuple] = []

    def add(self, item: Item) -> None:
        n, cap = len(item.ids), self.limits.tokens
        while n - item.start >= cap and item.loss(item.start, item.start + cap) <= self.limits.loss_tokens:
            self._emit([(item, item.start, item.start + cap)])
            item.start += cap
        if n > item.start:
            self.pool.append(item)
        if len(self.pool) >= self.limits.pool:
            self._drain(self.limits.pool // 2)

    def finish(self) -> None:
        self._drain(0)

    def _drain(self, keep: int) -> None:
        """Fill bins until at most ``keep`` items wait."""
        lim = self.limits
        items = self.pool
        tok = np.array([len(x.ids) - x.start for x in items], dtype=np.int64)
        loss = np.array([x.loss(x.start, len(x.ids)) for x in items], dtype=np.int64)
        live = np.ones(len(items), dtype=bool)
        left = len(items)
        while left > keep:
            room, seats, bearing = lim.tokens, lim.segments, lim.loss_tokens
            parts = []
            while room and seats:
                score = tok * (room / lim.tokens**2) + seats / lim.segments**2 + loss * (bearing / lim.loss_tokens**2)
                fits = live & (tok <= room) & (loss <= bearing)
                best = int(np.argmax(np.where(fits, score, -1.0)))
                if not fits[best]:
                    break
                x = items[best]
                parts.append((x, x.start, len(x.ids)))
                room, seats, bearing = room - int(tok[best]), seats - 1, bearing - int(loss[best])
                live[best] = False
                left -= 1
            if room >= lim.least_cut and seats and left:
                take = np.where(live, np.minimum(room, tok - loss + bearing), 0)
                best = int(np.argmax(take))
                if take[best] >= lim.least_cut:
                    x, n = items[best], int(take[best])
                    parts.append((x, x.start, x.start + n))
                    x.start += n
                    tok[best] = len(x.ids) - x.start
                    loss[best] = x.loss(x.start, len(x.ids))
            self._close(parts)
        self.pool = [x for x, alive in zip(items, live, strict=True) if alive]

    def _close(self, parts: list[tuple[Item, int, int]]) -> None:
        """Emit one sequence, or several of a power of two if the padding would be more than a small cut."""
        total = sum(b - a for _, a, b in parts)
        if self.limits.tokens - total < self.limits.least_cut:
            return self._emit(parts)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, some = 1 << bit, []
            while room:
                x, a, b = parts.pop(0)
                cut = min(b, a + room)
                some.append((x, a, cut))
                room -= cut - a
                if cut < b:
                    parts.insert(0, (x, cut, b))
            self._emit(some)

    def _emit(self, parts: list[tuple[Item, int, int]]) -> None:
        offset = 0
        for x, a, b in parts:
            self.rows.append((x.doc_id, a, b - a, x.ids[a:b].tobytes(), len(x.ids), self.sequence, offset, x.loss(a, b)))
            offset += b - a
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(col, type=field.type) for col, field in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW) if rows else pa.RecordBatch.from_pylist([], schema=ARROW)


def pack(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack examples ``(doc_id long, ids binary, loss_from long)`` and return their pieces.

    ``ids`` are little-endian unsigned 32-bit; the ids at positions from ``loss_from`` on bear loss. Every id
    lies in exactly one piece. A sequence is full but for less than ``least_cut`` ids, or its length is a power
    of two. Null or empty ids give no piece; a null ``loss_from`` counts as 0; repeated rows are packed each;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, ids, loss_from in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw = ids.as_py()
                if raw:
                    packer.add(Item(doc_id.as_py(), np.frombuffer(raw, dtype="<u4"), loss_from.as_py() or 0))
                if len(packer.rows) >= 2000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return items.select(F.col("doc_id").cast("long"), "ids", F.col("loss_from").cast("long")).mapInArrow(run, PIECES)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` with the vocabulary at ``tokenizer`` and pack the whole texts.

    Every text's ids are followed by ``end_id``, so a null or empty text is one piece of one id. All ids bear
    loss. Tokenising and packing share one pass, so ids move only to the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.shared(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 2_000_000):
                    size += len(texts[end].as_buffer()) if texts[end].is_valid else 0
                    end += 1
                some = [x or "" for x in texts.slice(at, end - at).to_pylist()]
                for doc_id, ids in zip(ids_of.slice(at, end - at).to_pylist(), words.encode(some, end_id), strict=True):
                    packer.add(Item(doc_id, ids, 0))
                    if len(packer.rows) >= 2000:
                        yield packer.take()
                at = end
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
