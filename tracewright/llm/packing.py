"""Best-fit packing of token pieces into sequences of a fixed length.

Bounded-space online best fit: at most ``open_bins`` sequences are open at a time, in a bitset keyed
by free space, so the fitting sequence with the least room is two integer operations away. When a
piece fits nowhere and all are open, the fullest closes. What a partition leaves open is packed once
more, longest pieces first, together with what other partitions left open.

Null texts count as empty; a row with an empty text still gives its end id. Rows with equal ids, and
null ids, are packed like any other. Empty input gives an empty result. Other columns of the input
are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .tokens import encoder
from .words import trim

#: Sequences in one task of the second pass at most; all of them stay open.
TAIL_SEQUENCES = 16_384

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Places pieces; ``closed`` gets (items, free) of each sequence that closes."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits = 0
        self.by_free: dict[int, list[list]] = {}
        self.n_open = 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return out

    def _put(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.n_open += 1

    def add(self, length: int, item) -> list | None:
        """Places an item; returns the items of a sequence that this closes."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            items = self._take(free)
            items.append((self.size - free, item))
            if free == length:
                return items
            self._put(free - length, items)
            return None
        if length == self.size:
            return [(0, item)]
        closed = None
        if self.n_open >= self.open_bins:
            closed = self._take((self.bits & -self.bits).bit_length() - 1)
        self._put(self.size - length, [(0, item)])
        return closed

    def left(self) -> Iterator[list]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def _schema(with_ids: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    return pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else []), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, digest (and ids), sequence and offset in it."""
    schema = _schema(with_ids)
    ddl = _PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        encode = encoder(tokenizer, lean=True)
        for doc, ids in zip(batch.column(0).to_pylist(), encode.encode_column(batch.column(1))):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(ids), max_tokens)):
                part = ids[start : start + max_tokens]
                yield len(part), (doc, k, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else []))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        fit = BestFit(max_tokens, open_bins)

        def rows() -> Iterator[tuple]:
            nonlocal number
            for batch in batches:
                for length, item in pieces(batch):
                    if closed := fit.add(length, item):
                        yield from ((*x, number, at) for at, x in closed)
                        number += 1
            for items in fit.left():  # still open: for the second pass
                yield from ((*x, None, None) for _, x in items)
            batch = None
            trim()

        return _batches(rows(), schema)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = -1 - (TaskContext.get().partitionId() << 32)
        fit = BestFit(max_tokens, 1 << 62)

        def rows() -> Iterator[tuple]:
            nonlocal number
            for batch in batches:
                for item in zip(*(c.to_pylist() for c in batch.columns[:-2])):
                    if closed := fit.add(item[3], item):
                        yield from ((*x, number, at) for at, x in closed)
                        number -= 1
            for items in fit.left():
                yield from ((*x, number, at) for at, x in items)
                number -= 1

        return _batches(rows(), schema)

    placed = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, ddl), "packed")
    open_ = placed.where("sequence_id is null")
    tokens = open_.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = 1 + tokens // (max_tokens * TAIL_SEQUENCES)
    dealt = open_.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return placed.where("sequence_id is not null").unionByName(dealt.mapInArrow(second, ddl))
