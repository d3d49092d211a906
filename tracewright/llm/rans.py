"""Token files coded with a static range asymmetric numeral system (rANS).

A folder holds shards in ascending document order and a manifest. A shard has one frequency table,
shared by all its blocks, and blocks of a fixed number of ids. A block is coded on its own by
interleaved 64-bit states with 32-bit renormalisation; its index entry is a checkpoint (first id,
place of its words, states), and a checksum of its ids, so blocks decode in parallel or alone.

Null texts count as empty and give only the end id. Rows with equal ids stay together in the order
of their texts. Null ids come first. An empty table gives a folder without shards.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .tokens import encoder

MAGIC = b"TWRANS01"
BLOCK_IDS = 16_384
LANES = 32
#: Blocks coded in one numpy step.
GROUP = 128
#: Ids in a shard at most.
SHARD_IDS = 1 << 24
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
    there = np.flatnonzero(counts)
    if not len(there):
        return np.zeros(len(counts), np.int64), 16
    bits = max(16, int(len(there) - 1).bit_length() + 2)
    size = 1 << bits
    out = np.zeros(len(counts), np.int64)
    exact = counts[there] * (size / counts.sum())
    out[there] = np.maximum(1, exact.astype(np.int64))
    order = there[np.argsort(-out[there], kind="stable")]
    gap = size - int(out.sum())
    if gap > 0:
        out[order[0]] += gap
    while gap < 0:
        takes = np.minimum(out[order] - 1, np.maximum(1, -gap * out[order] // size))
        before = np.cumsum(takes) - takes
        takes = np.clip(-gap - before, 0, takes)
        out[order] -= takes
        gap += int(takes.sum())
    return out, bits


class Table:
    """The frequency table of a shard."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.starts = (np.cumsum(freq) - freq).astype(np.uint64)
        self.most = (np.uint64(1 << (63 - bits)) * self.freq) if bits else self.freq

    def encode(self, ids: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(states, words) of each block; ids: blocks in rows, a whole number of LANES each."""
        n = len(ids)
        steps = ids.shape[1] // LANES
        lanes = ids.reshape(n, steps, LANES)
        state = np.full((n, LANES), _LOW, np.uint64)
        words = np.empty((steps, n, LANES), np.uint32)
        sent = np.empty((steps, n, LANES), bool)
        bits = np.uint64(self.bits)
        for t in range(steps - 1, -1, -1):
            s = lanes[:, t]
            f = self.freq[s]
            over = state >= self.most[s]
            words[t] = state.astype(np.uint32)
            sent[t] = over
            state = np.where(over, state >> _32, state)
            q = state // f
            state = (q << bits) + (state - q * f) + self.starts[s]
        return [(state[b].astype("<u8").tobytes(), words[:, b][sent[:, b]].astype("<u4").tobytes()) for b in range(n)]

    def decode(self, states: np.ndarray, words: np.ndarray, at: np.ndarray, n_ids: int, slots: np.ndarray) -> np.ndarray:
        """Ids of blocks of equal size; words: those of all blocks, at: where each block's begin."""
        steps = n_ids // LANES
        out = np.empty((len(states), steps, LANES), np.uint32)
        state, at = states.copy(), at.copy()
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        for t in range(steps):
            slot = state & mask
            s = slots[slot]
            out[:, t] = s
            state = self.freq[s] * (state >> bits) + slot - self.starts[s]
            low = state < _LOW
            rank = np.cumsum(low, axis=1)
            word = words[np.where(low, at[:, None] + rank - 1, 0)]
            state = np.where(low, (state << _32) | word, state)
            at += rank[:, -1]
        return out.reshape(len(states), -1)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole shard file. Layout: magic, header length, header (JSON), doc ids, lengths, table, block index, words."""
    table = Table(*quantised(np.bincount(ids, minlength=1).astype(np.int64)))
    size = -(-len(ids) // BLOCK_IDS)
    padded = np.zeros(size * BLOCK_IDS, np.uint32)
    padded[: len(ids)] = ids
    if len(ids) < len(padded) and len(ids):
        padded[len(ids) :] = ids[-1]
    blocks = padded.reshape(size, BLOCK_IDS)
    states: list[bytes] = []
    words: list[bytes] = []
    for g in range(0, size, GROUP):
        for state, word in table.encode(blocks[g : g + GROUP]):
            states.append(state)
            words.append(word)
    index = np.zeros(size, [("first", "<u8"), ("n", "<u4"), ("word", "<u8"), ("crc", "<u4")])
    index["first"] = np.arange(size) * BLOCK_IDS
    index["n"] = np.minimum(BLOCK_IDS, len(ids) - np.arange(size) * BLOCK_IDS)
    sizes = np.array([len(w) // 4 for w in words], np.int64)
    index["word"] = np.cumsum(sizes) - sizes
    index["crc"] = [zlib.crc32(ids[b * BLOCK_IDS : (b + 1) * BLOCK_IDS].astype("<u4").tobytes()) for b in range(size)]
    there = np.flatnonzero(table.freq)
    parts = [
        zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes(), 1),
        zlib.compress(lengths.astype("<u8").tobytes(), 1),
        zlib.compress(there.astype("<u4").tobytes() + table.freq[there].astype("<u4").tobytes(), 6),
        index.tobytes(),
        b"".join(states),
        b"".join(words),
    ]
    body = b"".join(parts)
    header = json.dumps({"bits": table.bits, "n_docs": len(doc_ids), "n_ids": len(ids), "n_symbols": len(there), "blocks": size, "lanes": LANES, "block_ids": BLOCK_IDS, "parts": [len(p) for p in parts], "crc": zlib.crc32(body[: sum(map(len, parts[:5]))])}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + body


class Shard:
    """A shard opened for reading; blocks are read and decoded when asked for."""

    def __init__(self, source):
        self.source = source
        if source.read(8) != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack("<I", source.read(4))
        self.header = h = json.loads(source.read(n))
        raw = [source.read(size) for size in h["parts"][:5]]
        if zlib.crc32(b"".join(raw)) != h["crc"]:
            raise ValueError("a shard's header is damaged")
        self.words_at = source.tell()
        self.doc_ids = np.cumsum(np.frombuffer(zlib.decompress(raw[0]), "<i8"))
        self.lengths = np.frombuffer(zlib.decompress(raw[1]), "<u8").astype(np.int64)
        symbols = np.frombuffer(zlib.decompress(raw[2]), "<u4")
        there, freq = np.split(symbols, 2)
        whole = np.zeros(int(there[-1]) + 1 if len(there) else 1, np.int64)
        whole[there] = freq
        self.table = Table(whole, h["bits"])
        self.slots = self.table.slots()
        self.index = np.frombuffer(raw[3], [("first", "<u8"), ("n", "<u4"), ("word", "<u8"), ("crc", "<u4")])
        self.states = np.frombuffer(raw[4], "<u8").reshape(-1, h["lanes"])
        self.n_words = h["parts"][5] // 4

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks first..last-1; raises where a checksum differs."""
        low = int(self.index["word"][first])
        high = int(self.index["word"][last]) if last < len(self.index) else self.n_words
        self.source.seek(self.words_at + 4 * low)
        words = np.frombuffer(self.source.read(4 * (high - low)), "<u4")
        at = self.index["word"][first:last].astype(np.int64) - low
        ids = self.table.decode(self.states[first:last], words, at, self.header["block_ids"], self.slots)
        out = [row[:n] for row, n in zip(ids, self.index["n"][first:last])]
        for row, crc in zip(out, self.index["crc"][first:last]):
            if zlib.crc32(row.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum differs")
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(document, parts of its ids) in order; holds one group of blocks at a time."""
        group, at, done = np.zeros(0, np.uint32), 0, 0
        for doc, length in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            parts = []
            while length:
                if at == len(group):
                    to = min(done + GROUP, len(self.index))
                    group, at, done = self.blocks(done, to), 0, to
                part = group[at : at + length]
                parts.append(part)
                at += len(part)
                length -= len(part)
            yield doc, parts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts and writes shards in ascending document order, then the manifest."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        names: list[tuple] = []
        docs_, sizes, held, total = [], [], [], 0

        def flush() -> None:
            nonlocal docs_, sizes, held, total
            if docs_:
                name = f"part-{part:06d}-{len(names):04d}.rans"
                storage.write_file(f"{path}/{name}", encode_shard(np.array(docs_, np.int64), np.array(sizes, np.int64), np.concatenate(held)))
                names.append((part, len(names), name, len(docs_), total))
            docs_, sizes, held, total = [], [], [], 0

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.encode_column(batch.column(1))):
                if total and total + len(ids) + 1 > SHARD_IDS:
                    flush()
                docs_.append(-(1 << 63) if doc is None else doc)
                sizes.append(len(ids) + 1)
                held.append(np.append(ids, end_id).astype(np.uint16 if end_id < 1 << 16 else np.uint32))
                total += len(ids) + 1
        flush()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*names)], names=["part", "nth", "name", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(shards, "part long, nth long, name string, docs long, ids long").collect()  # a row for each shard
    start, manifest = 0, []
    for r in sorted(made, key=lambda r: (r.part, r.nth)):
        manifest.append({"name": r.name, "start": start, "docs": r.docs, "ids": r.ids})
        start += r.ids
    storage.write_file(f"{path}/manifest.json", json.dumps({"shards": manifest, "ids": start}).encode())


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (and ids), shards in parallel."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])
    shards = [(s["name"], s["start"]) for s in json.loads(storage.read_file(f"{path}/manifest.json"))["shards"]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with storage.open_input(f"{path}/{name}") as source:
                    rows = []
                    for doc, parts in Shard(source).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        n = sum(map(len, parts))
                        rows.append((None if doc == -(1 << 63) else doc, start, n, crc, *([np.concatenate(parts)] if with_ids else [])))
                        start += n
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    listed = spark.createDataFrame(shards, "name string, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
