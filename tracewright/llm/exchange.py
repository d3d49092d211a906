"""A counting exchange for large sets of 64-bit keys.

Each block of texts sends its distinct keys, sorted and cut into buckets by their first bits, with a
value each; buckets meet in a task, which decides a byte for every key sent; the bytes come back in
the order of the keys, one file per input partition, so that a later pass over the same partitions
finds the answer for each key by its place. Keys never become rows, a key that is everywhere counts
once per block, and nothing but rows of bookkeeping reaches the driver.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import storage
from .words import BLOCK, Block, blocks, trim

Decide = Callable[[np.ndarray, np.ndarray], np.ndarray]
Summarise = Callable[[np.ndarray, np.ndarray, np.ndarray], object]


def total_capped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each key, 255 at most, for every sender."""
    sums = np.minimum(np.add.reduceat(values, starts), 255)
    return np.repeat(sums, np.diff(np.append(starts, len(values)))).astype(np.uint8)


def beaten(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 where another sender of the key has a smaller value."""
    least = np.minimum.reduceat(values, starts)
    return (values > np.repeat(least, np.diff(np.append(starts, len(values))))).astype(np.uint8)


class Answers:
    """The bytes for the keys of the blocks of one input partition."""

    def __init__(self, place: str, part: int, kind: type = np.uint8):
        self.kind = kind
        try:
            self.by_block: dict[int, tuple[int, bytes]] = pickle.loads(storage.read_file(f"{place}/{part:06d}.bin"))
        except FileNotFoundError:  # a partition without keys
            self.by_block = {}

    def of(self, number: int, block: Block, n_keys: int) -> np.ndarray:
        sign, data = self.by_block.get(number, (None, b""))
        found = np.frombuffer(zlib.decompress(data), self.kind) if data and n_keys else np.zeros(0, self.kind)
        if len(found) != n_keys or n_keys and sign != block.sign():
            raise RuntimeError("the input changed between two passes over it")
        return found


def numbered(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK) -> Iterator[tuple[int, int, Block]]:
    """(partition, number, block) of the blocks of columns doc_id and text."""
    part = TaskContext.get().partitionId()
    for number, block in enumerate(blocks(batches, "doc_id", "text", block_bytes)):
        yield part, number, block
    trim()


def exchange(docs: DataFrame, keys_of: Callable[[int, int, Block], tuple[np.ndarray, np.ndarray]], decide: Decide, name: str, wide: bool = False, answer: type = np.uint8, summarise: Summarise | None = None, block_bytes: int = BLOCK) -> str:
    """Runs the exchange over a frame of doc_id and text; returns the place of the answers.

    keys_of gives sorted distinct keys and their values (unsigned bytes, or 64-bit integers if wide).
    wide: whole keys are compared; else the bucket and 32 bits more, where equal keys always meet and
    different ones seldom do. summarise: gives an object of bounded size from each bucket's values,
    starts of keys and keys (whole ones if wide); ``summaries`` reads them.
    """
    spark = docs.sparkSession
    place = storage.scratch(spark, name)
    bits = max(4, (4 * storage.shuffle_partitions(spark) - 1).bit_length())
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    value_type = np.int64 if wide else np.uint8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, block in numbered(batches, block_bytes):
            keys, values = keys_of(part, number, block)
            if not len(keys):
                continue
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            payload = keys if wide else ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            values = values.astype(value_type)
            sign = block.sign()
            rows = [(b, part, number, sign, payload[x:y].tobytes(), values[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "part", "block", "sign", "keys", "vals"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64 if wide else np.uint32) for k in group["keys"]])
        values = np.concatenate([np.frombuffer(v, value_type) for v in group["vals"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        values = values[order].astype(np.int64)
        answers = np.empty(len(keys), answer)
        answers[order] = decide(values, starts)
        sizes = [len(k) // (8 if wide else 4) for k in group["keys"]]
        cut = np.split(answers, np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"part": group["part"], "block": group["block"], "sign": group["sign"], "bucket": group["bucket"], "answers": [zlib.compress(c.tobytes(), 1) for c in cut]})
        if summarise:
            out.loc[len(out)] = [-1, 0, 0, group["bucket"].iloc[0], zlib.compress(pickle.dumps(summarise(values, starts, keys[starts])), 1)]
        return out

    def store(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            storage.write_file(f"{place}/summaries.bin", pickle.dumps([pickle.loads(zlib.decompress(x)) for x in group["answers"]]))
            return pd.DataFrame({"part": [key[0]]})
        by_block: dict[tuple[int, int], list[bytes]] = {}
        for block, sign, _, data in sorted(zip(group["block"], group["sign"], group["bucket"], group["answers"])):
            by_block.setdefault((int(block), int(sign)), []).append(zlib.decompress(data))
        held = {block: (sign, zlib.compress(b"".join(parts), 1)) for (block, sign), parts in by_block.items()}
        storage.write_file(f"{place}/{key[0]:06d}.bin", pickle.dumps(held))
        trim()
        return pd.DataFrame({"part": [key[0]]})

    sent = docs.mapInArrow(send, "bucket int, part int, block int, sign long, keys binary, vals binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "part int, block int, sign long, bucket int, answers binary")
    met.groupBy("part").applyInPandas(store, "part int").write.format("noop").mode("overwrite").save()
    return place


def summaries(place: str) -> list:
    """What ``summarise`` gave, an object for each bucket."""
    try:
        return pickle.loads(storage.read_file(f"{place}/summaries.bin"))
    except FileNotFoundError:
        return []
