"""Words of texts as numpy arrays of 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over its bytes, taken from prefix sums: with ``C`` the running sum of
``byte[i] * B**i``, the bytes ``s..e`` hash to ``(C[e] - C[s]) * B**-s`` in arithmetic modulo 2**64.
The same step over word hashes gives hashes of word windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at separators, longer words extend a piece.
PIECE = 1 << 19
#: Bytes of text in a block; one longer text is a block of its own.
BLOCK = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def trim() -> None:
    """Gives freed memory back to the system, so that idle workers hold little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separator_ranges: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """Value of each byte in a word (never 0), 0 for separators. lower: A-Z count as a-z."""
    table = np.arange(1, 257, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    for first, last in separator_ranges:
        table[first : last + 1] = 0
    return table


#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACES = [(0x20, 0x20), (0x09, 0x0D)]
#: Words of letters, digits and all non-ASCII characters, for lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
AS_IS = byte_table(SPACES, lower=False)
LOWERED = byte_table(SPACES, lower=True)
ALNUM_LOWERED = byte_table(NOT_ALNUM, lower=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, as places in raw; words end at the ends of texts too."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (table != 0)[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at the given places, piece by piece."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + PIECE)))
        high = int(ends[to - 1])
        up, down = _power_table(_BASE, high - low + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[raw[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mixed(out)


class Block:
    """Texts of some consecutive rows, at most BLOCK bytes or one text."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        """ids: 0 where there is none; known: where there is one."""
        self.ids, self.known, self.raw, self.offsets = ids, known, raw, offsets

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.known)

    def sign(self) -> int:
        """Tells blocks of other rows or texts apart."""
        return zlib.crc32(self.ids.tobytes(), zlib.crc32(self.offsets.tobytes()))

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): text i has the words bounds[i]..bounds[i+1]."""
        starts, ends = spans(self.raw, self.offsets, table)
        return hash_spans(self.raw, starts, ends, table), np.searchsorted(starts, self.offsets)

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, limit: int = BLOCK) -> Iterator[Block]:
    """Cuts a partition into blocks that depend on its rows only, not on how Arrow batches them."""
    ids: list[np.ndarray] = []
    known: list[np.ndarray] = []
    raws: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = 0

    def made() -> Block:
        sizes = np.concatenate(lengths)
        return Block(np.concatenate(ids), np.concatenate(known), np.concatenate(raws), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))

    for batch in batches:
        raw, offsets = text_buffer(batch.column(text_col))
        there = batch.column(id_col).is_valid().to_numpy(zero_copy_only=False)
        keys = np.asarray(batch.column(id_col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at = 0
        while at < len(keys):
            to = int(np.searchsorted(offsets, offsets[at] + limit - held, side="right")) - 1
            to = min(max(to, at), len(keys))
            if to == at and not held:
                to = at + 1
            if to > at:
                ids.append(keys[at:to])
                known.append(there[at:to])
                raws.append(raw[offsets[at] : offsets[to]])
                lengths.append(np.diff(offsets[at : to + 1]))
                held += int(offsets[to] - offsets[at])
                at = to
            if at < len(keys) or held >= limit:
                yield made()
                ids, known, raws, lengths, held = [], [], [], [], 0
    if ids:
        yield made()


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, over document ends too; place i is the window that starts there."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = PIECE
    up, down = _power_table(_WINDOW_BASE, step + k + 1)
    for low in range(0, n, step):
        part = hashes[low : min(low + step, n) + k - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[low : low + m] = (sums[k : k + m] - sums[:m]) * down[:m]
    return mixed(out)


def inside_one(bounds: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """Which windows of k words lie in one text."""
    ok = np.ones(n_windows, bool)
    for back in range(1, k):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def owner(bounds: np.ndarray) -> np.ndarray:
    """Number of the text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
