"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Items go into
automata of bounded size, built on the executors. Documents stream through: the automaton keeps the
longest suffix of the words so far that is part of an item. A window is ``window`` consecutive words
of an item; an item of fewer, but not none, is one window. Every document word in an occurrence of a
window is hit; runs of hit words are spans, which are removed where they exceed the length or
coverage limits.

Null and empty texts have no words and are clean. Items without words have no windows. Repeated rows
are judged each for itself; repeated item ids count once. An empty benchmark hits nothing. Input
columns named like a result, in any case of letters, give way to it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .words import ALNUM_LOWERED, PIECE, Block, hash_spans, spans, text_buffer, trim

#: Characters of items in one automaton, about; bounds what a worker holds.
SHARD_CHARS = 1 << 20

RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first:long,last:long>>, clean_text string"
_loaded: dict[str, "Automaton"] = {}


class Automaton:
    """Suffix automaton over the word numbers of several items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        words = [h for _, h in items if len(h)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.shortest = min((min(len(h), window) for h in words), default=0)
        self.length, self.link, self.next = [0], [-1], [{}]
        self.names: list[str] = []
        sequences = []
        for name, hashes in items:
            if len(hashes):
                self.names.append(name)
                sequences.append(np.searchsorted(self.vocabulary, hashes).tolist())
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self._mark(sequences)

    def _clone(self, state: int, length: int) -> int:
        self.length.append(length)
        self.link.append(self.link[state])
        self.next.append(dict(self.next[state]))
        return len(self.length) - 1

    def _redirect(self, at: int, word: int, old: int, new: int) -> None:
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another item has this already
            if self.length[known] == self.length[last] + 1:
                return known
            copy = self._clone(known, self.length[last] + 1)
            self.link[known] = copy
            self._redirect(last, word, known, copy)
            return copy
        state = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.next.append({})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            if self.length[target] == self.length[at] + 1:
                self.link[state] = target
            else:
                copy = self._clone(target, self.length[at] + 1)
                self.link[target] = self.link[state] = copy
                self._redirect(at, word, target, copy)
        return state

    def _mark(self, sequences: list[list[int]]) -> None:
        """The state of the last ``window`` words of each state, the items with that window, and whole short items."""
        w = self.window
        self.tail = [0] * len(self.length)
        self.whole: list[int] = [0] * len(self.length)
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        self.holders: dict[int, set[int]] = {}
        for i, sequence in enumerate(sequences):
            if len(sequence) < w:
                state = 0
                for word in sequence:
                    state = self.next[state][word]
                self.shorts.setdefault(state, []).append((len(sequence), i))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= w:
                self.tail[state] = state if self.length[up] < w else self.tail[up]
            self.whole[state] = state if state in self.shorts else self.whole[up]
        for i, sequence in enumerate(sequences):
            state = 0
            for n, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if n >= w:
                    self.holders.setdefault(self.tail[state], set()).add(i)

    def follow(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans (first, after last) of a run of known words, and the items found."""
        hit: list[list[int]] = []
        found: set[int] = set()
        length, link, nexts, w = self.length, self.link, self.next, self.window
        seen: set[int] = set()  # states whose items are found
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            reach = 0
            if matched >= w:
                reach = w
                seen.add(self.tail[state])
            whole = self.whole[state]
            while whole:
                for n, item in self.shorts[whole]:
                    if n <= matched:
                        reach = max(reach, n)
                        found.add(item)
                whole = self.whole[link[whole]]
            if reach:
                first = i + 1 - reach
                while hit and hit[-1][1] >= first:
                    first = min(first, hit.pop()[0])
                hit.append([first, i + 1])
        return [(a, b) for a, b in hit], found.union(*(self.holders[s] for s in seen))


def build_automata(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> list[str]:
    """Files of the automata in the shared folder, one for each SHARD_CHARS of items."""
    spark = benchmark.sparkSession
    place = storage.scratch(spark, "automata")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 + chars // SHARD_CHARS

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        raw, offsets = text_buffer(pa.array(group["text"], pa.string()))
        starts, ends = spans(raw, offsets, ALNUM_LOWERED)
        hashes = hash_spans(raw, starts, ends, ALNUM_LOWERED)
        bounds = np.searchsorted(starts, offsets)
        made = Automaton([("" if item is None else item, hashes[a:b]) for item, a, b in zip(group["item"], bounds[:-1], bounds[1:])], window)
        storage.write_file(f"{place}/{key[0]:06d}.automaton", pickle.dumps(made, protocol=5))
        return pd.DataFrame({"path": [f"{place}/{key[0]:06d}.automaton"]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    return sorted(r.path for r in dealt.groupBy("shard").applyInPandas(build, "path string").collect())  # a row for each shard


def _automaton(path: str, many: bool) -> Automaton:
    if path not in _loaded:
        if many:
            _loaded.clear()  # one at a time
        _loaded[path] = pickle.loads(storage.read_file(path))
    return _loaded[path]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 1.0, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean: bool = False) -> DataFrame:
    """The documents with the RESULT columns.

    spans: runs of hit words, as word numbers. clean: also give clean_text, which lacks the spans of
    ``min_span`` words or more; null where more than ``max_coverage`` of the words are hit.
    """
    paths = build_automata(benchmark, window, item_col, item_text_col)
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in names and (clean or c.lower() != text_col.lower())]
    given = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).alias("_text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), RESULT])

    def overlaps(block: Block) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]], np.ndarray, np.ndarray]:
        starts, ends = spans(block.raw, block.offsets, ALNUM_LOWERED)
        hashes = hash_spans(block.raw, starts, ends, ALNUM_LOWERED)
        bounds = np.searchsorted(starts, block.offsets)
        n = len(bounds) - 1
        hit: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        found: list[set[str]] = [set() for _ in range(n)]
        for path in paths:
            automaton = _automaton(path, len(paths) > 1)
            if not len(automaton.vocabulary) or not len(hashes):
                continue
            number = np.searchsorted(automaton.vocabulary, hashes)
            number[number == len(automaton.vocabulary)] = 0
            known = automaton.vocabulary[number] == hashes
            first = known.copy()
            first[1:] &= ~known[:-1]
            last = known.copy()
            last[:-1] &= ~known[1:]
            cuts = bounds[(bounds > 0) & (bounds < len(known))]
            first[cuts] = known[cuts]
            last[cuts - 1] = known[cuts - 1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            long_ = b - a >= automaton.shortest
            a, b = a[long_], b[long_]
            of = np.searchsorted(bounds, a, side="right") - 1
            for low, high, doc in zip(a.tolist(), b.tolist(), of.tolist()):
                here, items = automaton.follow(number[low:high].tolist())
                if here:
                    base = low - int(bounds[doc])
                    hit[doc] += [(base + x, base + y) for x, y in here]
                    found[doc] |= {automaton.names[i] for i in items}
        return bounds, [_merged(x) for x in hit], found, starts, ends

    limit = 2 * PIECE if len(paths) == 1 else 64 * PIECE  # automata that take turns are loaded once for more text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.num_columns - 1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
                to = min(to, batch.num_rows)
                block = Block(np.zeros(0), np.zeros(0, bool), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                bounds, hit, found, starts, ends = overlaps(block)
                n_words = np.diff(bounds)
                texts = []
                for i in range(to - at) if clean else ():
                    covered = sum(y - x for x, y in hit[i])
                    cut = [(x, y) for x, y in hit[i] if y - x >= min_span]
                    if covered > max_coverage * n_words[i]:
                        texts.append(None)
                    elif not cut:
                        texts.append(block.text(i).decode())
                    else:
                        texts.append(_without(block, i, int(bounds[i]), cut, starts, ends))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array(n_words, pa.int64()),
                        pa.array([sum(y - x for x, y in h) for h in hit], pa.int64()),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                        pa.array([[{"first": x, "last": y - 1} for x, y in h] for h in hit], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        pa.array(texts if clean else [None] * (to - at), pa.string()),
                    ],
                    names=[*part.schema.names[:-1], *names],
                )
                at = to
        batch = raw = block = part = None
        trim()

    return given.mapInArrow(run, ddl)


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(block: Block, i: int, base: int, cut: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the given runs of words."""
    low = int(block.offsets[i])
    text = block.text(i)
    out, at = [], 0
    for a, b in cut:
        out.append(text[at : int(starts[base + a]) - low])
        at = int(ends[base + b - 1]) - low
    return b"".join([*out, text[at:]]).decode()


def items_digest(items: str = "items") -> F.Column:
    """sha256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
