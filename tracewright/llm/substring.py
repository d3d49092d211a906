"""Removal of passages that repeat across documents, located by Aho-Corasick automata.

A window is ``window`` consecutive words. Of each window the ``seed``-word phrase with the least hash
stands for it, so equal windows have equal phrases. Phrases that occur in two documents or more are
confirmed by an exchange over all documents. Each block of documents compiles its recurring phrases
into an automaton (a shard, bounded by the block), and streams its documents through it, every word as
one character, to locate all occurrences. Only windows that hold an occurrence are candidates; they
are compared over all documents by 64-bit hashes of their words, and a window that also starts in a
document with a smaller id is removed, word by word. Which windows were located is noted in the shared
folder, so the last pass needs no automaton.

Null and empty texts have no words; texts shorter than a window keep all of them. Rows with equal ids
count as one document; texts without an id keep all words and remove none. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .exchange import Answers, beaten, exchange, numbered, total_capped
from .storage import as_scan
from .words import AS_IS, Block, inside_one, window_hashes


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """The windows of a block: where they start, and the phrase that stands for each."""

    def __init__(self, block: Block, window: int, seed: int):
        self.window, self.seed = window, seed
        self.hashes, self.bounds = block.words(AS_IS)
        self.phrases = window_hashes(self.hashes, seed)
        n = max(0, len(self.hashes) - window + 1)
        self.starts = np.flatnonzero(inside_one(self.bounds, window, n)) if n else np.zeros(0, np.int64)
        least = _sliding_min(self.phrases, window - seed + 1) if n else self.phrases[:0]
        self.least = least[self.starts]
        self.doc = np.searchsorted(self.bounds, self.starts, side="right") - 1
        if not block.known.all():  # texts without an id take no part
            used = block.known[self.doc]
            self.starts, self.least, self.doc = self.starts[used], self.least[used], self.doc[used]

    def phrase_keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases that stand for windows, and in how many documents each does, 2 at most."""
        if not len(self.least):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        doc = ids[self.doc]
        new = np.append(True, (self.least[1:] != self.least[:-1]) | (doc[1:] != doc[:-1]))
        phrase, doc = self.least[new], doc[new]
        order = np.lexsort((doc, phrase))
        phrase, doc = phrase[order], doc[order]
        pair = np.append(True, (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1]))
        keys, counts = np.unique(phrase[pair], return_counts=True)
        return keys, np.minimum(counts, 2)

    def locate(self, recurring: np.ndarray) -> np.ndarray:
        """Which windows hold an occurrence of a recurring phrase; the automaton alone locates them."""
        found = np.zeros(len(self.starts), bool)
        if not len(recurring):
            return found
        code = self.hashes % np.uint64(0x110000 - 0x801) + np.uint64(1)
        code[code >= 0xD800] += np.uint64(0x800)
        text = code.astype("<u4").tobytes().decode("utf-32-le")
        values, first = np.unique(self.least, return_index=True)
        shown = np.searchsorted(values, recurring)
        width = self.window - self.seed + 1
        begin = self.starts[first[shown]]
        places = begin + np.lib.stride_tricks.sliding_window_view(self.phrases, width)[begin].argmin(axis=1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in places.tolist():
            automaton.add_word(text[p : p + self.seed])
        automaton.make_automaton()
        starts = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) - (self.seed - 1)
        total = np.zeros(len(self.hashes) + 1, np.int64)
        total[1:] = np.cumsum(np.bincount(starts, minlength=len(self.hashes)))
        return total[self.starts + width] > total[self.starts]

    def window_keys(self, ids: np.ndarray, located: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct located windows, the smallest id with each, and the key number of each located window."""
        whole = window_hashes(self.hashes, self.window)[self.starts[located]] if located.any() else np.zeros(0, np.uint64)
        keys, number = np.unique(whole, return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids[self.doc[located]])
        return keys, least, number


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text: words joined by one space)."""
    given = as_scan(docs, "documents", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def phrase_keys(part: int, number: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
        return Windows(block, window, seed).phrase_keys(block.ids)

    phrases = exchange(given, phrase_keys, total_capped, "phrases")
    held: dict = {}  # answers of the partition at hand
    places = storage.scratch(given.sparkSession, "located")

    def window_keys(part: int, number: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
        if held.get("part") != part:
            held.update(part=part, answers=Answers(phrases, part))
        w = Windows(block, window, seed)
        keys, _ = w.phrase_keys(block.ids)
        found = w.locate(keys[held["answers"].of(number, block, len(keys)) >= 2])
        storage.write_file(f"{places}/{part:06d}-{number:06d}.bin", zlib.compress(np.packbits(found).tobytes(), 1))
        return w.window_keys(block.ids, found)[:2]

    def located(part: int, number: int, w: Windows) -> np.ndarray:
        bits = np.frombuffer(zlib.decompress(storage.read_file(f"{places}/{part:06d}-{number:06d}.bin")), np.uint8)
        return np.unpackbits(bits, count=len(w.starts)).astype(bool)

    smaller = exchange(given, window_keys, beaten, "windows", wide=True)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = None
        for part, number, block in numbered(batches):
            answers = answers or Answers(smaller, part)
            w = Windows(block, window, seed)
            found = located(part, number, w)
            keys, least, key = w.window_keys(block.ids, found)
            gone = (answers.of(number, block, len(keys))[key] > 0) | (block.ids[w.doc[found]] > least[key])
            starts = w.starts[found][gone]
            steps = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + window, -1)
            covered = np.cumsum(steps[:-1]) > 0
            n_words = np.diff(w.bounds)
            total = np.append(0, np.cumsum(covered))
            n_removed = total[w.bounds[1:]] - total[w.bounds[:-1]]
            texts = []
            for i in range(len(n_words)):
                words = block.text(i).split()
                if n_removed[i]:
                    kept = ~covered[w.bounds[i] : w.bounds[i + 1]]
                    words = [x for x, k in zip(words, kept.tolist()) if k]
                texts.append(b" ".join(words))
            columns = [block.id_column(), n_words, n_removed, [hashlib.sha256(t).hexdigest() for t in texts], *([[t.decode() for t in texts]] if with_text else [])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return given.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
