"""Token ids of whole texts with the tokenizers library, one encoding per distinct word and worker.

The library encodes a text piece by piece, and no piece spans a step from another character to white
space, so texts are cut there and distinct cuts are kept encoded. A cut of Latin letters with
trailing ASCII punctuation goes straight to the library's BPE model; any other cut, and texts with
unusual white space or one of the vocabulary's added tokens, go through the full encoder.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .words import text_buffer

#: Cached words in each of two generations; the older one goes when the newer is full.
CACHE_WORDS = 800_000
#: The same of a lean encoder, and its marks of words met once, by hash: it caches a word met again, as most never come again.
LEAN_WORDS, MARKS = 300_000, 1 << 22
#: Bytes of text taken from a column at once.
SLICE = 1 << 20

_CUT = re.compile("[ \n]*[^ \n]+|[ \n]+")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
_loaded: dict[tuple[str, bool], "WordEncoder"] = {}

#: Bytes that may begin white space other than space and line feed, or a control character.
_ODD = np.zeros(256, bool)
_ODD[[*range(0, 10), *range(11, 32), 0x7F, 0xE1, 0xE2, 0xE3]] = True


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """name: a file of public_tokenizers, or a path. Ids are at most 65,535 in the cache, as 16-bit integers.

    lean: a quarter of the cache's memory, for a tenth more time.
    """

    def __init__(self, name: str, lean: bool = False):
        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids are supported")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.spaced = "word" not in name.rpartition("/")[2]  # white space is part of tokens
        self.space = self.letters[0x20] if self.spaced else ""
        self.cache: dict[str, bytes] = {}  # a key stands for the word after a space
        self.older: dict[str, bytes] = {}
        self.most = LEAN_WORDS if lean else CACHE_WORDS
        self.met = bytearray(MARKS) if lean else None
        self.bare: dict[str, bytes] = {}  # words and punctuation without a space before them

    def _full(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, shown: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _letters(self, word: str) -> str:
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def _bare(self, part: str) -> bytes:
        """A word of letters or a run of punctuation, as it stands."""
        known = self.bare.get(part)
        if known is None:
            if len(self.bare) >= CACHE_WORDS // 8:
                self.bare.clear()
            known = self.bare[part] = self._model(self._letters(part))
        return known

    def _known(self, word: str) -> bytes:
        known = self.cache.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                known = self._missing(word)
                if self.met is not None:
                    at = hash(word) & MARKS - 1
                    if not self.met[at]:
                        self.met[at] = 1
                        return known
            if len(self.cache) >= self.most:
                self.older, self.cache = self.cache, {}
                self.met = None if self.met is None else bytearray(MARKS)
            self.cache[word] = known
        return known

    def _missing(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return self._full(f" {word}" if self.spaced else word)
        base, marks = plain.groups()
        if marks:
            return self._known(base) + self._bare(marks)
        if not self.spaced and (low := base.lower()) != base:
            return self._known(low)
        return self._model(self.space + self._letters(base))

    def _first(self, cut: str) -> bytes:
        """A cut that doesn't begin with a space."""
        plain = _PLAIN.fullmatch(cut)
        if plain is None:
            return self._full(cut)
        return self._bare(plain[1]) + (self._bare(plain[2]) if plain[2] else b"")

    def _lines(self, part: str) -> bytes:
        """Words with single line feeds between them, after a space."""
        first, *rest = part.split("\n")
        feed = self._bare_feed()
        return self._known(first) + b"".join([feed + self._first(x) for x in rest])

    def _bare_feed(self) -> bytes:
        return self._bare_of("\n")

    def _bare_of(self, text: str) -> bytes:
        known = self.bare.get(text)
        if known is None:
            known = self.bare[text] = self._full(text)
        return known

    def _parts(self, text: str) -> bytes:
        """A text with no white space but spaces and line feeds."""
        if not self.spaced:
            words = text.split()
            found = list(map(self.cache.get, words))
        elif "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n" or text[0] in " \n":
            return b"".join([self._known(c[1:]) if c[0] == " " and c[1:].strip(" \n") == c[1:] else self._full(c) for c in _CUT.findall(text)])
        else:
            words = text.split(" ")
            found = list(map(self.cache.get, words))
            first = words[0]
            found[0] = self._first(first) if "\n" not in first else b"".join([(self._bare_feed() if i else b"") + self._first(x) for i, x in enumerate(first.split("\n"))])
        if None in found:
            known, lines = self._known, self._lines
            found = [ids if ids is not None else lines(w) if "\n" in w else known(w) for w, ids in zip(words, found)]
        return b"".join(found)

    def encode(self, text: str | None, odd: bool | None = None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; null counts as empty. odd: the text may hold unusual white space."""
        if not text:
            return np.zeros(0, "<u4")
        if odd is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            odd = bool(_odd(raw).size)
        odd = odd or any(x in text for x in self.added)
        return np.frombuffer(self._full(text) if odd else self._parts(text), "<u2").astype("<u4")

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        raw, offsets = text_buffer(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            odd = np.diff(np.searchsorted(_odd(raw[offsets[at] : offsets[to]]), offsets[at : to + 1] - offsets[at])) > 0
            for text, strange in zip(column.slice(at, to - at).to_pylist(), odd.tolist()):
                yield self.encode(text, strange)
            at = to


def _odd(raw: np.ndarray) -> np.ndarray:
    """Places of bytes that may belong to unusual white space."""
    found = np.flatnonzero(_ODD[raw])
    latin = np.flatnonzero(raw == 0xC2)
    after = raw[np.minimum(latin + 1, len(raw) - 1)] if len(raw) else latin
    latin = latin[(after <= 0x9F) | (after == 0xA0)]
    return np.sort(np.concatenate([found, latin])) if len(latin) else found


def encoder(name: str, lean: bool = False) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    if (name, lean) not in _loaded:
        _loaded[name, lean] = WordEncoder(name, lean)
    return _loaded[name, lean]
