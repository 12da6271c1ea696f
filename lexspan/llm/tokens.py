"""Token ids of whole texts, with a cache of the ids of words.

A text is cut where the tokenizer itself can't join: at single spaces and line ends between other
characters, and between letters and the punctuation behind them. The ids of the parts don't depend on
each other, so they are looked up in a cache, and only unseen parts go to the tokenizer. A text with
other white space, or with the content of one of the tokenizer's added tokens, in its own spelling or
once it is in lower case, goes to it whole. Words of ASCII letters, which no normaliser or pattern can
cut, go to the tokenizer's model alone. Letters are parted from punctuation only where they are
`PLAIN`, letters that stay letters whatever a tokenizer's normaliser does. The ids are those of
encoding the text at once; the tests hold both against each other.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array

import numpy as np

#: Parts kept of those used last, and as many of those used before; about 150 bytes each, so 130 MB a worker at most.
CACHE_PARTS = 450_000
#: Ends of parts that are kept.
TAILS = 10_000
#: Parts longer than this aren't kept.
LONGEST = 64
#: Signs that stand behind letters as tokens of their own; not the apostrophe, which can begin a token with letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _stays(c: str) -> bool:
    """Whether a letter stays one letter in composed form and lower case."""
    small = unicodedata.normalize("NFC", c).lower()
    return c.isalpha() and len(small) == 1 and small.isalpha()


#: The letters of Latin alphabets, without such as I with a dot, which becomes a letter and a mark.
PLAIN = frozenset(c for c in map(chr, range(0x250)) if _stays(c))


#: How byte-level tokenizers write a space, and words by which the model is tried.
SPACE = "\u0120"
PROBES = ["a", "Z", "the", "Word", "QUICKLY", "zyxwvutsr", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "thndatinbleble"]


class _Irregular(Exception):
    """A part that can't be encoded by itself."""


class _Parts(dict):
    """Ids of parts, as bytes. glue stands before each part in its text."""

    def __init__(self, encode, glue: str = "", spaced: bool = True, share: int = 0, word=None):
        super().__init__()
        self.word, self.encode, self.glue, self.spaced, self.share, self.older, self.tails = word, encode, glue, spaced, share, {}, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.pop(part, None)
        if ids is None:
            if self.spaced and part.split() != [part]:
                raise _Irregular
            letters = part.rstrip(SIGNS)
            if self.word is not None and part.isascii() and part.isalpha():
                ids = self.word(part)
            elif letters and letters != part and PLAIN.issuperset(letters):
                ids = self[letters] + self._tail(part[len(letters) :])
            else:
                ids = self.encode(self.glue + part)
        if len(part) <= LONGEST:
            if len(self) >= self.share:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _tail(self, signs: str) -> bytes:
        ids = self.tails.get(signs)
        if ids is None:
            ids = self.encode(signs)
            if len(self.tails) < TAILS and len(signs) <= LONGEST:
                self.tails[signs] = ids
        return ids


class Encoder:
    """Encodes texts by a tokenizer file of the `tokenizers` library, without special tokens."""

    def __init__(self, file: str, parts: int = 0):
        from tokenizers import Tokenizer

        parts = parts or CACHE_PARTS

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        # A tokenizer that drops white space yields nothing for a space, and parts need no glue.
        self.drops_space = not len(self._ids(" \n "))
        if self.drops_space:
            self.lowers = all(self._ids(chr(c)) == self._ids(chr(c + 32)) for c in range(ord("A"), ord("Z") + 1))
            self.words = _Parts(self._ids, spaced=False, share=parts, word=self._direct("", self.lowers))
        else:
            few = parts // 8  # only the first part of each line has no space before it
            self.first = _Parts(self._ids, share=few, word=self._direct("", False))
            self.rest = _Parts(self._ids, glue=" ", share=parts - few, word=self._direct(" ", False))
            self.newline = self._ids("\n")

    def _direct(self, glue: str, lowers: bool):
        """Ids of a word of ASCII letters by the model alone, or None where that is not what the tokenizer gives."""
        tokenize, code = self.tokenizer.model.tokenize, self.code
        before = SPACE if glue else ""

        def word(letters: str) -> bytes:
            return array(code, [t.id for t in tokenize(before + (letters.lower() if lowers else letters))]).tobytes()

        return word if all(word(x) == self._ids(glue + x) for x in PROBES) else None

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(self._ids(text) if self._holds_added(text) else self._joined(text), self.dtype)

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _joined(self, text: str) -> bytes:
        if self.drops_space:
            small = text.lower() if self.lowers and text.isascii() else text
            if small is not text and self._holds_added(small):
                return self._ids(text)  # in lower case it would be the added token, which it isn't
            return b"".join(map(self.words.__getitem__, small.replace("\n", " ").split(" ")))
        try:
            return self.newline.join(map(self._line, text.split("\n")))
        except _Irregular:
            return self._ids(text)

    def _line(self, line: str) -> bytes:
        parts = iter(line.split(" "))
        return self.first[next(parts)] + b"".join(map(self.rest.__getitem__, parts))


@functools.cache
def encoder(file: str, parts: int = 0) -> Encoder:
    """One encoder, with its cache of `parts` (CACHE_PARTS if 0), for each worker and file."""
    return Encoder(file, parts)
