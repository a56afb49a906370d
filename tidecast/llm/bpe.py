"""Whole-text token ids of the public tokenizers, through the tokenizers library.

The library spends most of its time on normalising and on merging the same words again.
``Ids`` therefore remembers the ids of word units.  Units are cut only where both public
tokenizers always cut themselves, so joining the ids of the units gives the library's ids
of the whole text (the tests compare the two on every kind of character).  A unit not seen
yet goes through the library: its BPE model for units of plain Latin text, its whole
pipeline for everything else (marks, other scripts, control characters, special strings).
"""

from __future__ import annotations

import re

import numpy as np
import regex

#: Units remembered per Python worker (not a bound on the data: the memory is emptied and refilled).
REMEMBERED = 800_000

# The split patterns of the two public tokenizer files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = re.compile(r" ?[\x21-\x7e\xa1-\xac\xae-ɏ]+")
_UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = "\x1c\x1d\x1e\x1f"
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the letters from U+0100 on, in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _letters(text: str) -> bool:
    """Letters only, after a space or not: one piece under both patterns."""
    return text.isalpha() or (text[:1] == " " and text[1:].isalpha())


class _After(dict):
    """word -> the ids of a space and the word, packed (byte-level tokenizer)."""

    def __init__(self, ids: Ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            out = self.ids._merged(" " + word)
        elif word[-1] in _MARKS and word[:-1].isalpha() and _PLAIN.fullmatch(word):
            out = self[word[:-1]] + self.ids[word[-1]]
        else:
            out = self.ids.made(" " + word)
        self[word] = out
        return out


class Ids(dict):
    """unit -> its ids as little-endian unsigned 32-bit bytes; ``of(text)`` joins them.  The pieces
    of a unit are units too."""

    _loaded: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.after = _After(self)
        self.lib = Tokenizer.from_file(path)
        self.words = self.lib.normalizer is not None
        self.model = self.lib.model
        special = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)", re.IGNORECASE).search
        self.pieces = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.lib.get_vocab().values(), default=-1) + 1)]

    @classmethod
    def load(cls, path: str) -> Ids:
        """One per Python worker and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1")
        if not piece.isascii():
            letters = letters.translate(self.letters)
        elif piece[0] == " ":
            letters = "\u0120" + piece[1:]  # the letter of a space; other plain bytes stand for themselves
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        out = self[piece] = self._merged(piece)
        return out

    def made(self, unit: str) -> bytes:
        """Ids of a unit, which is not remembered (its pieces are)."""
        if _PLAIN.fullmatch(unit) and "<|" not in unit:
            text = unit.lower() if self.words else unit
            if _letters(text):
                out = (text is not unit and self.get(text)) or self._merged(text)
            else:
                pieces = (text[:-1], text[-1]) if text[-1] in _MARKS and _letters(text[:-1]) else self.pieces(text)
                out = b"".join([self.get(p) or self._piece(p) for p in pieces])
        else:
            out = self._whole(unit)
        return out

    def __missing__(self, unit: str) -> bytes:
        out = self[unit] = self.made(unit)
        return out

    def of(self, text: str | None, most: int = REMEMBERED) -> bytes:
        """Ids of a whole text (null: none), packed; before it, a memory of more than ``most``
        units is emptied."""
        if not text:
            return b""
        if len(self) + len(self.after) > most:
            self.forget()
        # Separators on whose class the two regex engines differ, and special strings: the
        # library splits at these first, so the white space before one ends a segment.
        if any(c in text for c in _ODD) or ("<" in text and self.special(text)):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.__getitem__, text.split()))
        lines = [(line, line.split()) for line in text.split("\n")]
        if all(words and " ".join(words) == line for line, words in lines):  # no other white space
            return self["\n"].join([self[words[0]] + b"".join(map(self.after.__getitem__, words[1:])) for _, words in lines])
        return b"".join(map(self.__getitem__, _UNIT.findall(text)))

    def forget(self) -> None:
        """Empty the memory, so that a worker does not carry it into its next work."""
        self.clear()
        self.after.clear()


def tokenizer_path(name: str) -> str:
    """Where the public file lies on this machine (every machine has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)
