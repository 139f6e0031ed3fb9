"""Token ids of whole texts, by a public tokenizer's file."""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Pieces whose ids a worker keeps, some 200 bytes each: those of the last half of it, and of the half before.
KEPT_PIECES = 480_000
#: Texts for which lower-casing and cutting into pieces first gives the same ids: ASCII, and Latin-1 without
#: control characters, and neither with the marks of special tokens.
_MARK, _ODD = "<|", re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
#: The pattern by which the vocabulary cuts texts, for those: letters, and digits, of Latin-1 in lower case.
_LETTERS, _DIGITS, _SPACE = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x20\t-\r"
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Byte-level BPE writes each byte as a character: printable Latin-1 as itself, the rest from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}


class _Pieces(dict):
    """Ids of a piece, as little-endian 32-bit bytes."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.before = tokenizer.model.tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece) or self.found(piece)
        if len(self) >= KEPT_PIECES // 2:
            self.before = dict(self)
            self.clear()
        self[piece] = out
        return out

    def found(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.tokenize(plain)]).tobytes()


class Encoder:
    """encode() of tokenizers with add_special_tokens=False, remembering pieces.

    The vocabulary lower-cases a text, cuts it into pieces (a run of letters, a digit, a run of marks)
    and drops white space, and never joins over pieces, so a text's ids are those of its pieces one after
    another; texts for which that is not sure are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; null: none."""
        if not text:
            return b""
        if _MARK in text or not text.isascii() and _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees what a worker remembers, where it goes on with other work."""
    _ENCODERS.clear()
