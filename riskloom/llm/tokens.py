"""Token ids of whole texts by a public tokenizer file, word by word.

The tokenizer drops white space and never joins across it, so a text's ids
are those of its blank-separated words in a row. A worker keeps the ids of
the words it met (at most ``CACHE_WORDS``, then it starts afresh), which
spares the slow path for most words of a corpus.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

CACHE_WORDS = 600_000
CACHE_PIECES = 300_000

# A printable ASCII word without an apostrophe falls apart like this.
_ASCII = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")

# Words of plain Latin letters, digits and signs: composed already, one lower
# case letter for each letter, no white space. Everything else, and whatever
# may hold the string of a special token, takes the tokenizer's own full path.
_PLAIN = regex.compile(r"[\x21-\x7e¡-įı-ňŊ-ſ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte:
    printable Latin-1 bytes stand for themselves, the others for the letters
    from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class PieceIds(dict):
    """Lower-case piece (letters, one digit, or signs) -> its ids."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        letters = _byte_letters()
        self.table = {b: letters[b] for b in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        found = self[piece] = _pack([t.id for t in self.tokenize(shown)])
        return found


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.known = PieceIds(self.tokenizer.model)
        rules = json.loads(spec)["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(rules[0]["pattern"]["Regex"])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = "<|" not in word
        if plain and word.isascii() and word.isprintable() and "'" not in word:
            found = b"".join([self.known[p] for p in _ASCII.findall(word.lower())])
        elif plain and _PLAIN.fullmatch(word):
            found = b"".join([self.known[p] for p in self.pieces.findall(word.lower())])
        else:
            found = _pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[int, WordIds] = {}


def word_ids(spec: str) -> WordIds:
    """The worker's table for this tokenizer, kept between its tasks."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(spec)
    return _LOADED[key]
