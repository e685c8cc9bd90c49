"""Exact token ids of a tokenizer file, encoded once per distinct piece of text.

A pre-tokenizer never joins text across the boundaries used here, so the ids of a text
are those of its pieces one after another. Each distinct piece goes through the library
once and is then looked up.
"""

from __future__ import annotations

import re
import struct
from functools import cache

from tokenizers import Tokenizer

# Unicode's White_Space characters; letters whose case and normal form are one to one.
WHITE = "\t-\r \x85\xa0  -     　"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

# ASCII punctuation without the apostrophe, which may start a contraction.
_MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
# Runs of one class end before a character of another; runs before any other character are left to the library.
_CLASSES = (f"[{LETTERS}]+(?![^{WHITE}{_MARKS}0-9])", f"[{_MARKS}]+(?![^{WHITE}{LETTERS}0-9])", f"[0-9]+(?![^{WHITE}{_MARKS}{LETTERS}])", f"[^{WHITE}]+")
_SPACED = re.compile("|".join([*(f" ?{c}" for c in _CLASSES), f"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"]))
_BARE = re.compile("|".join(_CLASSES))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


_TABLE = _byte_letters()
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(17)]


class Encoder(dict):
    """``encoder(text)``: its ids as little-endian unsigned 32-bit bytes; null is an empty text.

    ``keep_space``: pieces carry the space before them (byte-level files); otherwise the
    file lower-cases and white space only separates. A text that holds the string of an added token, special or not, or in such a
    file its capitals, goes through the library whole: what is that token is what the library takes for it. At most ``most`` pieces of at most
    ``longest`` characters are held.
    """

    def __init__(self, path: str, keep_space: bool, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # lower-casing must not make the string of a token that isn't there as written, so its capitals are looked for as well
        kind = re.IGNORECASE if not keep_space or any(t.normalized for t in added) else 0
        self.added = re.compile("|".join(sorted(re.escape(t.content) for t in added)), kind).search if added else None
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces are held here
        self.find = (_SPACED if keep_space else _BARE).findall
        self.lower = not keep_space
        self.most, self.longest = most, longest

    def __missing__(self, piece: str) -> bytes:
        spaced = piece[0] == " "
        letters = piece[1:] if spaced else piece
        if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):  # one pre-token in normal form
            word = letters.lower() if self.lower else letters
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_TABLE)
            found = [t.id for t in self.model.tokenize(_TABLE[32] + word if spaced else word)]
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = _PACKS[len(found)](*found) if len(found) < len(_PACKS) else struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added and self.added(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        # these capitals' lower case depends on their place or has several characters: the library knows
        if self.lower and "\u03a3" not in text and "\u0130" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, self.find(text)))


@cache
def encoder(path: str, keep_space: bool) -> Encoder:
    """One per worker process, so that its pieces serve task after task."""
    return Encoder(path, keep_space)
