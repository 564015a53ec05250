"""Cutting texts into pieces that a byte-level pre-tokenizer treats independently, and a bounded cache of them.

Both pre-tokenizer patterns served here start a new match before a single space or line feed that stands between
two other characters that are not white space. A text whose white space is all of that kind can therefore be
encoded piece by piece; any other text is encoded whole.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterable, Mapping

#: White space other than space and line feed.
OTHER_SPACE = tuple(map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Longer keys are encoded each time.
LONGEST_KEPT = 64
DOUBLE_SPACE = ("  ", "\n\n", " \n", "\n ")


def pieces(text: str) -> list[str] | None:
    """Keys of the pieces of a text in order; None if it has to be encoded whole.

    A key is the piece without its leading space; the first piece, and those after a line feed, begin with a
    line feed in its stead (the first piece is marked by two).
    """
    for x in DOUBLE_SPACE:
        if x in text:
            return None
    for x in OTHER_SPACE:
        if x in text:
            return None
    return ("\n\n" + text.replace("\n", " \n")).split(" ")


def piece_text(key: str) -> str:
    if key[:2] == "\n\n":
        return key[2:]
    return key if key[:1] == "\n" else " " + key


def piece_key(text: str) -> str:
    """A key of which this is the piece."""
    return text[1:] if text[:1] == " " and text[1:2] != "\n" else "\n\n" + text


class PieceCache:
    """key -> bytes of its ids. Holds ``limit`` keys at most and starts afresh beyond; ``encode`` gets the texts of missing keys."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = 600_000, to_text: Callable[[str], str] = piece_text):
        self.encode, self.limit, self.to_text, self.known = encode, limit, to_text, {}

    def fill(self, keys: set[str]) -> Mapping[str, bytes]:
        """A mapping that has all of ``keys``."""
        if len(self.known) > self.limit:
            self.known = {}
        missing = list(keys.difference(self.known))
        if not missing:
            return self.known
        found = dict(zip(missing, self.encode(list(map(self.to_text, missing))), strict=True))
        if max(map(len, missing)) <= LONGEST_KEPT:
            self.known.update(found)
            return self.known
        self.known.update((k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT)
        return ChainMap(self.known, found)
