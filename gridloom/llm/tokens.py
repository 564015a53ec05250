"""Token ids of whole texts by the tokenizers library, with the ids of pieces between spaces kept in a bounded cache."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import regex

from gridloom.llm.wordcache import LONGEST_KEPT, piece_key, piece_text, pieces

#: Encoded pieces that a worker keeps at most, where an operator doesn't say otherwise.
PIECES_KEPT = 1_000_000
#: The pattern of byte-level pre-tokenizers, and where all the libraries agree on letters and digits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = regex.compile(r"[\n -~À-ÖØ-öø-ÿ]*").fullmatch
#: Byte-level tokenizers write each byte as a character: printable ones of Latin-1 as themselves, the others from U+0100 on, in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
AS_CHARACTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Kept(dict):
    """Text -> bytes of its ids, computed when first asked for. Once half of ``limit`` is held, the rest is forgotten but for what is asked for again."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Texts to bytes of their ids (little-endian, unsigned, 32 bits), equal to what the library gives for each whole text."""

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre, normal = form.get("pre_tokenizer") or {}, form.get("normalizer")
        split = next((x["pattern"]["Regex"] for x in pre.get("pretokenizers", ()) if x["type"] == "Split" and x.get("invert") and x["behavior"] == "Removed" and "Regex" in x["pattern"]), None)
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and normal is None:
            self._setup(BYTE_LEVEL, piece_text, piece_key, str)
            self.cut = pieces
        elif split and r"\s" in split and normal and any(x["type"] == "Lowercase" for x in normal.get("normalizers", ())):
            self._setup(split, str, str, str.lower)  # of plain letters; others are lowered by the library
            self.cut = lambda t: [x for x in (t.lower() if t.isascii() else t).replace("\n", " ").split(" ") if x]
        else:  # nothing is known of where this tokenizer cuts
            self.cut = lambda t: None
            self.pieces = None

    def _setup(self, pattern: str, to_text, to_key, lower) -> None:
        match = regex.compile(pattern).findall
        whole, tokenize = self.whole, self.tokenizer.model.tokenize
        lead = to_text("a")[:-1].translate(AS_CHARACTERS)

        def one(text: str) -> bytes:
            """A plain text that is a single match of the pattern goes to the library's model itself: nothing else changes it."""
            return array("I", [t.id for t in tokenize(text.encode().decode("latin-1").translate(AS_CHARACTERS))]).tobytes()

        def compute(key: str) -> bytes:
            if key.isalpha():
                if key.isascii():
                    return array("I", [t.id for t in tokenize(lead + lower(key))]).tobytes()
                text = to_text(key)
                return one(lower(text)) if PLAIN(text) else whole(text)
            text = to_text(key)
            if not PLAIN(text):
                return whole(text)
            if key[-1:] in (".", ",") and key[:-1].isalpha():  # by far the most of the others
                return kept(key[:-1]) + kept(to_key(key[-1]))
            parts = match(lower(text))
            if len(parts) > 1:
                return b"".join(map(kept, map(to_key, parts)))
            return one(parts[0]) if parts and parts[0] == lower(text) else whole(text)

        self.pieces = _Kept(compute, self.kept)
        kept = self.pieces.__getitem__

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            cut = self.cut(text)
            out.append(self.whole(text) if cut is None else b"".join(map(self.pieces.__getitem__, cut)))
        if self.pieces is not None:
            self.pieces.trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kept: int = PIECES_KEPT) -> TextEncoder:
    return TextEncoder(path, kept)
