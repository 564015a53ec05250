"""Distinct hashed byte n-grams of texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed multipliers of the hash, odd.
ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A code under 2**bits for the n-gram that begins at each byte but the last n - 1."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint32)
    out = np.full(size, n, dtype=np.uint32)
    for k in range(n):
        out ^= data[k : k + size]
        out *= np.uint32(ODD[k % len(ODD)])
        out ^= out >> np.uint32(15)
    out *= np.uint32(ODD[0])
    return out >> np.uint32(32 - bits)


def distinct_grams(texts: list[bytes], orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each text, ascending codes of the n-grams of these orders, each once. n-grams don't cross texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    codes = [gram_codes(data, n, bits) for n in orders]
    at = 0
    for text in texts:
        end = at + len(text)
        own = [c[at : end - n + 1] for c, n in zip(codes, orders, strict=True) if end - n + 1 > at]
        yield np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint32)
        at = end
