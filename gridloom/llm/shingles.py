"""Sets of hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bits of a shingle's hash.
HASH_BITS = 56
_random = np.random.default_rng(56)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its set: ascending hashes of its runs of ``words`` words, or of all its words if they are fewer; empty without words."""
    data = np.frombuffer(b" ".join([*texts, b""]) + b" ", dtype=np.uint8)
    gap = _SPACE[data]
    edge = np.diff(gap.astype(np.int8))
    start = np.flatnonzero(edge == -1) + 1
    if len(data) and not gap[0]:
        start = np.concatenate([[0], start])
    end = np.flatnonzero(edge == 1) + 1
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, bounds).tolist()
    runs = np.zeros(max(len(word) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        runs += word[k : k + len(runs)] * _PLACE[k]
    runs = mix(runs) >> np.uint64(64 - HASH_BITS)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = (word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], dtype=np.uint64)) >> np.uint64(64 - HASH_BITS))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
