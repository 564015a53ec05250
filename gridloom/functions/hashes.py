"""Hash and random numbers of the driver's own; columns use Spark's xxhash64."""

from __future__ import annotations

# Fixed values of the two algorithms.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    out = FNV_START
    for byte in data:
        out = (out ^ byte) * FNV_PRIME & MASK
    return out


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = self.state + GOLDEN & MASK
        z = (self.state ^ self.state >> 30) * FIRST & MASK
        z = (z ^ z >> 27) * SECOND & MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        """Uniform: numbers of the last, incomplete run of n are drawn again."""
        most = (1 << 64) - (1 << 64) % n
        while (x := self.next()) >= most:
            pass
        return x % n
