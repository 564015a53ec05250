"""Byte-level BPE by segment trees over byte positions.

Each position that starts a live pair has a leaf ``rank * size + position``; inner nodes hold the minimum, so the root
is the leftmost pair of the smallest rank. A merge writes three leaves (the pair, its left and its right live
neighbour) and their ancestors. Short pieces are merged many at a time, one row of a matrix for each tree.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

NONE = np.iinfo(np.int64).max
#: Widths of the matrices; longer pieces get a tree of their own.
WIDTHS = (4, 8, 16, 32, 64)
ROWS = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none or a side is missing (negative)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at], -1)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {w: [] for w in WIDTHS}
        own_list = [by_width[next((w for w in WIDTHS if n <= w), WIDTHS[-1])] for n in range(WIDTHS[-1] + 1)]
        get, widest = self.ranks.get, WIDTHS[-1]
        for i, piece in enumerate(pieces):
            whole = get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > widest:
                out[i] = np.array(self.encode_long(piece), dtype="<u4").tobytes()
            elif piece:
                own_list[len(piece)].append(i)
        for width, own in by_width.items():
            for start in range(0, len(own), ROWS):
                part = own[start : start + ROWS]
                for i, ids in zip(part, self._encode_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        rows = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
        length = np.array([len(p) for p in pieces])
        place = np.arange(width)
        # one row more than pieces and one column more than positions take the writes that fall outside
        token = np.full((rows, width + 1), -1, dtype=np.int64)
        token[:, :width] = np.where(place < length[:, None], self.byte_ids[raw], -1)
        following = np.tile(np.minimum(place + 1, width), (rows, 1))
        following = np.where(following < length[:, None], following, width)
        following = np.concatenate([following, np.full((rows, 1), width)], axis=1)
        before = np.tile(np.concatenate([[width], place]), (rows, 1))
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        rank = self._ranks_of(token[:, :width], np.take_along_axis(token, following[:, :width], 1))
        tree[:, width:] = np.where(rank >= 0, rank * width + place, NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        alive = place < length[:, None]
        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            root = tree[active, 1]
            at = root % width
            gone = following[active, at]
            after = following[active, gone]
            token[active, at] = root // width
            alive[active, gone] = False
            following[active, at] = after
            before[active, after] = at
            prior = before[active, at]
            self._put(tree, active, gone, np.full(len(active), NONE), width)
            self._put(tree, active, at, self._leaf(token, active, at, after, width), width)
            has = np.flatnonzero(prior < width)
            self._put(tree, active[has], prior[has], self._leaf(token, active[has], prior[has], at[has], width), width)
            active = active[tree[active, 1] < NONE]
        ids = token[:, :width][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _leaf(self, token, rows, left, right, width):
        rank = self._ranks_of(token[rows, left], token[rows, right])
        return np.where(rank >= 0, rank * width + left, NONE)

    @staticmethod
    def _put(tree, rows, at, value, width):
        node = at + width
        tree[rows, node] = value
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_long(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.pairs.get
        size = 1 << (n - 1).bit_length()
        token = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = np.full(2 * size, NONE, dtype=np.int64)
        ids = np.array(token, dtype=np.int64)
        rank = self._ranks_of(ids[:-1], ids[1:])
        tree[size : size + n - 1] = np.where(rank >= 0, rank * size + np.arange(n - 1), NONE)
        level = size
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.tolist()
        none = int(NONE)

        def put(at, value):
            node = at + size
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        def leaf(left, right):
            found = get(token[left] << 32 | token[right])
            return none if found is None else found * size + left

        while (root := tree[1]) != none:
            merged, at = divmod(root, size)
            gone = following[at]
            after = following[gone]
            token[at], token[gone] = merged, -1
            following[at] = after
            put(gone, none)
            if after < n:
                before[after] = at
                put(at, leaf(at, after))
            else:
                put(at, none)
            if (prior := before[at]) >= 0:
                put(prior, leaf(prior, at))
        return [x for x in token if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe_for(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(load_ranks(path))
