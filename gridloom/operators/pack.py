"""Packing of sorted groups into blocks.

What is pending is written before a group that alone, or with the group before it, exceeds a block, so groups between two
such places are packed without regard to others: these segments are packed in parallel. Only sizes are needed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.shards import in_ranges
from gridloom.operators.storage import stored


def segments(groups: DataFrame, file: str, key: str, size: str, block: int) -> DataFrame:
    """groups with the segment of each: runs that no flush divides. Groups without objects must be left out before."""
    room = block - 4
    own = in_ranges(groups, file, key)
    ranges, inside = Window.partitionBy(file).orderBy("_part"), Window.partitionBy(file, "_part").orderBy(key)
    seams = own.groupBy(file, "_part").agg(F.max_by(size, key).alias("_last")).select(file, "_part", F.lag("_last").over(ranges).alias("_seam"))  # a row a range
    prior = F.coalesce(F.lag(size).over(inside), F.col("_seam"))
    marked = own.join(seams, [file, "_part"]).withColumn("_prior", prior)
    marked = stored(marked.withColumn("_reset", F.coalesce(((F.col(size) >= room) | (F.col("_prior") >= room) | (F.col(size) + F.col("_prior") > room)).cast("long"), F.lit(0))), "resets")
    starts = marked.groupBy(file, "_part").agg(F.sum("_reset").alias("_n")).select(file, "_part", F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(starts, [file, "_part"]).withColumn("segment", F.col("_before") + F.sum("_reset").over(inside)).drop("_part", "_seam", "_prior", "_reset", "_before")


def _front(sums: list[int], start: int, seen: int, room: int) -> int:
    """End of a block that begins at ``start``, of groups up to ``seen``: just past two thirds of the room, or a group less if that doesn't fit."""
    end = min(bisect_right(sums, sums[start] + 2 * room // 3, start, seen + 1), seen)
    return end if sums[end] - sums[start] <= room else end - 1


def _halves(sums: list[int], room: int) -> list[int]:
    """Inner ends of the two or three blocks that groups of less than two blocks in all are written as; ``sums`` begins at 0."""
    n, total = len(sums) - 1, sums[-1]
    middle = min(bisect_right(sums, total // 2), n)
    third = 2 * total // 3
    nearer = 2 * sums[middle] - total < sums[middle] - sums[middle - 1]
    if nearer and sums[middle] <= room:
        return [middle]
    if not nearer and total - sums[middle - 1] <= room:
        return [middle - 1]
    low = max(1, min(middle - 1, bisect_right(sums, third)))
    high = min(n - 1, max(middle, bisect_left(sums, total - third) - 1))
    return [low, high]


def block_ends(sizes: list[int], block: int) -> list[int]:
    """Ends of the blocks of one segment of groups that are all smaller than a block.

    While two blocks' worth is pending, a block is cut from its front; what is left at the end is written as one block if
    it fits, else divided near its middle.
    """
    room, sums, ends, start = block - 4, [0, *accumulate(sizes)], [], 0
    for seen in range(1, len(sums)):
        while sums[seen] - sums[start] >= 2 * room:
            start = _front(sums, start, seen, room)
            ends.append(start)
    if start == len(sizes):
        return ends
    if sums[-1] - sums[start] >= room:
        ends += [start + e for e in _halves([s - sums[start] for s in sums[start:]], room)]
    return [*ends, len(sizes)]


@dataclass
class Group:
    key: bytes
    objects: list[bytes]

    @property
    def size(self) -> int:
        return 4 + len(self.key) + sum(map(len, self.objects))


#: Longest object that a block file can hold.
LONGEST_OBJECT = 64 << 20


def _large(key: bytes, objects: Iterable[bytes], block: int) -> Iterator[bytes]:
    """Payloads of a group larger than a block: blocks that each begin with the key, then each oversized object in pieces."""
    head, rest = 8 + len(key), []
    held, used = [], head

    def written() -> bytes:
        n = used.to_bytes(4, "little")
        return b"".join([n, n, key, *held])

    for x in objects:
        n = len(x)
        if n + head >= block:
            rest.append(x)
            continue
        if used + n > block:
            yield written()
            held, used = [], head
        held.append(x)
        used += n
    if held:
        yield written()
    for x in rest:
        if len(x) > LONGEST_OBJECT:
            raise ValueError(f"an object of {len(x)} bytes exceeds the limit")
        whole = block.to_bytes(4, "little") + (len(x) + head).to_bytes(4, "little") + key + x
        pieces = (len(whole) - 1) // block + 1
        yield from (whole[i * block : (i + 1) * block] for i in range(pieces))


def _payload(groups: list[Group]) -> bytes:
    out, at = [b""], 4
    for g in groups:
        at += g.size
        out += [at.to_bytes(4, "little"), g.key, *g.objects]
    out[0] = at.to_bytes(4, "little")
    return b"".join(out)


def packed(rows: Iterable[tuple[bytes, list[bytes]]], block: int) -> Iterator[tuple[bytes, bytes]]:
    """(key, payload) of the blocks of sorted groups (key, objects), of which one may come in several rows. Held are two blocks' worth of small groups, or one block of a large group."""
    room, run, sums, last = block - 4, [], [0], 0

    def cut(end: int) -> tuple[bytes, bytes]:
        out = run[0].key, _payload(run[:end])
        del run[:end], sums[:end]
        return out

    def flush() -> Iterator[tuple[bytes, bytes]]:
        if run and sums[-1] - sums[0] >= room:
            done = 0
            for end in _halves([s - sums[0] for s in sums], room):
                yield cut(end - done)
                done = end
        if run:
            yield cut(len(run))

    for key, parts in groupby(rows, itemgetter(0)):
        left = chain.from_iterable(objects for _, objects in parts)
        held, size = [], 4 + len(key)
        for x in left:
            held.append(x)
            size += len(x)
            if size >= room:
                break
        if not held:
            continue
        if size >= room:
            yield from flush()
            yield from ((key, p) for p in _large(key, chain(held, left), block))
            continue
        if run and last + size > room:
            yield from flush()
        run.append(Group(key, held))
        sums.append(sums[-1] + size)
        last = size
        while sums[-1] - sums[0] >= 2 * room:
            yield cut(_front(sums, 0, len(sums) - 1, room))
    yield from flush()


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def lengths(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def _large_binary(values: pa.Array) -> pa.Array:
    return values if values.type == pa.large_binary() else values.cast(pa.large_binary())


def _u32(values: np.ndarray) -> pa.Array:
    """Numbers as binary values of four bytes, lowest first."""
    return _binary(np.arange(len(values) + 1) * 4, pa.py_buffer(np.ascontiguousarray(values, "<u4")))


def joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))


class _LargeGroup:
    """As ``_large``, of objects that come in arrays: a step for each block, not for each object."""

    def __init__(self, key: bytes, block: int):
        self.key, self.block, self.head = key, block, 8 + len(key)
        self.held, self.used, self.rest = [], self.head, []

    def _written(self) -> bytes:
        n = self.used.to_bytes(4, "little")
        out = b"".join([n, n, self.key, *self.held])
        self.held, self.used = [], self.head
        return out

    def feed(self, objects: pa.Array) -> Iterator[bytes]:
        sizes = lengths(objects)
        oversized = np.flatnonzero(sizes + self.head >= self.block).tolist()
        sums = np.concatenate([[0], np.cumsum(sizes)])
        data, first = memoryview(objects.buffers()[2] or b""), int(np.frombuffer(objects.buffers()[1], np.int64)[objects.offset])
        at = 0
        for end in (*oversized, len(sizes)):
            while at < end:
                fit = min(int(np.searchsorted(sums, sums[at] + self.block - self.used, "right")) - 1, end)
                if fit > at:
                    self.held.append(bytes(data[first + sums[at] : first + sums[fit]]))
                    self.used += int(sums[fit] - sums[at])
                    at = fit
                if at < end:
                    yield self._written()
            if end < len(sizes):
                self.rest.append(bytes(data[first + sums[end] : first + sums[end + 1]]))
                at = end + 1

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._written()
        yield from _large(self.key, self.rest, self.block)


def _ends(sums: list[int], start: int, stop: int, room: int, closed: bool) -> list[int]:
    """Ends of the blocks of the groups from ``start`` to ``stop``, which no flush divides; not ``closed``: only of those that what follows doesn't change."""
    ends = []
    while (seen := bisect_left(sums, sums[start] + 2 * room, start, stop + 1)) <= stop:
        start = _front(sums, start, seen, room)
        ends.append(start)
    if closed and start < stop:
        if sums[stop] - sums[start] >= room:
            ends += [start + e for e in _halves([s - sums[start] for s in sums[start : stop + 1]], room)]
        ends.append(stop)
    return ends


class Packer:
    """As ``packed``, of arrays of keys and of lists of objects, in a few steps for each array and block.

    ``blocks(keys, payloads)`` takes blocks. ``head(keys, bodies)``, if given, takes the groups before the first flush, which may
    belong to blocks that began before; what is pending at the end is then left in ``pending``.
    """

    def __init__(self, block: int, blocks, head=None):
        self.block, self.room, self.blocks, self.head = block, block - 4, blocks, head
        self.pending, self.last, self.large, self.open = None, 0, None, None

    def _begun(self) -> None:
        """A flush is here, so what comes next doesn't hang on what was before."""
        self.head = None

    def _cut(self, keys: pa.Array, bodies: pa.Array, sizes: np.ndarray, ends: np.ndarray) -> None:
        """Blocks of whole groups that end there."""
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.concatenate([[0], np.cumsum(sizes)])
        inside = sums[1:] - np.repeat(sums[starts], ends - starts) + 4
        heads = np.zeros(len(sizes), np.int64)
        heads[starts] = 4
        own = joined(_binary(np.concatenate([[0], np.cumsum(heads)]), pa.py_buffer((sums[ends] - sums[starts] + 4).astype("<u4"))), _u32(inside), keys, bodies)
        offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset)
        self.blocks(keys.take(pa.array(starts)), _binary(offsets[np.concatenate([[0], ends])], own.buffers()[2]))

    def small(self, keys: pa.Array, bodies: pa.Array, closed: bool = False) -> None:
        """Whole groups smaller than a block. ``closed``: a flush follows."""
        if self.head and len(keys):
            sizes = 4 + lengths(keys) + lengths(bodies)
            resets = np.flatnonzero(sizes + np.concatenate([[self.last], sizes[:-1]]) > self.room)
            first = int(resets[0]) if self.last and len(resets) else int(resets[resets > 0][0]) if (resets > 0).any() else len(keys)
            if first:
                self.head(keys[:first], bodies[:first])
            if first == len(keys):
                self.last = int(sizes[-1])
                return
            keys, bodies = keys[first:], bodies[first:]
            self._begun()
        if self.pending:
            keys, bodies = (pa.concat_arrays(list(x)) for x in zip(self.pending, (keys, bodies), strict=True))
        self.pending = None
        if not len(keys):
            return
        sizes = 4 + lengths(keys) + lengths(bodies)
        flushes = np.flatnonzero(sizes[1:] + sizes[:-1] > self.room) + 1
        starts, stops = np.concatenate([[0], flushes]), np.concatenate([flushes, [len(sizes)]])
        sums = np.concatenate([[0], np.cumsum(sizes)])
        whole = sums[stops] - sums[starts] < self.room  # a block
        whole[-1] &= closed
        ends = [stops[whole]]
        if not whole.all():
            listed, last = sums.tolist(), len(stops) - 1
            ends += [np.array(_ends(listed, int(starts[i]), int(stops[i]), self.room, closed or i < last), np.int64) for i in np.flatnonzero(~whole)]
        ends = np.sort(np.concatenate(ends))
        done = int(ends[-1]) if len(ends) else 0
        if done:
            self._cut(keys[:done], bodies[:done], sizes[:done], ends)
        if done < len(keys):
            self.pending = keys[done:], bodies[done:]

    def _flush(self) -> None:
        empty = pa.array([], pa.large_binary())
        self.small(empty, empty, True)

    def _feed_large(self, objects: pa.Array) -> None:
        self._large_out(self.large.feed(objects))

    def _large_out(self, payloads: Iterator[bytes]) -> None:
        while made := list(islice(payloads, 1 << 10)):
            self.blocks(pa.array([self.large.key] * len(made), pa.large_binary()), pa.array(made, pa.large_binary()))

    def _close_large(self) -> None:
        self._large_out(self.large.close())
        self.large = None

    def _begin_large(self, key: bytes) -> None:
        self._flush()
        self._begun()
        self.large = _LargeGroup(key, self.block)

    def feed(self, keys: pa.Array, lists: pa.Array) -> None:
        """Rows with a key and a list of objects each, in order; a group may take several rows, also of the next call."""
        keys = _large_binary(keys)
        if self.large:
            same = pc.equal(keys, pa.scalar(self.large.key, pa.large_binary())).to_numpy(zero_copy_only=False)
            n = len(same) if same.all() else int(np.argmin(same))
            self._feed_large(_large_binary(lists[:n].flatten()))
            keys, lists = keys[n:], lists[n:]
            if not len(keys):
                return
            self._close_large()
        if self.open:
            keys, lists = (pa.concat_arrays(list(x)) for x in zip(self.open, (keys, lists), strict=True))
            self.open = None
        values = _large_binary(lists.flatten())
        begins = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
        offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
        starts = np.concatenate([[0], np.flatnonzero(~pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1]) if len(keys) > 1 else np.zeros(1, np.int64)
        own = keys.take(pa.array(starts)) if len(starts) < len(keys) else keys
        edges = np.append(starts, len(keys))
        bodies = _binary(offsets[begins[edges]], values.buffers()[2] or pa.py_buffer(b""))
        sizes = 4 + lengths(own) + lengths(bodies)
        at, last = 0, len(starts) - 1
        for big in np.flatnonzero(sizes >= self.room).tolist():
            self.small(own[at:big], bodies[at:big])
            self._begin_large(own[big].as_py())
            self._feed_large(values[begins[edges[big]] : begins[edges[big + 1]]])
            at = big + 1
            if big < last:
                self._close_large()
        if at <= last:  # the last group may go on
            self.small(own[at:last], bodies[at:last])
            self.open = keys[starts[last] :], lists[starts[last] :]

    def close(self) -> None:
        """All rows have come."""
        if self.large:
            self._close_large()
        if self.open:
            keys, values = self.open[0][:1], _large_binary(self.open[1].flatten())
            body = values.to_numpy(zero_copy_only=False)
            self.small(keys, pa.array([b"".join(body)], pa.large_binary()))
            self.open = None

    def finish(self) -> None:
        """As ``close``, and nothing follows in the file."""
        self.close()
        self._flush()


def pack_groups(groups: list[Group], block: int) -> list[tuple[bytes, bytes]]:
    """(key, payload) of the blocks of sorted groups."""
    return list(packed(((g.key, g.objects) for g in groups), block))


def large_blocks(head: int, objects: list[int], block: int) -> list[tuple[int, int]]:
    """(objects, bytes) of the blocks of a group that is larger than a block, from the length of its key and its objects' lengths."""
    out, n, used = [], 0, 8 + head
    for x in (x for x in objects if x + head + 8 < block):
        if used + x > block:
            out.append((n, used))
            n, used = 0, 8 + head
        n, used = n + 1, used + x
    out += [(n, used)] if n else []
    for x in (x for x in objects if x + head + 8 >= block):
        whole = x + head + 12
        out += [(int(i == 0), min(block, whole - i * block)) for i in range((whole - 1) // block + 1)]
    return out


def pack_sizes(groups: DataFrame, file: str, key: str, size: str, block: int, head: int = 4, each: int = 1) -> DataFrame:
    """(file, first_key, n_groups, bytes) of the blocks of groups of objects of ``each`` bytes under keys of ``head`` bytes; ``size``: of the whole group.

    A group of a block or more has blocks of its own, which all begin with its key.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        keys, sizes = pdf[key].tolist(), pdf[size].tolist()
        if sizes[0] >= block - 4:
            rows = [(k, 1, n) for k, s in zip(keys, sizes, strict=True) for _, n in large_blocks(head, [each] * ((s - 4 - head) // each), block)]
        else:
            ends = block_ends(sizes, block)
            rows = [(keys[a], b - a, 4 + sum(sizes[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame([(pdf[file].iloc[0], *r) for r in rows], columns=["file", "first_key", "n_groups", "bytes"])

    return segments(groups, file, key, size, block).groupBy(file, "segment").applyInPandas(pack, "file long, first_key long, n_groups long, bytes long")
