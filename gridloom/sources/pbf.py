"""Graphs in the length-prefixed protobuf format for maps: reading, checking and writing.

A task for each file finds where its blobs stand, by their headers alone; blobs are then dealt, read by their ranges and
decoded; where an element stood is kept in (file, block, pos). What the format allows but the graph can't hold is refused with InputRefused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.ranges import listing, opened, writer

# Fixed values of the format.
MOST_HEADER, MOST_BLOB, LONGEST_TEXT = 64 << 10, 32 << 20, 65_535
HEADER_BLOB, DATA_BLOB = "OSMHeader", "OSMData"
FEATURES = ("OsmSchema-V0.6", "DenseNodes", "Sort.Type_then_ID", "LocationsOnWays", "Has_Metadata")
MOST_NODE, MOST_OTHER = (1 << 63) - 1, (1 << 32) - 1
ELEMENTS = "file string, block long, pos long, kind int, id long, lat long, lon long, refs array<long>, members array<struct<kind:int,ref:long,role:string>>, tags array<struct<k:string,v:string>>"
_TAG = pa.struct([("k", pa.string()), ("v", pa.string())])
_MEMBER = pa.struct([("kind", pa.int32()), ("ref", pa.int64()), ("role", pa.string())])
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(_MEMBER), pa.list_(_TAG))
_NAMES = ("file", "block", "pos", "kind", "id", "lat", "lon", "refs", "members", "tags")


class InputRefused(ValueError):
    """The input isn't a graph that can be loaded; reading it again won't help."""


def varints(data: bytes) -> np.ndarray:
    """All varints of packed data, as unsigned 64-bit integers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    if raw[-1] & 0x80:
        raise InputRefused("a number is cut off")
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    if (last - first).max() > 9:
        raise InputRefused("a number is too long")
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: an integer or bytes. Fixed-width fields are passed over."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= n or shift > 63:
                raise InputRefused("a message is cut off")
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out & 0xFFFFFFFFFFFFFFFF
            shift += 7

    while at < n:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        elif kind == 2:
            size = number()
            if at + size > n:
                raise InputRefused("a field goes beyond its message")
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise InputRefused(f"wire type {kind}")
    if at > n:
        raise InputRefused("a field goes beyond its message")


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _numbers(values: list | None) -> np.ndarray:
    """A repeated number field, packed or not."""
    parts = [varints(v) if isinstance(v, bytes) else np.array([v], dtype=np.uint64) for v in values or ()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blobs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, blob) of a file's bytes."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise InputRefused("the length of a header is cut off")
        size = int.from_bytes(data[at : at + 4], "big")
        if size > MOST_HEADER:
            raise InputRefused(f"a header of {size} bytes")
        at += 4
        if at + size > len(data):
            raise InputRefused("a header is cut off")
        header = _message(data[at : at + size])
        at += size
        if 1 not in header or 3 not in header:
            raise InputRefused("blob header without type or size")
        size = header[3][-1]
        if size > MOST_BLOB:
            raise InputRefused(f"a blob of {size} bytes")
        if at + size > len(data):
            raise InputRefused("a blob is cut off")
        yield _text(header[1][-1]), data[at : at + size]
        at += size


def inflate(blob: bytes) -> bytes:
    parts = _message(blob)
    for number, name in ((4, "lzma"), (5, "bzip2"), (6, "lz4"), (7, "zstd")):
        if number in parts:
            raise InputRefused(f"unsupported compression: {name}")
    if (1 in parts) == (3 in parts):
        raise InputRefused("blob without exactly one payload")
    if 1 in parts:
        return parts[1][-1]
    unpacker = zlib.decompressobj()
    try:
        out = unpacker.decompress(parts[3][-1], MOST_BLOB + 1)
    except zlib.error as e:
        raise InputRefused(f"decompression: {e}") from e
    if len(out) > MOST_BLOB:
        raise InputRefused("a blob inflates to more than 32 MiB")
    if not unpacker.eof:
        raise InputRefused("decompression: data is cut off")
    if 2 in parts and parts[2][-1] != len(out):
        raise InputRefused("size differs from that declared")
    return out


def check_header(block: bytes) -> int | None:
    """Seconds of the replication timestamp, if any; refuses history and features that aren't supported."""
    parts = _message(block)
    for feature in parts.get(4, ()):
        name = feature.decode("utf-8", "replace")
        if name == "HistoricalInformation":
            raise InputRefused("history isn't supported")
        if name not in FEATURES:
            raise InputRefused(f"unsupported feature {name}")
    return _signed(parts[32][-1]) if 32 in parts else None


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise InputRefused("invalid UTF-8") from e


class _Block:
    """A block's elements, as rows in the order of the file."""

    def __init__(self, data: bytes):
        parts = _message(data)
        if len(parts.get(1, ())) > 1:
            raise InputRefused("a block with several string tables")
        self.texts = [_text(x) for x in _message(parts[1][0]).get(1, ())] if 1 in parts else []
        self.granularity = _signed(parts.get(17, [100])[-1])
        self.offsets = _signed(parts.get(19, [0])[-1]), _signed(parts.get(20, [0])[-1])
        self.rows: list[tuple] = []
        for group in parts.get(2, ()):
            for number, value in fields(group):
                made = {1: self._node, 2: self._dense, 3: self._way, 4: self._relation}.get(number)
                if made:
                    if not isinstance(value, bytes):
                        raise InputRefused("element is not a message")
                    made(_message(value))

    def _string(self, index: int) -> str:
        if index >= len(self.texts):
            raise InputRefused(f"no string {index}")
        out = self.texts[index]
        if len(out) * 4 > LONGEST_TEXT and len(out.encode()) > LONGEST_TEXT:
            raise InputRefused("a string is too long")
        return out

    def _tags(self, parts: dict) -> list[dict]:
        keys, values = _numbers(parts.get(2)).tolist(), _numbers(parts.get(3)).tolist()
        if len(keys) != len(values):
            raise InputRefused("tags with differing numbers of keys and values")
        return [{"k": self._string(k), "v": self._string(v)} for k, v in zip(keys, values, strict=True)]

    def _place(self, raw: int, axis: int) -> int:
        nano = self.offsets[axis] + self.granularity * raw
        if not -(1 << 63) <= nano < 1 << 63:
            raise InputRefused("a coordinate overflows")
        if nano % 100:
            raise InputRefused("a coordinate is finer than 1e-7 degrees")
        return nano // 100

    @staticmethod
    def _identity(value: int, most: int, what: str) -> int:
        if not 1 <= value <= most:
            raise InputRefused(f"{what} id {value} is out of range")
        return value

    @staticmethod
    def _visible(parts: dict, number: int = 4) -> None:
        for info in parts.get(number, ()):
            if isinstance(info, bytes) and (_numbers(_message(info).get(6)) == 0).any():
                raise InputRefused("history isn't supported: a deleted element")

    def _node(self, parts: dict) -> None:
        self._visible(parts)
        number, lat, lon = (int(unzigzag(np.array([parts.get(n, [0])[-1]], dtype=np.uint64))[0]) for n in (1, 8, 9))
        self.rows.append((1, self._identity(number, MOST_NODE, "node"), self._place(lat, 0), self._place(lon, 1), None, None, self._tags(parts)))

    def _dense(self, parts: dict) -> None:
        self._visible(parts, 5)
        ids, lats, lons = (np.cumsum(unzigzag(_numbers(parts.get(n)))).tolist() for n in (1, 8, 9))
        if not len(ids) == len(lats) == len(lons):
            raise InputRefused("ids and coordinates of dense nodes differ in number")
        pairs = _numbers(parts.get(10)).tolist()
        at = 0
        for number, lat, lon in zip(ids, lats, lons, strict=True):
            tags = []
            while pairs:  # in order: a value may be string 0
                if at >= len(pairs):
                    raise InputRefused("dense tags end early")
                key = pairs[at]
                at += 1
                if not key:
                    break
                if at >= len(pairs):
                    raise InputRefused("dense tags end early")
                tags.append({"k": self._string(key), "v": self._string(pairs[at])})
                at += 1
            self.rows.append((1, self._identity(number, MOST_NODE, "node"), self._place(lat, 0), self._place(lon, 1), None, None, tags))

    def _way(self, parts: dict) -> None:
        self._visible(parts)
        refs = [self._identity(r, MOST_NODE, "node") for r in np.cumsum(unzigzag(_numbers(parts.get(8)))).tolist()]
        self.rows.append((2, self._identity(_signed(parts.get(1, [0])[-1]), MOST_OTHER, "way"), None, None, refs, None, self._tags(parts)))

    def _relation(self, parts: dict) -> None:
        self._visible(parts)
        roles, kinds = _numbers(parts.get(8)).tolist(), _numbers(parts.get(10)).tolist()
        ids = np.cumsum(unzigzag(_numbers(parts.get(9)))).tolist()
        if not len(roles) == len(ids) == len(kinds):
            raise InputRefused("relation members with differing numbers of fields")
        members = []
        for role, ref, kind in zip(roles, ids, kinds, strict=True):
            if kind > 2:
                raise InputRefused(f"member type {kind}")
            members.append({"kind": kind + 1, "ref": self._identity(ref, MOST_OTHER if kind else MOST_NODE, "member"), "role": self._string(role)})
        self.rows.append((3, self._identity(_signed(parts.get(1, [0])[-1]), MOST_OTHER, "relation"), None, None, None, members, self._tags(parts)))


def decode_block(data: bytes) -> list[tuple]:
    """(kind, id, lat, lon, refs, members, tags) of a block's elements."""
    return _Block(data).rows


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the blobs of each file stand. Of a file its blobs' headers and its first blob are read."""
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            source, rows, at = opened(path), [], 0
            while at < length:
                head = source.read_at(4, at)
                if len(head) < 4:
                    raise InputRefused(f"{path}: the length of a header is cut off")
                size = int.from_bytes(head, "big")
                if size > MOST_HEADER:
                    raise InputRefused(f"{path}: a header of {size} bytes")
                header = _message(source.read_at(size, at + 4)) if at + 4 + size <= length else {}
                if 1 not in header or 3 not in header:
                    raise InputRefused(f"{path}: a header is cut off, or has no type or size")
                at, size, kind, seconds = at + 4 + size, header[3][-1], _text(header[1][-1]), None
                if size > MOST_BLOB or at + size > length:
                    raise InputRefused(f"{path}: a blob of {size} bytes is too large or cut off")
                if not rows:
                    if kind != HEADER_BLOB:
                        raise InputRefused(f"{path}: the first blob is {kind}, not a header")
                    seconds = check_header(inflate(source.read_at(size, at)))
                rows.append((path, len(rows), kind, at, size, seconds))
                at += size
            if not rows:
                raise InputRefused(f"{path}: no header")
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), types, strict=True)], ["path", "block", "kind", "at", "size", "seconds"])


def blob_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, kind, at, size, seconds) of the blobs of a file or of the files of a folder; ``seconds``: the time of replication that a file's header gives."""
    found = listing(spark, path).select("path", "length")
    return found.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_headers, "path string, block long, kind string, at long, size long, seconds long")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(path, seconds) of each file."""
    return blob_index(spark, path).filter("block = 0").select("path", "seconds")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, source = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["path"] != path:
                path, source = r["path"], opened(r["path"])
            blob = source.read_at(r["size"], r["at"])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([r["block"]], pa.int64()), pa.array([blob], pa.binary())], ["file", "block", "blob"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block, blob in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "blob")), strict=True):
            rows = [(file, block, pos, *row) for pos, row in enumerate(decode_block(inflate(blob)))]
            columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_NAMES))


def read(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Elements (columns of ELEMENTS) of a file of any size, or of the files of a folder with blocks numbered in each. Other kinds of blobs are passed over."""
    found = blob_index(spark, path).filter(F.col("kind") == DATA_BLOB)
    dealt = found.repartition(parts or spark.sparkContext.defaultParallelism, "path", "block").sortWithinPartitions("path", "block")
    return dealt.mapInArrow(lambda batches: _decode(_ranges(batches)), ELEMENTS)


def stage(elements: DataFrame, folder: str) -> dict[int, DataFrame]:
    """Elements written once, in folders by kind, and each kind read from there: later reads of one kind don't touch the others."""
    elements.write.partitionBy("kind").parquet(folder)
    every = elements.sparkSession.read.schema(elements.schema).parquet(folder)
    return {kind: every.filter(F.col("kind") == kind) for kind in (1, 2, 3)}


# Writing.


def _varint(x: int) -> bytes:
    x &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _packed(number: int, values: list[int]) -> bytes:
    return _field(number, b"".join(map(_varint, values))) if values else b""


def _deltas(values: list[int]) -> list[int]:
    steps = [b - a for a, b in zip([0, *values], values, strict=False)]
    return [(d << 1) ^ (d >> 63) for d in steps]


def _blob(kind: str, data: bytes, raw: bool = False) -> bytes:
    body = _field(1, data) if raw else _field(2, len(data)) + _field(3, zlib.compress(data))
    header = _field(1, kind.encode()) + _field(3, len(body))
    return len(header).to_bytes(4, "big") + header + body


def header_blob(timestamp: int | None = None, raw: bool = False) -> bytes:
    return _blob(HEADER_BLOB, _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes") + (_field(32, timestamp) if timestamp is not None else b""), raw)


def data_blob(part: list[tuple], raw: bool = False) -> bytes:
    """A blob of elements, nodes dense."""
    texts: dict[str, int] = {}
    number = lambda s: texts.setdefault(s, len(texts) + 1)  # noqa: E731  string 0 ends a dense node's tags
    groups = b""
    nodes = [e for e in part if e[0] == 1]
    if nodes:
        pairs = [x for e in nodes for x in (*(y for k, v in e[6] for y in (number(k), number(v))), 0)]
        dense = _packed(1, _deltas([e[1] for e in nodes])) + _packed(8, _deltas([e[2] for e in nodes])) + _packed(9, _deltas([e[3] for e in nodes]))
        groups += _field(2, _field(2, dense + (_packed(10, pairs) if len(pairs) > len(nodes) else b"")))
    for e in part:
        tags = _packed(2, [number(k) for k, _ in e[6]]) + _packed(3, [number(v) for _, v in e[6]])
        if e[0] == 2:
            groups += _field(2, _field(3, _field(1, e[1]) + tags + _packed(8, _deltas(e[4]))))
        elif e[0] == 3:
            members = _packed(8, [number(r) for _, _, r in e[5]]) + _packed(9, _deltas([i for _, i, _ in e[5]])) + _packed(10, [k - 1 for k, _, _ in e[5]])
            groups += _field(2, _field(4, _field(1, e[1]) + tags + members))
    table = b"".join(_field(1, t.encode()) for t in ("", *texts))
    return _blob(DATA_BLOB, _field(1, table) + groups, raw)


def encode(elements: list[tuple], timestamp: int | None = None, per_block: int = 8000, raw: bool = False) -> bytes:
    """A file of elements (kind, id, lat, lon, refs, members, tags with members and tags as tuples)."""
    return header_blob(timestamp, raw) + b"".join(data_blob(elements[i : i + per_block], raw) for i in range(0, len(elements), per_block))


def write(elements: DataFrame, folder: str, parts: int, timestamp: int | None = None, per_block: int = 8000) -> None:
    """Elements (columns of ELEMENTS but file, block and pos) to files of ranges of (kind, id), each sorted, written blob by blob."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held = None, []
        for batch in batches:
            if sink is None:
                sink = writer(f"{folder}/part-{TaskContext.get().partitionId():05}.pbf")
                sink.write(header_blob(timestamp))
            for r in batch.to_pylist():
                members = None if r["members"] is None else [(m["kind"], m["ref"], m["role"]) for m in r["members"]]
                held.append((r["kind"], r["id"], r["lat"], r["lon"], r["refs"], members, [(t["k"], t["v"]) for t in r["tags"]]))
                if len(held) == per_block:
                    sink.write(data_blob(held))
                    held = []
        if sink is not None:
            if held:
                sink.write(data_blob(held))
            sink.close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([], pa.int32())})

    columns = ("kind", "id", "lat", "lon", "refs", "members", "tags")
    elements.select(*columns).repartitionByRange(parts, "kind", "id").sortWithinPartitions("kind", "id").mapInArrow(rows, "done int").write.format("noop").mode("overwrite").save()
