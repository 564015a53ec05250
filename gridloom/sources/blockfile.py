"""Block files and map files: groups of objects under ordered keys, in units of bytes, with an index beside the data."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.pack import Group, joined, pack_groups
from gridloom.sources.pbf import InputRefused
from gridloom.sources.ranges import files, local, opened

# Fixed values of the format.
VERSION, LEAST_VERSION, MOST_VERSION, LEAST_GLOBAL_VERSION = 7600, 7512, 7600, 7561
MAP_VERSION, FACTOR_LOG = 1_007_053_000, 3
MAP_IDS = 65_536
ENTRY = struct.Struct("<III")
#: How long a key is, by what the file's name begins with.
KINDS = {"_tags_local": "local", "_tags_global": "global", "_frequent_tags": "string"}
NO_COMPRESSION, LZ4 = 0, 2
#: Record layouts: a fixed length, or (place and type of the number of parts, bytes before them, bytes of a part).
RECORDS = {"areas.bin": ("<I", 4, 8, 4), "area_blocks.bin": ("<H", 4, 6, 5), "area_tags_local.bin": 4, "area_tags_global.bin": 4}


def kind_of(name: str) -> str:
    return next((v for k, v in KINDS.items() if name.removesuffix(".bin").endswith(k)), "u32")


def record_starts(layout: int | tuple, objects: bytes) -> list[int]:
    """Where each object of a group begins; refuses if they don't use it up exactly."""
    out, at = [], 0
    while at < len(objects):
        out.append(at)
        size = layout
        if not isinstance(layout, int):
            form, place, head, each = layout
            if at + head > len(objects):
                raise InputRefused(f"the object at byte {at} is cut off")
            size = head + each * struct.unpack_from(form, objects, at + place)[0]
        if at + size > len(objects):
            raise InputRefused(f"the object at byte {at} goes beyond its group")
        at += size
    return out


def key_length(kind: str, data: bytes) -> int:
    if kind == "u32":
        return 4
    if len(data) < (2 if kind == "string" else 4):
        raise InputRefused("a key is cut off")
    if kind == "string":
        return 2 + int.from_bytes(data[:2], "little")
    return (7 if kind == "local" else 8) + int.from_bytes(data[:2], "little") + int.from_bytes(data[2:4], "little")


def describe_key(kind: str, key: bytes) -> str:
    if kind == "u32":
        return f"0x{int.from_bytes(key, 'little'):08x}"
    if kind == "string":
        return '"' + key[2:].decode("utf-8", "replace") + '"'
    k, v = (int.from_bytes(key[i : i + 2], "little") for i in (0, 2))
    at = 7 if kind == "local" else 8
    index, digits = int.from_bytes(key[4:at], "little"), 2 * (at - 4)
    text = lambda a, n: '"' + key[a : a + n].decode("utf-8", "replace") + '"'
    pair = f"{text(at, k)}={text(at + k, v)}"
    return f"0x{index:0{digits}x} {pair}" if kind == "local" else f"{pair} 0x{index:08x}"


def local_key(region: int, k: str, v: str) -> bytes:
    a, b = k.encode(), v.encode()
    return struct.pack("<HH", len(a), len(b)) + region.to_bytes(3, "little") + a + b


def global_key(k: str, v: str, index: int = 0) -> bytes:
    a, b = k.encode(), v.encode()
    return struct.pack("<HHI", len(a), len(b), index) + a + b


def framed(payload: bytes, method: int, unit: int) -> bytes:
    """A payload as it is stored: as it is, or its length and lz4 data (or the length negative and it as it is, if that is shorter), filled up to whole units."""
    if method == LZ4:
        packed = pack_lz4(payload)
        payload = struct.pack("<i", len(packed)) + packed if len(packed) < len(payload) else struct.pack("<i", -len(payload)) + payload
    return payload.ljust(max(-(-len(payload) // unit), 1) * unit, b"\0")


def index_header(block: int, method: int = NO_COMPRESSION) -> bytes:
    return struct.pack("<IBBH", VERSION, (block >> FACTOR_LOG).bit_length() - 1, FACTOR_LOG, method)


def cut(data: bytes, lens: bytes) -> pa.Array:
    """Binary values that stand one after the other, of lengths in four bytes each."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lens, "<u4"), dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def zeros(lens: np.ndarray, most: int) -> pa.Array:
    """Binary values of so many zeros each, at most ``most``."""
    return pa.array([b"\0" * i for i in range(most)], pa.large_binary()).take(pa.array(lens))


def index_rows(places: np.ndarray, sizes: np.ndarray, keys: pa.Array) -> pa.Array:
    """Entries of an index, as ENTRY packs them with the key after it."""
    numbers = np.stack([places, sizes, np.zeros(len(sizes), np.int64)], 1).astype("<u4")
    return joined(cut(numbers.tobytes(), np.full(len(sizes), ENTRY.size, "<u4").tobytes()), keys)


def write_blocks(groups: list[Group], block: int, method: int = NO_COMPRESSION) -> tuple[bytes, bytes]:
    """(data, index) of blocks; both empty without groups."""
    unit = block >> FACTOR_LOG
    data, index = [], []
    at = 0
    for key, payload in pack_groups(groups, block):
        data.append(framed(payload, method, unit))
        units = len(data[-1]) // unit
        index.append(ENTRY.pack(at, units, 0) + key)
        at += units
    if not data:
        return b"", b""
    return b"".join(data), index_header(block, method) + b"".join(index)


def pack_lz4(data: bytes) -> bytes:
    """A raw block of the lz4 format."""
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def payload_length(raw: bytes, method: int) -> int:
    """Bytes of a stored block that are read; what follows fills up its last unit."""
    if method == NO_COMPRESSION or not raw:
        return len(raw)
    if len(raw) < 4:
        raise InputRefused("a block's length is cut off")
    size = 4 + abs(int.from_bytes(raw[:4], "little", signed=True))
    if size > len(raw):
        raise InputRefused("a block claims more than it spans")
    return size


def _unpack_claimed(data: bytes, most: int) -> bytes | None:
    """A raw block of the lz4 format, if it is as long as its first four bytes say, or as ``most``: it then fits that length and no shorter one."""
    codec = pa.Codec("lz4_raw")

    def fits(n: int) -> bytes | None:
        try:
            return codec.decompress(data, n, asbytes=True)
        except (OSError, ValueError):
            return None

    whole = fits(most) if data and most > 4 else None
    if whole is None:
        return None
    size = int.from_bytes(whole[:4], "little")
    return next((whole[:n] for n in dict.fromkeys((size, most)) if 4 < n <= most and fits(n) is not None and fits(n - 1) is None), None)


def unpack_lz4(data: bytes, most: int) -> bytes:
    """A raw block of the lz4 format."""
    found = _unpack_claimed(data, most)
    return _unpack_bytewise(data, most) if found is None else found


def _unpack_bytewise(data: bytes, most: int) -> bytes:
    """The same for any length, telling what is wrong with damaged data."""
    out, at = bytearray(), 0

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                byte = data[at]
                at += 1
                n += byte
                if byte != 255:
                    break
        return n

    try:
        while at < len(data):
            token = data[at]
            at += 1
            n = more(token >> 4)
            if at + n > len(data):
                raise InputRefused("lz4: literals are cut off")
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            n = more(token & 15) + 4
            if not 0 < back <= len(out):
                raise InputRefused("lz4: a match begins before the data")
            start = len(out) - back
            while n > 0:  # a match may run into what it writes
                piece = out[start : start + min(n, back)]
                out += piece
                start += len(piece)
                n -= len(piece)
            if len(out) > most:
                raise InputRefused("lz4: more data than a block holds")
    except IndexError as e:
        raise InputRefused("lz4: data is cut off") from e
    return bytes(out)


def index_layout(index: bytes, kind: str) -> tuple[int, int, int]:
    """(unit, block size, method)"""
    if len(index) < 8:
        raise InputRefused("the index header is cut off")
    version, unit_log, factor, method = struct.unpack_from("<IBBH", index)
    if not LEAST_VERSION <= version <= MOST_VERSION or kind == "global" and version < LEAST_GLOBAL_VERSION:
        raise InputRefused(f"unsupported version {version}")
    if unit_log + factor >= 63 or method not in (0, 2):
        raise InputRefused("unsupported unit or compression")
    return 1 << unit_log, 1 << unit_log + factor, method


def index_entries(index: bytes, kind: str) -> Iterator[tuple[int, int, bytes]]:
    """(position, size in units, key) of each block; a key's length is told by its first four bytes."""
    at = 8
    while at < len(index):
        if at + ENTRY.size > len(index):
            raise InputRefused("an index entry is cut off")
        position, size, _ = ENTRY.unpack_from(index, at)
        at += ENTRY.size
        n = key_length(kind, index[at : at + 4])
        if at + n > len(index):
            raise InputRefused("an index key is cut off")
        yield position, size, index[at : at + n]
        at += n


def index_arrays(index: bytes, kind: str, most: int = 10_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(number of the first, positions, sizes in units, keys) of the blocks, up to ``most`` at a time; keys of a fixed length are taken as they stand."""
    if kind == "u32" and (len(index) - 8) % 16 == 0:
        for i in range(0, (len(index) - 8) // 16, most):
            own = np.frombuffer(index, "<u4", min(4 * most, (len(index) - 8) // 4 - 4 * i), 8 + 16 * i).reshape(-1, 4)
            keys = np.ascontiguousarray(own[:, 3])
            yield i, own[:, 0].astype(np.int64), own[:, 1].astype(np.int64), pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, 4 * len(own) + 4, 4, dtype=np.int32)), pa.py_buffer(keys)])
        return
    i, listed = 0, index_entries(index, kind)
    while own := list(islice(listed, most)):
        places, sizes, keys = zip(*own, strict=True)
        yield i, np.array(places, np.int64), np.array(sizes, np.int64), pa.array(keys, pa.binary())
        i += len(own)


def parse_index(index: bytes, kind: str) -> tuple[int, int, int, list[tuple[int, int, bytes]]]:
    """(unit, block size, method, [(position, size in units, key)])"""
    return *index_layout(index, kind), list(index_entries(index, kind))


def _unpacked(raw: bytes, method: int, block_size: int) -> bytes:
    if method == NO_COMPRESSION:
        return raw
    size = payload_length(raw, method)
    return raw[4:size] if int.from_bytes(raw[:4], "little", signed=True) < 0 else unpack_lz4(raw[4:size], block_size)


def groups_of(blocks: list[tuple[int, bytes]], at: Callable[[int], bytes], method: int, block_size: int, kind: str) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first block, last block, key, objects) of consecutive blocks (number, key); ``at`` gives the bytes of the i-th. An oversized object's blocks are put together."""
    i = 0
    while i < len(blocks):
        raw = _unpacked(at(i), method, block_size)
        if len(raw) < 8:
            raise InputRefused("a block is shorter than its sizes")
        total, following = struct.unpack_from("<II", raw)
        first = i
        if total > block_size:
            raise InputRefused("a block claims more than a block")
        if total > 4 and following > block_size:  # one object over several blocks
            more = (following - 1) // block_size
            if i + more >= len(blocks):
                raise InputRefused("a group goes beyond the last block")
            if any(blocks[j][1] != blocks[i][1] for j in range(i + 1, i + 1 + more)):
                raise InputRefused("blocks of one group have different keys")
            raw = b"".join([raw, *(_unpacked(at(j), method, block_size) for j in range(i + 1, i + 1 + more))])
            total, i = following, i + more
        if total > len(raw):
            raise InputRefused("a block claims more than it holds")
        start = 4
        while start < total:
            end = int.from_bytes(raw[start : start + 4], "little")
            n = key_length(kind, raw[start + 4 : min(start + 8, end)])
            if end > total or start + 4 + n > end:
                raise InputRefused("a group goes beyond its block")
            yield blocks[first][0], blocks[i][0], raw[start + 4 : start + 4 + n], raw[start + 4 + n : end]
            start = end
        i += 1


def read_groups(data: bytes, index: bytes, kind: str) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first block, last block, key, objects) in file order."""
    if not index:
        if data:
            raise InputRefused("data without an index")
        return
    unit, block_size, method, entries = parse_index(index, kind)

    def at(i: int) -> bytes:
        position, size, _ = entries[i]
        raw = data[position * unit : (position + size) * unit]
        if len(raw) < size * unit:
            raise InputRefused("a block goes beyond the file")
        return raw

    yield from groups_of([(i, key) for i, (_, _, key) in enumerate(entries)], at, method, block_size, kind)


def write_map(indexes: list[tuple[int, int]]) -> tuple[bytes, bytes]:
    """(data, index) of (id, value) with ascending ids."""
    unit = 32 << 10
    header = struct.pack("<IBBH", MAP_VERSION, unit.bit_length() - 1, FACTOR_LOG, 0)
    blocks: dict[int, bytearray] = {}
    for number, value in indexes:
        struct.pack_into("<I", blocks.setdefault(number // MAP_IDS, bytearray(4 * MAP_IDS)), number % MAP_IDS * 4, value)
    entries, at = [], 0
    for block in range(max(blocks, default=-1) + 1):
        if block in blocks:
            entries.append(struct.pack("<II", at, 1 << FACTOR_LOG))
            at += 1 << FACTOR_LOG
        else:
            entries.append(struct.pack("<II", 0xFFFFFFFF, 1))
    return b"".join(bytes(blocks[b]) for b in sorted(blocks)), header + b"".join(entries)


def map_blocks_in_use(index: bytes) -> list[int]:
    if len(index) < 8 or len(index) % 8:
        raise InputRefused("a map index is cut off")
    return [i for i in range((len(index) - 8) // 8) if index[8 + 8 * i : 12 + 8 * i] != b"\xff" * 4]


ENTRIES = "file string, path string, block long, run long, start long, end long, key binary, unit int, block_size int, method int, length long"


#: Entries of an index that are read at a time: keys of a fixed length allow to begin anywhere.
EACH = 1 << 14


def _run_before(index, at: int) -> int:
    """The first of the consecutive blocks with the key of block ``at``, in an index of keys of four bytes."""
    key, step = index.read_at(4, 8 + 16 * at + ENTRY.size), 1
    while at > 0:
        n = min(at, step)
        differs = np.flatnonzero(np.frombuffer(index.read_at(16 * n, 8 + 16 * (at - n)), "<u4").reshape(-1, 4)[:, 3] != int.from_bytes(key, "little"))
        if len(differs):
            return at - n + int(differs[-1]) + 1
        at, step = at - n, min(step << 4, EACH)
    return 0


def _index_pieces(spark: SparkSession, folder: str) -> list[tuple]:
    """(file, path, length, index, first, n, method): ranges of the entries of each index, or a whole index (``n`` -1) where only reading it tells where entries begin."""
    found, out = {name: own for name, *own in files(spark, folder)}, []
    for file, (path, length) in found.items():
        if file.endswith(".bin"):
            index, size = found.get(f"{file}.idx", (None, 0))
            if not size:
                if length:
                    raise InputRefused(f"{file}: data without an index")
                continue
            with opened(index) as source:
                method = index_layout(source.read_at(min(8, size), 0), kind_of(file))[2]
            ranged = kind_of(file) == "u32" and (size - 8) % 16 == 0
            out += [(file, path, length, index, i, min(EACH, (size - 8) // 16 - i), method) for i in range(0, (size - 8) // 16, EACH)] if ranged else [(file, path, length, index, 0, -1, method)]
    return out


def _entries(spark: SparkSession, pieces: list[tuple], then=None, schema: str = ENTRIES) -> DataFrame:
    """The entries of these pieces, or what ``then`` makes of their batches in the same task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        types = (pa.string(), pa.string(), *[pa.int64()] * 4, pa.binary(), *[pa.int32()] * 3, pa.int64())
        for batch in batches:
            for file, path, length, index, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "length", "index", "first", "n")), strict=True):
                with opened(index) as source:
                    idx = source.read() if n < 0 else source.read_at(8, 0) + source.read_at(16 * n, 8 + 16 * first)
                    run, prior = _run_before(source, first) if first else 0, None
                unit, block_size, method = index_layout(idx, kind_of(file))
                for i, places, sizes, keys in index_arrays(idx, kind_of(file)):
                    if int((places + sizes).max()) * unit > length:
                        raise InputRefused(f"{file}: a block goes beyond the file")
                    i += first
                    same = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
                    begins = np.concatenate([[prior is not None and keys[0].as_py() != prior], ~same])
                    runs = np.maximum.accumulate(np.where(begins, i + np.arange(len(places)), run))
                    run, prior = int(runs[-1]), keys[-1].as_py()
                    columns = (file, path, i + np.arange(len(places)), runs, places * unit, (places + sizes) * unit, keys, unit, block_size, method, length)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) if isinstance(x, np.ndarray) else pa.repeat(pa.scalar(x, t), len(places)) for x, t in zip(columns, types, strict=True)], names)

    types = {"file": pa.string(), "path": pa.string(), "length": pa.int64(), "index": pa.string(), "first": pa.int64(), "n": pa.int64(), "method": pa.int32()}
    return local(spark, pieces, **types).mapInArrow((lambda batches: then(rows(batches))) if then else rows, schema)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each block that the indexes of a folder list (columns of ENTRIES). Only index files are read, in ranges where that can be.

    ``run``: the first of the consecutive blocks with one key, which a large group may span; ``length``: of the data file.
    """
    return _entries(spark, _index_pieces(spark, folder))


def _by_run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows in runs of blocks with one key; rows come by file and block."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and (row[0], row[3]) != (held[0][0], held[0][3]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


GROUPS = "file string, block long, last_block long, key binary, described string, objects binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of every block file of a folder (columns of GROUPS). Blocks are dealt by runs of one key and read by their ranges, so a file is read by many tasks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        types, path, source = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()), None, None
        out, held = [], 0
        for run in _by_run(batches, names):
            if run[0][1] != path:
                path, source = run[0][1], opened(run[0][1])
            file, kind = run[0][0], kind_of(run[0][0])
            at = lambda i, run=run, source=source: source.read_at(run[i][5] - run[i][4], run[i][4])
            for a, b, key, objects in groups_of([(r[2], r[6]) for r in run], at, run[0][9], run[0][8], kind):
                out.append((file, a, b, key, describe_key(kind, key), objects))
                held += len(objects)
                if held > 4 << 20 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in GROUPS.split(", ")])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in GROUPS.split(", ")])

    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return entries(spark, folder).repartitionByRange(parts, "file", "run").sortWithinPartitions("file", "block").mapInArrow(rows, GROUPS)


def described(kind: str, keys: pa.Array) -> pa.Array:
    """As ``describe_key`` of each key."""
    if kind != "u32" or not len(keys):
        return pa.array([describe_key(kind, k) for k in keys.to_pylist()], pa.string())
    values = np.frombuffer(b"".join(keys.to_pylist()), "<u4")
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[values[:, None] >> np.arange(28, -4, -4, dtype=np.uint32) & 15]
    text = np.concatenate([np.broadcast_to(np.frombuffer(b"0x", np.uint8), (len(values), 2)), digits], 1)
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(np.arange(0, 10 * len(values) + 10, 10, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, key, start, payload_end, end) of every block; of a compressed block its length is read, and of others nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            start, end = batch.column("start").to_numpy(), batch.column("end").to_numpy()
            used = end.copy()
            for i in np.flatnonzero((batch.column("method").to_numpy() != NO_COMPRESSION) & (end > start)).tolist():
                if (own := batch.column("path")[i].as_py()) != path:
                    path, source = own, opened(own)
                used[i] = start[i] + 4 + abs(int.from_bytes(source.read_at(4, int(start[i])), "little", signed=True))
                if used[i] > end[i]:
                    raise InputRefused("a block claims more than it spans")
            codes = batch.column("file").dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()] if len(codes) else []
            for a, b in zip(edges, [*edges[1:], len(codes)] if edges else [], strict=True):
                file, block, *places = (x[a:b] for x in (batch.column("file"), batch.column("block"), *map(pa.array, (start, used, end))))
                yield pa.RecordBatch.from_arrays([file, block, described(kind_of(file[0].as_py()), batch.column("key")[a:b]), *places], ["file", "block", "key", "start", "payload_end", "end"])

    schema = "file string, block long, key string, start long, payload_end long, end long"
    pieces = _index_pieces(spark, folder)
    plain = _entries(spark, [p for p in pieces if p[-1] == NO_COMPRESSION], rows, schema)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    packed = _entries(spark, [p for p in pieces if p[-1] != NO_COMPRESSION])
    dealt = packed.repartition(parts, "file", F.shiftright("block", 10)).sortWithinPartitions("file", "block")  # these are read
    return plain.unionByName(dealt.mapInArrow(rows, schema))


def map_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block) of the blocks in use of every map file of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.map.idx").load(folder).select(F.regexp_extract("path", "([^/]+?)[.]idx$", 1).alias("file"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                used = map_blocks_in_use(content)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(used), pa.string()), pa.array(used, pa.int64())], ["file", "block"])

    return found.mapInArrow(rows, "file string, block long")
