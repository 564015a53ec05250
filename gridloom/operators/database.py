"""Databases of block and map files: written with a commit, listed, compared, merged and held against expectations."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.checks import key_order_violations
from gridloom.operators.compare import gaps
from gridloom.operators.pack import Packer, joined, lengths
from gridloom.operators.storage import shared_dir, stored
from gridloom.sources import blockfile as B
from gridloom.sources.pbf import InputRefused
from gridloom.sources.ranges import Folder, listing, local, opened, writer

# Names of the files of a database, and of its areas.
VERSION_FILE, AREA_VERSION_FILE = "osm_base_version", "area_version"
KINDS = ("node", "way", "relation")
AREA_FILES = {"areas.bin": ("index", True), "area_blocks.bin": ("index", False), "area_tags_local.bin": ("local", False), "area_tags_global.bin": ("global", False)}


def file_set(nodes: bool, ways: bool, relations: bool) -> dict[str, bool]:
    """Names of the files that an import of these kinds of elements leaves, and whether its phase ran; a phase that others look things up in leaves its empty lookup files."""
    ran = {"node": nodes, "way": ways or nodes and not relations, "relation": nodes or ways or relations}
    out = {VERSION_FILE: True}
    for kind in KINDS:
        lookup = [f"{kind}s.bin", f"{kind}s.bin.idx", f"{kind}s.map", f"{kind}s.map.idx"]
        if ran[kind]:
            blocks = [f"{kind}s.bin", *(f"{kind}_{x}.bin" for x in ("tags_local", "tags_global", "keys", "frequent_tags")), *(["relation_roles.bin"] if kind == "relation" else [])]
            out |= dict.fromkeys([*lookup, *(x for b in blocks for x in (b, b + ".idx"))], True)
        elif kind != "relation" and (ran["relation"] or ran["way"]):
            out |= dict.fromkeys(lookup, False)
    return out


# Writing.

#: What is packed: blocks that a task has written to a file of its own (``kind`` 1 and 3), and groups whose blocks hang on other ranges (0: before the first flush of the range, 2: pending at its end).
PIECES = "file string, range int, kind int, seq int, path string, start long, bytes long, sizes binary, lens binary, keys binary, bodies binary"
HEAD, BODY, TAIL, CHAIN = range(4)


def blocks(groups: DataFrame, block: int, derived: list[str] | None = None) -> DataFrame:
    """Groups (file, order..., key, objects: array<binary>) dealt in ranges of their order, for ``write_block_files`` to pack.

    ``order`` is a column by which a file's groups are sorted. Groups without objects are left out. A large group may come in
    several rows, by ``part``, so that no row holds it. ``derived``: expressions of which keys and objects are made once rows are dealt
    (``Made``), so that neither the sample of the ranges nor the shuffle has them; a group must then have objects.
    """
    if "part" not in groups.columns:
        groups = groups.withColumn("part", F.lit(0))
    own = groups if derived else groups.filter("size(objects) > 0").select("file", "order", "part", "key", "objects")
    spark = groups.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = own.repartitionByRange(parts, "file", "order").sortWithinPartitions("file", "order", "part")
    return dealt.selectExpr("file", *(derived or ["key", "objects"]))


def _pressed(data: memoryview) -> Iterator[bytes]:
    """Bytes as they wait to be appended: pieces as lz4 data, each after its length, or after its length negative as it is if that is shorter."""
    codec = pa.Codec("lz4_raw")
    for i in range(0, len(data), PIECE << 3):
        own = data[i : i + (PIECE << 3)]
        packed = codec.compress(own, asbytes=True)
        yield from (struct.pack("<i", len(packed)), packed) if len(packed) < len(own) else (struct.pack("<i", -len(own)), own)


def _released(source, start: int, size: int) -> Iterator[bytes]:
    """The ``size`` bytes of which ``_pressed`` was written from ``start`` on, piece by piece."""
    codec = pa.Codec("lz4_raw")
    for i in range(0, size, PIECE << 3):
        (n,) = struct.unpack("<i", source.read_at(4, start))
        data = source.read_at(abs(n), start + 4)
        yield codec.decompress(data, min(PIECE << 3, size - i)) if n >= 0 else data
        start += 4 + abs(n)


@dataclass(frozen=True)
class Made:
    """Keys and objects that rows don't have yet: ``make`` gives batches of (file, key, objects) for batches of (file, ``columns``...). Flat columns are the cheapest to hand over."""

    columns: list[str]
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class _Pieces:
    """Rows of PIECES of a task, whose blocks go to a file of its own; there they are compressed, since they only wait to be put together."""

    def __init__(self, folder: str, block: int, method: int):
        self.path, self.unit, self.method = f"{folder}/{uuid.uuid4().hex}", block >> B.FACTOR_LOG, method
        self.sink, self.at, self.rows, self.seq = None, 0, [], 0

    def _row(self, file: str, part: int, kind: int, sizes: np.ndarray, lens: np.ndarray, **more) -> None:
        self.rows.append({"file": file, "range": part, "kind": kind, "seq": self.seq, "sizes": sizes.astype("<u4").tobytes(), "lens": lens.astype("<u4").tobytes(), **more})
        self.seq += 1

    def blocks(self, file: str, part: int, kind: int, keys: pa.Array, payloads: pa.Array) -> None:
        """Blocks as they are stored: compressed, and filled up to whole units."""
        if self.method == B.NO_COMPRESSION:
            sizes = lengths(payloads)
            room = -(-sizes // self.unit) * self.unit
            full = joined(payloads, B.zeros(room - sizes, self.unit))
            data = memoryview(full.buffers()[2])
        else:
            framed = [B.framed(x, self.method, self.unit) for x in payloads.to_pylist()]
            room, data = np.fromiter(map(len, framed), np.int64, len(framed)), b"".join(framed)
        if not self.sink:
            self.sink = writer(self.path)
        n, start = int(room.sum()), self.at
        for own in _pressed(memoryview(data)[:n]):
            self.sink.write(own)
            self.at += len(own)
        self._row(file, part, kind, room // self.unit, lengths(keys), path=self.path, start=start, bytes=n, keys=b"".join(keys.to_pylist()))

    def groups(self, file: str, part: int, kind: int, keys: pa.Array, bodies: pa.Array) -> None:
        """Groups as they are."""
        self._row(file, part, kind, lengths(bodies), lengths(keys), keys=b"".join(keys.to_pylist()), bodies=b"".join(bodies.to_pylist()))

    def taken(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows so far, if they are many or the ``last``; blocks are told once their file is whole."""
        if last and self.sink:
            self.sink.close()
        if self.rows and (last or sum(len(r.get("bodies") or b"") for r in self.rows) > 4 << 20):
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            names = [x.split()[0] for x in PIECES.split(", ")]
            held = [] if last else [r for r in self.rows if r["kind"] in (BODY, CHAIN)]
            for i in range(0, len(self.rows), 64):
                told = [r for r in self.rows[i : i + 64] if last or r["kind"] in (HEAD, TAIL)]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in told], t) for n, t in zip(names, types, strict=True)], names)
            self.rows = held


def _packed(batches: Iterator[pa.RecordBatch], folder: str, block: int, method: int, made=None) -> Iterator[pa.RecordBatch]:
    """A range of groups, packed from its first flush on; ``made`` gives their keys and objects."""
    part, at, packer, out = TaskContext.get().partitionId(), None, None, _Pieces(folder, block, method)

    def close():
        packer.close()
        if packer.pending:
            out.groups(at, part, TAIL, *packer.pending)

    for batch in made(batches) if made else batches:
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            file = files.dictionary[int(codes[a])].as_py()
            if file != at:
                if packer:
                    close()
                at, packer = file, Packer(block, partial(out.blocks, file, part, BODY), partial(out.groups, file, part, HEAD))
            packer.feed(batch.column("key")[a:b], batch.column("objects")[a:b])
        yield from out.taken()
    if packer:
        close()
    yield from out.taken(True)


def _chained(batches: Iterator[pa.RecordBatch], folder: str, block: int, method: int) -> Iterator[pa.RecordBatch]:
    """What is pending at the end of ranges, with the groups that follow up to a flush; these come many in a row."""
    at, packer, out = None, None, _Pieces(folder, block, method)
    for batch in batches:
        for file, chain, sizes, lens, keys, bodies in zip(*(batch.column(c).to_pylist() for c in ("file", "chain", "sizes", "lens", "keys", "bodies")), strict=True):
            if (file, chain) != at:
                if packer:
                    packer.finish()
                at, packer = (file, chain), Packer(block, partial(out.blocks, file, chain, CHAIN))
            packer.small(B.cut(keys, lens), B.cut(bodies, sizes))
        yield from out.taken()
    if packer:
        packer.finish()
    yield from out.taken(True)


def _appended(batches: Iterator[pa.RecordBatch], folder: str, block: int, method: int) -> Iterator[pa.RecordBatch]:
    """Pieces that come by file and in order to the bytes of their files, and the indexes beside them."""
    unit = block >> B.FACTOR_LOG
    at, sink, index, position, n, done = None, None, None, 0, 0, []

    def close():
        sink.close()
        index.close()
        done.append((at, n, position * unit))

    for batch in batches:
        for file, path, start, size, sizes, lens, keys in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "start", "bytes", "sizes", "lens", "keys")), strict=True):
            if file != at:
                if sink:
                    close()
                at, sink, index, position, n = file, writer(f"{folder}/{file}"), writer(f"{folder}/{file}.idx"), 0, 0
                index.write(B.index_header(block, method))
            with opened(path) as source:
                for own in _released(source, start, size):
                    sink.write(own)
            units = np.frombuffer(sizes, "<u4").astype(np.int64)
            places = position + np.cumsum(units) - units
            position += int(units.sum())
            if position > 1 << 32:
                raise ValueError(f"{file}: too many units for its index")
            index.write(b"".join(B.index_rows(places, units, B.cut(keys, lens)).to_pylist()))
            n += len(units)
    if sink:
        close()
    types = (pa.string(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [()] * 3, types, strict=True)], ["file", "blocks", "bytes"])


def write_block_files(dealt: DataFrame, folder: str, block: int, method: int = B.NO_COMPRESSION, made=None) -> DataFrame:
    """(file, blocks, bytes) of the files written, of groups as ``blocks`` deals them; ``made`` turns batches of derived groups into such of (file, key, objects).

    A task packs its range from the first flush on; what is pending at its end goes with the groups of the next ranges up to a
    flush, which are small and come in arrays. Blocks are written once by the tasks that pack them. A file is one run of bytes, so
    one task puts it together, copying bytes; different files are written at a time.
    """
    spark = dealt.sparkSession
    scratch_ = scratch(spark, "blocks")
    try:
        own = stored(dealt.mapInArrow(partial(_packed, folder=scratch_, block=block, method=method, made=made), PIECES), "pieces")
        ranges = sorted((r["file"], r["range"], r["most"]) for r in own.groupBy("file", "range").agg(F.max("kind").alias("most")).collect())  # a row a range
        if not ranges:
            return local(spark, [], file=pa.string(), blocks=pa.int64(), bytes=pa.int64())
        # the last range before with a flush, by whose end the groups before a range's first flush are packed
        found, flushed = [], {}
        for file, at, most in ranges:
            found.append((file, at, flushed.get(file, -1)))
            if most > HEAD:
                flushed[file] = at
        earlier = local(spark, found, file=pa.string(), range=pa.int32(), earlier=pa.int32())
        left = own.filter(F.col("kind").isin(HEAD, TAIL)).join(F.broadcast(earlier), ["file", "range"]).withColumn("chain", F.when(F.col("kind") == TAIL, F.col("range")).otherwise(F.col("earlier")))
        left = left.repartition("file", "chain").sortWithinPartitions("file", "chain", "range", "kind", "seq").select("file", "chain", "sizes", "lens", "keys", "bodies")
        chains = stored(left.mapInArrow(partial(_chained, folder=scratch_, block=block, method=method), PIECES), "chains")
        pieces = own.filter(F.col("kind") == BODY).unionByName(chains).drop("bodies")
        files = sorted({file for file, *_ in ranges})  # a few dozen
        number = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(files) for x in (f, i))), F.col("file"))
        each = pieces.repartitionById(len(files), number).sortWithinPartitions("file", "range", "kind", "seq")
        return stored(each.mapInArrow(partial(_appended, folder=folder, block=block, method=method), "file string, blocks long, bytes long"), "written")
    finally:
        Folder(spark, scratch_).remove()


def write_map_files(values: DataFrame, folder: str) -> list[str]:
    """Map files of (file, id, value), and their names: blocks of ids are made in parallel, then written one after the other; blocks without ids take no bytes."""
    unit = struct.pack("<IBBH", B.MAP_VERSION, 15, B.FACTOR_LOG, 0)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data = None, None

        def whole():
            return pa.RecordBatch.from_pydict({"file": [at[0]], "block": pa.array([at[1]], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

        for batch in batches:
            files = batch.column("file").dictionary_encode()
            codes, block, slot, value = (files.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("block", "slot", "value")))
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)], strict=True):
                if a == b:
                    continue
                own = files.dictionary[int(codes[a])].as_py(), int(block[a])
                if own != at:
                    if at:
                        yield whole()
                    at, data = own, np.zeros(B.MAP_IDS, dtype="<u4")
                data[slot[a:b]] = value[a:b]
        if at:
            yield whole()

    def appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sink, index, names = None, None, [], []

        def close():
            sink.close()
            with writer(f"{folder}/{at}.idx") as f:
                f.write(unit + b"".join(index))
            names.append(at)

        for batch in batches:
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data")), strict=True):
                if file != at:
                    if sink:
                        close()
                    at, sink, index, used = file, writer(f"{folder}/{file}"), [], 0
                index += [struct.pack("<II", 0xFFFFFFFF, 1)] * (block - len(index))
                index.append(struct.pack("<II", used << B.FACTOR_LOG, 1 << B.FACTOR_LOG))
                used += 1
                sink.write(data)
        if sink:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    placed = values.selectExpr("file", f"cast(id div {B.MAP_IDS} as long) as block", f"cast(id % {B.MAP_IDS} as int) as slot", "value")
    filled = placed.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(made, "file string, block long, data binary")
    return [r["file"] for r in stored(filled.repartition("file").sortWithinPartitions("file", "block").mapInArrow(appended, "file string"), "maps").collect()]  # a few


def empty_files(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Empty files, and the headers that indexes of map files have nevertheless."""
    for name in names:
        with writer(f"{folder}/{name}") as f:
            f.write(struct.pack("<IBBH", B.MAP_VERSION, 15, B.FACTOR_LOG, 0) if name.endswith(".map.idx") else b"")


def why_not_empty(names: list[str]) -> str | None:
    """Why a folder with these files can't take an import; None if it can."""
    if not names:
        return None
    names = sorted(names)
    shown = ", ".join(names) if len(names) <= 4 else f"{', '.join(names[:3])} and {len(names) - 3} others"
    if VERSION_FILE in names:
        return f"not empty ({shown}): a database is there, and it can't be added to"
    if any(n.endswith((".bin", ".idx", ".map")) or n.startswith(STAGING) for n in names):
        return f"not empty ({shown}): an import didn't end there; remove its files"
    return f"not empty ({shown})"


STAGING = ".staged-"


def commit(spark: SparkSession, out: str, version: str, write, name: str = VERSION_FILE) -> None:
    """Files that ``write(folder)`` makes in a staging folder beside ``out``, moved into it one by one; the version comes last, so without it a database is incomplete.

    A folder that holds files already is refused unless only the version of areas is to be added (``name``).
    """
    target = Folder(spark, out)
    held = target.names()
    if name == VERSION_FILE and (reason := why_not_empty(held)):
        raise InputRefused(f"{out}: {reason}")
    staging = Folder(spark, f"{out.rstrip('/')}/{STAGING}{uuid.uuid4().hex}")
    staging.make()
    try:
        write(staging.path)
        for file in staging.names():
            staging.move(file, target)
        staging.write(name, version + "\n")
        staging.move(name, target)
    finally:
        staging.remove()


def write_database(groups: DataFrame, out: str, version: str, block: int, method: int = B.NO_COMPRESSION, maps: DataFrame | None = None, files: dict[str, bool] | None = None, made: Made | None = None) -> None:
    """A database of groups (file, order, key, objects) and maps (file, id, value). ``files``: what must be there; those without content are written empty. ``made``: of groups that have neither keys nor objects yet."""
    spark = groups.sparkSession

    def write(folder: str) -> None:
        with ThreadPoolExecutor(1) as beside:  # map files are written while blocks are packed; an error of either ends both
            mapped = beside.submit(write_map_files, maps, folder) if maps is not None else None
            written = write_block_files(blocks(groups, block, made.columns if made else None), folder, block, method, made.make if made else None)
            names = {r["file"] for r in written.collect()} | set(mapped.result() if mapped else ())  # a few dozen
        empty_files(spark, folder, [n for n in files or {} if n != VERSION_FILE and n.removesuffix(".idx") not in names])

    commit(spark, out, version, write)


# Comparing.


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of two files byte by byte: differing bytes before and from ``used`` on, and the first of them. Pieces of which every byte counts are looked at together where they adjoin."""
    at, a, b = None, None, None
    for batch in batches:
        spans, out = [], []
        for r in zip(*(batch.column(c).to_pylist() for c in ("name", "path_a", "path_b", "start", "end", "method", "block", "counts")), strict=True):
            if spans and r[7] and not r[5] and spans[-1][7] and not spans[-1][5] and r[:3] == tuple(spans[-1][:3]) and r[3] == spans[-1][4] and r[4] - spans[-1][3] <= PIECE:
                spans[-1][4] = r[4]
            else:
                spans.append(list(r))
        for name, path_a, path_b, start, end, method, block, counts in spans:
            if (path_a, path_b) != at:
                at, a, b = (path_a, path_b), opened(path_a), opened(path_b)
            x, y = (f.read_at(end - start, start) for f in (a, b))
            used = B.payload_length(x, method) if method else len(x) if counts else 0
            first, other = None, 0
            if x != y:
                differs = np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)
                first, other = start + int(np.argmax(differs[:used])) if differs[:used].any() else None, int(differs[used:].sum())
            out.append((name, block, first, len(x) - used, other, bool(counts)))
        types = (pa.string(), *[pa.int64()] * 4, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True)], ["name", "block", "first", "ignored", "ignored_differing", "referenced"])


PIECE = 1 << 20


def compare(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(name, outcome, first_difference, padding_bytes, padding_differing, unreferenced_bytes, unreferenced_differing) of each file of two databases.

    ``only first``, ``only second``, ``identical``; ``equivalent``: of block files with equal indexes, differing only in bytes
    that nobody reads; else ``different``. Files are compared in pieces of PIECE bytes, block files block by block.
    """
    left, right = (listing(spark, f).select("name", F.col("path").alias(f"path_{x}"), F.col("length").alias(f"length_{x}")) for f, x in ((a, "a"), (b, "b")))
    files = stored(left.join(right, "name", "full_outer"), "files")
    both = files.filter("path_a is not null and path_b is not null")
    same_size = both.filter("length_a = length_b")
    pieces = same_size.filter("length_a > 0").select("name", "path_a", "path_b", F.explode(F.expr(f"sequence(0L, length_a - 1, {PIECE}L)")).alias("start"), "length_a")
    pieces = pieces.selectExpr("name", "path_a", "path_b", "start", f"least(start + {PIECE}, length_a) as end", "0 as method", "start as block", "true as counts")
    schema = "name string, block long, first long, ignored long, ignored_differing long, referenced boolean"
    plain = stored(_dealt(pieces).mapInArrow(_content, schema), "plain").groupBy("name").agg(F.min("first").alias("first"))
    outcome = files.join(plain, "name", "left").withColumn(
        "outcome",
        F.when(F.col("path_b").isNull(), "only first").when(F.col("path_a").isNull(), "only second").when(F.col("length_a") != F.col("length_b"), "different").when(F.col("first").isNull(), "identical").otherwise("different"),
    )
    outcome = stored(outcome, "outcomes")
    # block files that differ, with indexes that don't
    index_same = outcome.filter("name like '%.bin.idx' and outcome = 'identical'").select(F.expr("substring(name, 1, length(name) - 4)").alias("name"))
    again = outcome.filter("name like '%.bin' and outcome = 'different' and length_a = length_b").join(index_same, "name", "left_semi").select("name", "path_a", "path_b", "length_a")
    listed = stored(B.entries(spark, a).join(again.withColumnRenamed("name", "file"), "file").selectExpr("file as name", "path_a", "path_b", "start", "end", "method", "block", "true as counts", "length_a"), "listed")
    holes = gaps(listed.select(F.col("name").alias("file"), "start", "end"), again.select(F.col("name").alias("file"), F.col("length_a").alias("length")))
    holes = holes.join(again.withColumnRenamed("name", "file"), "file").select("file", "path_a", "path_b", F.explode(F.expr(f"sequence(gap_start, gap_end - 1, {PIECE}L)")).alias("start"), "gap_end")
    unread = holes.selectExpr("file as name", "path_a", "path_b", "start", f"least(start + {PIECE}, gap_end) as end", "0 as method", "-1L as block", "false as counts")
    found = stored(_dealt(listed.drop("length_a").unionByName(unread)).mapInArrow(_content, schema), "found")
    sums = found.groupBy("name").agg(
        F.min("first").alias("within"),
        *(F.sum(F.when(F.col("referenced") == which, F.col(c)).otherwise(0)).alias(f"{n}_{m}") for n, which in (("padding", True), ("unreferenced", False)) for c, m in (("ignored", "bytes"), ("ignored_differing", "differing"))),
    )
    names = ["padding_bytes", "padding_differing", "unreferenced_bytes", "unreferenced_differing"]
    whole = outcome.join(sums, "name", "left")
    equivalent = F.col("padding_bytes").isNotNull() & F.col("within").isNull()
    return whole.select("name", F.when(equivalent, "equivalent").otherwise(F.col("outcome")).alias("outcome"), F.when(~equivalent, F.coalesce("within", "first")).alias("first_difference"), *(F.when(equivalent, F.col(c)).cast("long").alias(c) for c in names))


def _dealt(pieces: DataFrame) -> DataFrame:
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "name", F.expr(f"start div {PIECE << 2}")).sortWithinPartitions("name", "start")


def verdict(report: DataFrame) -> tuple[int, str]:
    """Exit code and last line of a comparison: 0 equivalent, 1 different."""
    n = {r["outcome"]: r["n"] for r in report.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    differing = sum(n.get(x, 0) for x in ("different", "only first", "only second"))
    if differing:
        return 1, f"different: {differing} of {sum(n.values())} files"
    return 0, f"equivalent: {n.get('identical', 0)} files identical, {n.get('equivalent', 0)} but for ignored bytes"


def tsv(rows: DataFrame, order: list[str]) -> Iterator[str]:
    """Lines of a report with tabs between, its header first; rows are fetched a partition at a time."""
    yield "\t".join(rows.columns)
    for r in rows.orderBy(*order).toLocalIterator():
        yield "\t".join("" if x is None else str(x) for x in r)


# Merging.


def merge_preconditions(spark: SparkSession, shards: list[str], out: str) -> str:
    """The version that all shards' areas have; refuses if there are no shards, one has no areas, versions differ, or ``out`` has areas already or no database."""
    if not shards:
        raise InputRefused("no shards")
    target = Folder(spark, out)
    for name in (x for f in AREA_FILES for x in (f, f + ".idx")):
        if target.has(name):
            raise InputRefused(f"{out}: {name} is there already")
    if not target.has("nodes.bin"):
        raise InputRefused(f"{out}: no nodes.bin, so there is nothing that areas could belong to")
    versions = {}
    for s in shards:
        own = Folder(spark, s)
        if not own.has(AREA_VERSION_FILE):
            raise InputRefused(f"{s}: no {AREA_VERSION_FILE}")
        versions[s] = own.read(AREA_VERSION_FILE)
    if len(set(versions.values())) > 1:
        raise InputRefused(f"versions differ: {versions}")
    return next(iter(versions.values())).strip()


def layouts_agree(spark: SparkSession, shards: list[str]) -> dict[str, tuple[int, int]]:
    """Block size and compression of each area file that a shard has; refuses if shards differ."""
    found: dict[str, tuple[int, int]] = {}
    for s in shards:
        for r in B.entries(spark, s).select("file", "block_size", "method").distinct().collect():  # a row for each file
            own = (r["block_size"], r["method"])
            if found.setdefault(r["file"], own) != own:
                raise InputRefused(f"{r['file']}: layouts {found[r['file']]} and {own}")
    return found


def key_order(file: str) -> str:
    """Sort key of a file's keys, as an expression over ``key`` (binary, numbers lowest byte first)."""
    kind = AREA_FILES.get(file, (B.kind_of(file), False))[0]
    def number(at: int, n: int) -> str:
        turned = ", ".join(f"hex(substring(key, {at + i}, 1))" for i in reversed(range(n)))
        return f"cast(conv(concat({turned}), 16, 10) as long)"

    if kind in ("index", "u32"):
        return f"struct({number(1, 4)} & 2147483647 as a, {number(1, 4)} as b, binary('') as k, binary('') as v)"
    head = 7 if kind == "local" else 8
    text = f"substring(key, {head + 1}, {number(1, 2)}) as k, substring(key, {head + 1} + {number(1, 2)}, {number(3, 2)}) as v"
    if kind == "local":
        return f"struct({number(5, 3)} & 8388607 as a, {number(5, 3)} as b, {text})"
    return f"struct({text}, {number(5, 4)} as a, {number(5, 4)} as b)"


def shard_objects(groups: DataFrame, shard: int) -> DataFrame:
    """Objects (shard, file, key, seq, id, object) of the groups of area files as ``blockfile.read`` gives them; refuses records that don't fill their group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, block, key, objects in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "key", "objects")), strict=True):
                starts = B.record_starts(B.RECORDS[file], objects)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(objects)], strict=False)):
                    out.append((shard, file, key, block * (1 << 32) + i, int.from_bytes(objects[a : a + 4], "little"), objects[a:b]))
            types = (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True)], ["shard", "file", "key", "seq", "id", "object"])

    return groups.filter(F.col("file").isin(*AREA_FILES)).select("file", "block", "key", "objects").mapInArrow(rows, "shard int, file string, key binary, seq long, id long, object binary")


def merged_objects(objects: DataFrame) -> DataFrame:
    """objects with their place under their key: by id, then by shard, then as they stood."""
    order = Window.partitionBy("file", "key").orderBy("id", "shard", "seq")
    return objects.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def repeated_areas(objects: DataFrame) -> DataFrame:
    """(file, key, id, n): areas that have more than one object under a key of a file where each may have one."""
    single = [f for f, (_, one) in AREA_FILES.items() if one]
    return objects.filter(F.col("file").isin(*single)).groupBy("file", "key", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_areas(spark: SparkSession, shards: list[str], out: str) -> None:
    """The four area files of shards merged into the database ``out``: staged, then moved in, their version last."""
    version, layouts = merge_preconditions(spark, shards, out), layouts_agree(spark, shards)
    read = (B.read(spark, s).filter(F.col("file").isin(*AREA_FILES)).withColumn("shard", F.lit(i)) for i, s in enumerate(shards))
    groups = stored(reduce(DataFrame.unionByName, read), "groups")
    for file in (f for f in AREA_FILES if f in layouts):
        own = groups.filter(F.col("file") == file).select("shard", "block", F.expr(key_order(file)).alias("order"))
        # a key that is too large for a block has several groups
        found = key_order_violations(own, "shard", "block", "order").filter("prior.order <> order").select("shard").limit(1).collect()
        if found:
            raise InputRefused(f"{shards[found[0]['shard']]}: keys of {file} descend")
    objects = stored(reduce(DataFrame.unionByName, (shard_objects(groups.filter(F.col("shard") == i), i) for i in range(len(shards)))), "objects")
    if not repeated_areas(objects).isEmpty():
        raise InputRefused("an area is in several shards")

    def write(folder: str) -> None:
        for file, (block, method) in layouts.items():
            if file in AREA_FILES:
                own = objects.filter(F.col("file") == file).groupBy("file", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "shard", "seq", "object"))), lambda x: x["object"]).alias("objects"))
                write_block_files(blocks(own.withColumn("order", F.expr(key_order(file))), block), folder, block, method).count()

    commit(spark, out, version, write, AREA_VERSION_FILE)


# Expectations.


@dataclass(frozen=True)
class Expect:
    """One predicate on a database: ``what`` of ``file`` (and ``key``) against ``wanted``."""

    what: str
    file: str = ""
    key: str = ""
    wanted: object = None


SAMPLE = 5


def expectations(spark: SparkSession, folder: str, wanted: list[Expect], log: str = "") -> DataFrame:
    """(n, what, file, ok, found) of each expectation, in their order; found tells the value that was held against the wanted one.

    What is looked at is summed up once for all expectations: a row for each file, and the keys that are asked for. What stands
    under one key is one group, also where it takes several blocks.
    """
    files = {r["name"]: r["length"] for r in listing(spark, folder).collect()}  # a few dozen rows
    groups = stored(B.read(spark, folder).select("file", "block", "last_block", "key", "described", F.octet_length("objects").cast("long").alias("bytes")), "groups")
    spans = groups.select("file", "key", F.explode(F.sequence("block", "last_block")).alias("b")).distinct().groupBy("file", "key").agg(F.count(F.lit(1)).alias("blocks"))
    widest = {r["file"]: r["n"] for r in spans.groupBy("file").agg(F.max("blocks").alias("n")).collect()}
    sums = {r["file"]: r for r in groups.groupBy("file").agg(F.countDistinct("key").alias("groups"), F.sum("bytes").alias("bytes")).collect()}
    blocks_ = {r["file"]: r["n"] for r in B.entries(spark, folder).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    maps = {r["file"]: r["n"] for r in B.map_blocks(spark, folder).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = [x.key for x in wanted if x.key]
    keys = {(r["file"], r["described"]): r["n"] for r in groups.filter(F.col("described").isin(*asked)).groupBy("file", "described").agg(F.sum("bytes").alias("n")).collect()} if asked else {}
    index = F.expr("cast(conv(substring(described, 3), 16, 10) as long)")
    from gridloom.functions.position import class_of

    classes: dict[str, set[str]] = {}
    for r in groups.filter("described rlike '^0x[0-9a-f]{8}$'").select("file", class_of(index).alias("class")).distinct().collect():
        classes.setdefault(r["file"], set()).add(r["class"])

    def key_set(x: Expect) -> tuple[bool, str]:
        own, other = groups.filter(F.col("file") == x.file).select("described").distinct(), x.wanted.select("described").distinct()
        missing, extra = other.exceptAll(own), own.exceptAll(other)
        a, b = ([r["described"] for r in df.orderBy("described").limit(SAMPLE).collect()] for df in (missing, extra))
        return not a and not b, f"missing {a}, unexpected {b}"

    def value(x: Expect):
        one = sums.get(x.file)
        match x.what:
            case "file count":
                return len(files)
            case "present" | "absent":
                return x.file in files
            case "empty" | "least file bytes":
                return files.get(x.file)
            case "least blocks":
                return blocks_.get(x.file, 0)
            case "least map blocks":
                return maps.get(x.file, 0)
            case "least groups" | "group count":
                return one["groups"] if one else 0
            case "split key":
                return widest.get(x.file, 0)
            case "has key":
                return (x.file, x.key) in keys
            case "has classes":
                return sorted(classes.get(x.file, ()))
            case "object bytes":
                return one["bytes"] if one else 0
            case "key bytes":
                return keys.get((x.file, x.key), 0)
            case "log contains":
                return str(x.wanted) in log
            case "all decode":
                return sum(r["groups"] for r in sums.values())  # reading has raised otherwise
        raise ValueError(x.what)

    rows = []
    for n, x in enumerate(wanted):
        if x.what == "key set":
            ok, found = key_set(x)
        else:
            got = value(x)
            if x.what.startswith("least"):
                ok = got is not None and got >= x.wanted
            elif x.what in ("present", "has key", "log contains"):
                ok = got
            elif x.what == "absent":
                ok = not got
            elif x.what == "empty":
                ok = got == 0
            elif x.what == "split key":
                ok = got >= 2
            elif x.what == "has classes":
                ok = set(x.wanted) <= set(got)
            elif x.what == "all decode":
                ok = True
            else:
                ok = got == x.wanted
            found = str(got)
        rows.append((n, x.what, x.file, bool(ok), found))
    return spark.createDataFrame(rows, "n int, what string, file string, ok boolean, found string")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def parse_size(text: str) -> int:
    """Bytes of a size such as 64K, 2g or 100."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits, unit = (text[:-1], units[text[-1].lower()]) if text and text[-1].lower() in units else (text, 1)
    if not digits.isascii() or not digits.isdigit() or not 0 < int(digits) * unit < 1 << 63:
        raise ValueError(f"not a size: {text!r}")
    return int(digits) * unit
