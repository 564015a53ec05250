"""Packing of arrays of groups: as group by group, whatever ranges and batches they come in; blocks are written once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import database as D, pack
from gridloom.operators.storage import shared_dir
from gridloom.plans.database import _region_ids
from gridloom.sources import blockfile as B
from gridloom.sources.ranges import Folder


def rows_of(rng, block):
    """(key, objects) of sorted groups, some of a block and more, some in several rows."""
    rows, large = [], rng.choice([0, 0.02, 0.3])
    for n in range(rng.randint(0, 150)):
        sizes = [0, 1, 4, 12] + ([block // 2, block - 13, block - 12, block, 3 * block] if rng.random() < large else [])
        objects = [rng.randbytes(rng.choice(sizes)) for _ in range(rng.choice([1, 1, 2, 5] + [60] * (rng.random() < large)))]
        key = n.to_bytes(4, "big") * rng.choice([1, 2])
        while objects:
            cut = rng.randint(1, len(objects))
            rows.append((key, objects[:cut]))
            objects = objects[cut:]
    return rows


def feed(packer, rows, rng):
    while rows:
        n = rng.choice([1, 3, 50, 1000])
        packer.feed(pa.array([k for k, _ in rows[:n]], pa.binary()), pa.array([o for _, o in rows[:n]], pa.list_(pa.binary())))
        rows = rows[n:]


@pytest.mark.parametrize("ranges", [1, 4])
def test_packer(ranges):
    """Arrays give the blocks that groups give one by one, also if ranges are packed apart from their first flush on."""
    for seed in range(200):
        rng = random.Random(seed)
        block = rng.choice([64, 128, 1024])
        rows, out = rows_of(rng, block), []
        take = lambda to: lambda keys, payloads: to.extend(zip(keys.to_pylist(), payloads.to_pylist(), strict=True))
        keys = sorted({k for k, _ in rows})
        chain = pack.Packer(block, take(out))
        for i in range(ranges):
            own, body = set(keys[i * len(keys) // ranges : (i + 1) * len(keys) // ranges]), []
            packer = pack.Packer(block, take(body), chain.small)
            feed(packer, [r for r in rows if r[0] in own], rng)
            packer.close()
            if packer.head is None:  # a flush was met
                chain.finish()
                out += body
                chain = pack.Packer(block, take(out))
                if packer.pending:
                    chain.small(*packer.pending)
        chain.finish()
        assert out == list(pack.packed(rows, block))


def test_blocks_are_written_once(spark, tmp_path):
    """Blocks aren't kept in a table beside the files that tasks write, and those are removed."""
    before = set(Folder(spark, f"{shared_dir(spark)}/gridloom").names())
    rng = random.Random(1)
    rows = [(n, n.to_bytes(4, "little"), [rng.randbytes(9)]) for n in range(3000)]
    df = spark.createDataFrame(rows, "n int, key binary, objects array<binary>").selectExpr("'a.bin' as file", "n as order", "key", "objects")
    for method in (B.NO_COMPRESSION, B.LZ4):
        out = tmp_path / str(method)
        D.write_database(df, f"file://{out}", "v", 1024, method)
        assert ((out / "a.bin").read_bytes(), (out / "a.bin.idx").read_bytes()) == B.write_blocks([pack.Group(k, o) for _, k, o in rows], 1024, method)
    left = {n.split("-")[0] for n in set(Folder(spark, f"{shared_dir(spark)}/gridloom").names()) - before}
    assert left and not left & {"blocks", "ranges"}


def test_region_ids():
    """Objects of a list are in order, each once, also in a sliced batch."""
    lists = [[], [(7, 1), (7, 1), (5, 2), (7, 256)], [(1 << 40, 3)]]
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 3), pa.array(["v"] * 3), pa.array([0, 1, 2]), pa.array([[{"id": i, "region": r} for i, r in x] for x in lists], pa.list_(pa.struct([("id", pa.int64()), ("region", pa.int64())])))], ["k", "v", "part", "listed"])
    want = [sorted({(i, r.to_bytes(3, "little") + i.to_bytes(8, "little")) for i, r in x}) for x in lists]
    for at in (0, 1):
        (got,) = _region_ids(iter([batch.slice(at)]))
        assert got.column("objects").to_pylist() == [[o for _, o in x] for x in want[at:]]


@pytest.mark.parametrize("file", ["a.bin", "way_tags_local.bin", "way_tags_global.bin"])
def test_index_arrays(spark, tmp_path, file):
    """An index is read in arrays as entry by entry, and blocks that aren't compressed are laid out without being dealt by ranges."""
    kind = B.kind_of(file)
    key = {"u32": lambda n: n.to_bytes(4, "little"), "local": lambda n: B.local_key(n, "k" * (n % 3), "v"), "global": lambda n: B.global_key("k", "é" * (n % 5), n)}[kind]
    rows = [(file, n, key(n), [bytes(700 + n % 300)] * (4 if n == 20 else 1)) for n in range(1, 40)]
    for method in (B.NO_COMPRESSION, B.LZ4):
        out = tmp_path / str(method)
        D.write_database(spark.createDataFrame(rows, "file string, order int, key binary, objects array<binary>"), f"file://{out}", "v", 1024, method)
        index = (out / f"{file}.idx").read_bytes()
        unit, size, _, listed = B.parse_index(index, kind)
        arrays = [(i + j, *x) for i, *own in B.index_arrays(index, kind, 7) for j, x in enumerate(zip(*(y.tolist() for y in own), strict=True))]
        assert arrays == [(i, *x) for i, x in enumerate(listed)] and len(listed) == 42
        runs = {r.block: r.run for r in B.entries(spark, f"file://{out}").collect()}
        assert runs == {i: next(j for j in range(i + 1) if listed[j][2] == k) for i, (_, _, k) in enumerate(listed)}
        found = B.layout(spark, f"file://{out}")
        assert "rangepartitioning" not in found._jdf.queryExecution().toString()
        data = (out / file).read_bytes()
        want = [(i, B.describe_key(kind, k), p * unit, p * unit + B.payload_length(data[p * unit : (p + n) * unit], method), (p + n) * unit) for i, (p, n, k) in enumerate(listed)]
        assert sorted((r.block, r.key, r.start, r.payload_end, r.end) for r in found.collect()) == want


def test_adjoining_pieces(tmp_path):
    """Pieces of which every byte counts are read together where they adjoin, and give the first difference of any."""
    data = random.Random(2).randbytes(4000)
    other = bytearray(data)
    other[1234] ^= 1
    other[3990] ^= 1
    for name, own in (("a", data), ("b", bytes(other))):
        (tmp_path / name).write_bytes(own)
    spans = [(i, i + 100, True) for i in range(0, 3000, 100)] + [(3500, 3600, True), (3600, 4000, False)]
    columns = ["f.bin"], [str(tmp_path / "a")], [str(tmp_path / "b")]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c * len(spans)) for c in columns), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans]), pa.array([0] * len(spans), pa.int32()), pa.array(range(len(spans))), pa.array([s[2] for s in spans])], ["name", "path_a", "path_b", "start", "end", "method", "block", "counts"])
    (got,) = D._content(iter([batch]))
    assert [(r["first"], r["ignored"], r["ignored_differing"], r["referenced"]) for r in got.to_pylist()] == [(1234, 0, 0, True), (None, 0, 0, True), (None, 400, 1, False)]


def test_map_files(spark, tmp_path):
    """Map files of several batches and with blocks that have no ids are as those made in one call; ids are placed in arrays, not one by one."""
    rng, whole = random.Random(3), {}
    for file in ("a.map", "b.map"):
        whole[file] = sorted((i, rng.randrange(1 << 32)) for i in rng.sample(range(5 << 16), 20_000) if not 1 << 16 <= i < 3 << 16)
    df = spark.createDataFrame([(f, *x) for f, own in whole.items() for x in own], "file string, id long, value long")
    D.write_map_files(df, f"file://{tmp_path}")
    for file, own in whole.items():
        assert ((tmp_path / file).read_bytes(), (tmp_path / f"{file}.idx").read_bytes()) == B.write_map(own)
    assert sorted((r.file, r.block) for r in B.map_blocks(spark, f"file://{tmp_path}").collect()) == [(f, i) for f in whole for i in (0, 3, 4)]


def test_index_in_ranges(spark, tmp_path, monkeypatch):
    """One index of keys of a fixed length is read by several tasks, and a run of one key is told across their ranges; blocks that aren't compressed take one step without a shuffle."""
    rows = [("a.bin", n, n.to_bytes(4, "little"), [bytes(700 + n % 300)] * (30 if n == 9 else 1)) for n in range(1, 40)]
    D.write_database(spark.createDataFrame(rows, "file string, order int, key binary, objects array<binary>"), f"file://{tmp_path}/d", "v", 1024)
    monkeypatch.setattr(B, "EACH", 4)
    found = B.entries(spark, f"file://{tmp_path}/d").withColumn("task", F.spark_partition_id()).collect()
    *_, listed = B.parse_index((tmp_path / "d" / "a.bin.idx").read_bytes(), "u32")
    assert {r.block: r.run for r in found} == {i: next(j for j in range(i + 1) if listed[j][2] == k) for i, (_, _, k) in enumerate(listed)}
    assert len(listed) == 68 and len({r.task for r in found}) > 1
    plain = B.layout(spark, f"file://{tmp_path}/d").filter("payload_end = end")
    (steps, _) = plain._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert steps.count("MapInArrow") == 2  # one over what isn't compressed, and one over what is, after its shuffle


def test_waiting_pieces(tmp_path, monkeypatch):
    """Blocks wait in compressed pieces, and come out of these as they went in."""
    monkeypatch.setattr(D, "PIECE", 1 << 7)
    rng = random.Random(5)
    for data in (b"", b"x" * 5000, rng.randbytes(3000), b"x" * 1024 + rng.randbytes(1500)):
        held = b"".join(D._pressed(memoryview(data)))
        (tmp_path / "p").write_bytes(b"before" + held)
        with D.opened(str(tmp_path / "p")) as source:
            assert b"".join(D._released(source, 6, len(data))) == data
    assert len(b"".join(D._pressed(memoryview(b"x" * 5000)))) < 500


def test_made_after_dealing(spark, tmp_path):
    """Objects that are made once rows are dealt aren't in the sample or the shuffle, and give the files that the same objects give."""
    from gridloom.plans import database

    rows = [(f"f{i % 2}.bin", i, 700 + i % 300, i % 7 == 0) for i in range(1, 60)]
    dealt = D.blocks(spark.createDataFrame(rows, "file string, order long, n int, other boolean"), 1024, database.TEXTS.columns)
    assert "objects" not in dealt._jdf.queryExecution().toString()
    texts = {(f, i): b"x" * 99 + (b"y" if o else b"x") + b"x" * (n - 100) for f, i, n, o in rows}
    D.write_block_files(dealt, f"file://{tmp_path}/a", 1024, made=database.TEXTS.make).count()
    D.write_block_files(D.blocks(spark.createDataFrame([(f, i, i.to_bytes(4, "little"), [x]) for (f, i), x in texts.items()], "file string, order long, key binary, objects array<binary>"), 1024), f"file://{tmp_path}/b", 1024).count()
    for name in ("f0.bin", "f0.bin.idx", "f1.bin", "f1.bin.idx"):
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes() != b""


def test_keys_and_objects_of_rows():
    """Keys and objects that are made of the rows' numbers, of whole and of sliced batches, are those of each row by itself."""
    from gridloom.plans import database

    little, region = (lambda x, n: x.to_bytes(n, "little")), lambda i: i.to_bytes(3, "big") + i.to_bytes(8, "little")
    rows = [("node_tags_global.bin", 0, 4, 0, 1, b"k\xc3\xa9v", b"".join(map(region, range(3)))), ("node_tags_global.bin", 0, 4, 0, 0, b"", region(9)), ("nodes.bin", 0xFFFFFFFE, 1 << 40, 0x01020304, 0, b"", None), ("nodes.bin", 5, 7, 0, 0, b"", None), ("way_tags_local.bin", 0x123456, 8, 0, 2, b"kkv", None), ("ways.bin", 0xFE, 0xFFFFFFFF, 0, 0, b"", None)]
    want = [
        (rows[0][0], B.global_key("k", "év"), [region(i) for i in range(3)]),
        (rows[1][0], B.global_key("", ""), [region(9)]),
        ("nodes.bin", little(0xFFFFFFFE, 4), [little(1 << 40, 8) + b"\1\2\3\4"]),
        ("nodes.bin", little(5, 4), [little(7, 8) + bytes(4)]),
        ("way_tags_local.bin", B.local_key(0x123456, "kk", "v"), [little(8, 4)]),
        ("ways.bin", little(0xFE, 4), [little(0xFFFFFFFF, 4)]),
    ]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "number", "id", "other", "n", "text", "data"])
    for at in range(len(rows) + 1):
        assert [tuple(r.values()) for b in database._made(iter([batch.slice(at)])) for r in b.to_pylist()] == want[at:]
