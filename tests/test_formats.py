"""Binary formats: round trips, equal encodings, and input that is refused."""

import random
import zlib

import pytest

from gridloom.operators.pack import Group, block_ends
from gridloom.sources import blockfile, generate, pbf

GRAPH = [
    (1, 1, 10, 20, None, None, []),
    (1, 2, -5, 7, None, None, [("name", ""), ("", "x")]),
    (1, 3, 900_000_000, -1_800_000_000, None, None, []),
    (2, 10, None, None, [1, 2, 3, 3], None, [("highway", "residential")]),
    (3, 20, None, None, None, [(1, 1, "stop"), (2, 10, "outer"), (3, 20, "")], [("type", "multipolygon")]),
]


def decoded(data):
    rows = [r for kind, blob in pbf.blobs(data) if kind == pbf.DATA_BLOB for r in pbf.decode_block(pbf.inflate(blob))]
    return [(k, i, a, o, refs, None if m is None else [(x["kind"], x["ref"], x["role"]) for x in m], [(t["k"], t["v"]) for t in tags]) for k, i, a, o, refs, m, tags in rows]


@pytest.mark.parametrize("options", [{}, {"raw": True}, {"per_block": 1}, {"timestamp": 1_767_302_490}])
def test_round_trip(options):
    assert decoded(pbf.encode(GRAPH, **options)) == GRAPH


def test_read_by_spark(spark, tmp_path):
    (tmp_path / "g.pbf").write_bytes(pbf.encode(GRAPH, per_block=2))
    got = pbf.read(spark, str(tmp_path / "g.pbf")).orderBy("block", "pos").collect()
    assert [r.id for r in got] == [1, 2, 3, 10, 20]
    assert got[3].refs == [1, 2, 3, 3] and [m.role for m in got[4].members] == ["stop", "outer", ""]


def block(*parts):
    return b"".join(parts)


def refused(data):
    with pytest.raises(pbf.InputRefused):
        decoded(data)


def test_refusals():
    good = pbf.encode(GRAPH)
    for cut in (2, 5, len(good) - 1):
        refused(good[:cut])
    refused(b"\xff\xff\xff\xff" + good)
    refused(b"<osm version='0.6'>" * 5)
    f, p, d = pbf._field, pbf._packed, pbf._deltas
    table = f(1, f(1, b"") + f(1, b"k"))
    dense = lambda ids, lats, lons, kv=(): f(2, f(2, p(1, d(ids)) + p(8, d(lats)) + p(9, d(lons)) + p(10, list(kv))))
    for content in (
        table + table + dense([1], [0], [0]),
        table + dense([0], [0], [0]),
        table + dense([-3], [0], [0]),
        table + dense([1, 2], [0], [0, 0]),
        table + dense([1], [0], [0], [1]),
        table + dense([1], [0], [0], [9, 1, 0]),
        table + dense([1], [0], [0]) + f(17, 1) + f(19, 50),
        f(1, f(1, b"\xff")) + dense([1], [0], [0]),
        table + f(2, f(3, f(1, 1 << 32) + p(8, d([1])))),
        table + f(2, f(3, f(1, 5) + p(2, [1]) + p(8, d([1])))),
        table + f(2, f(4, f(1, 5) + p(8, [0]) + p(9, d([1])) + p(10, [7]))),
        table + f(2, f(4, f(1, 5) + p(8, [0, 0]) + p(9, d([1])) + p(10, [0]))),
        table + f(2, f(3, f(1, 5) + f(4, f(6, 0)))),
    ):
        with pytest.raises(pbf.InputRefused):
            pbf.decode_block(content)
    with pytest.raises(pbf.InputRefused):
        pbf.inflate(f(2, 3) + f(3, zlib.compress(b"four")))
    for number in (4, 5, 6, 7):
        with pytest.raises(pbf.InputRefused):
            pbf.inflate(f(number, b"x"))
    with pytest.raises(pbf.InputRefused):
        pbf.check_header(f(4, b"HistoricalInformation"))
    assert pbf.check_header(f(4, b"DenseNodes") + f(32, 77)) == 77


def test_unpacked_numbers_and_value_zero():
    f, d = pbf._field, pbf._deltas
    unpacked = f(2, f(3, f(1, 5) + b"".join(f(8, x) for x in d([4, 9]))))
    assert pbf.decode_block(unpacked)[0][4] == [4, 9]
    table = f(1, f(1, b"") + f(1, b"k"))
    dense = f(2, f(2, pbf._packed(1, d([1, 2])) + pbf._packed(8, d([0, 0])) + pbf._packed(9, d([0, 0])) + pbf._packed(10, [1, 0, 0, 0])))
    assert [r[6] for r in pbf.decode_block(table + dense)] == [[{"k": "k", "v": ""}], []]


def test_block_files():
    rng = random.Random(5)
    for _ in range(40):
        groups = [Group(k.to_bytes(4, "little"), [rng.randbytes(rng.choice([5, 12, 40, 300, 3000])) for _ in range(rng.randint(0, 60))]) for k in range(rng.randint(0, 60))]
        data, index = blockfile.write_blocks(groups, 1 << 10)
        found = {}
        for _, _, key, objects in blockfile.read_groups(data, index, "u32"):
            found.setdefault(key, []).append(objects)
        for g in groups:
            small = b"".join(x for x in g.objects if len(x) + 12 < 1 << 10)
            large = b"".join(x for x in g.objects if len(x) + 12 >= 1 << 10)
            assert b"".join(found.get(g.key, [])) == small + large


def test_block_ends_fit():
    rng = random.Random(6)
    for _ in range(2000):
        room = 252
        sizes = [rng.randint(8, 120) for _ in range(rng.randint(1, 40))]
        ends = block_ends(sizes, room + 4)
        assert ends[-1] == len(sizes) and ends == sorted(set(ends))
        assert all(sum(sizes[a:b]) <= room for a, b in zip([0, *ends], ends))


def test_maps_and_lz4():
    data, index = blockfile.write_map([(1, 7), (3 * 65_536 + 2, 9)])
    assert blockfile.map_blocks_in_use(index) == [0, 3] and len(data) == 2 * 4 * 65_536
    assert blockfile.unpack_lz4(bytes([0x50]) + b"hello", 100) == b"hello"
    assert blockfile.unpack_lz4(bytes([0x14]) + b"a" + b"\x01\x00" + bytes([0x10]) + b"b", 100) == b"a" * 9 + b"b"
    for bad in (bytes([0x50]) + b"hel", bytes([0x10]) + b"a" + b"\x05\x00", bytes([0xF0])):
        with pytest.raises(pbf.InputRefused):
            blockfile.unpack_lz4(bad, 100)


def test_keys():
    assert blockfile.describe_key("local", blockfile.local_key(0x12345, "a", "b")) == '0x012345 "a"="b"'
    assert blockfile.describe_key("global", blockfile.global_key("a", "b")) == '"a"="b" 0x00000000'


def test_folder_scan(spark, tmp_path):
    data, index = blockfile.write_blocks([Group((7).to_bytes(4, "little"), [b"x" * 12])], 1 << 12)
    (tmp_path / "nodes.bin").write_bytes(data)
    (tmp_path / "nodes.bin.idx").write_bytes(index)
    (row,) = blockfile.read(spark, str(tmp_path)).collect()
    assert (row.file, row.described, bytes(row.objects)) == ("nodes.bin", "0x00000007", b"x" * 12)


@pytest.mark.parametrize("name", sorted(generate.PROFILES))
def test_generated(spark, name):
    p = generate.PROFILES[name]
    small = generate.Profile(**{**p.__dict__, "nodes": 500, "ways": 100, "relations": 80})
    a, b = (generate.nodes(spark, small, 3).orderBy("id").collect() for _ in range(2))
    assert a == b and 0 < len(a) < 500
    assert generate.nodes(spark, small, 4).orderBy("id").collect() != a
    assert generate.ways(spark, small, 3).filter("size(refs) = 0").count() == 0
    assert generate.relations(spark, small, 3).count() == 80
