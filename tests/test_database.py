"""Databases: damage, refusals, commits, comparison, merging and expectations; windows across the borders of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.functions.hashes import SplitMix64, fnv1a
from gridloom.operators import checks, compare, database as D, datasets, pack, shards
from gridloom.sources import blockfile as B
from gridloom.sources import generate, pbf
from gridloom.sources.ranges import Folder, listing

SCHEMA = "file string, order int, key binary, objects array<binary>"


def key(n):
    return n.to_bytes(4, "little")


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(4)
    rows = [(f, n, key(n), [rng.randbytes(4) * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 400]))]) for f in ("a.bin", "b.bin") for n in range(60)]
    rows += [("b.bin", 70, key(70), [b"z" * 5000, b"y" * 3]), ("b.bin", 71, key(71), [])]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method", [B.NO_COMPRESSION, B.LZ4])
def test_round_trip(spark, groups, tmp_path, method):
    """What is written by many tasks is what one call gives, and is read back by ranges."""
    rows, df = groups
    out = f"file://{tmp_path}/db"
    D.write_database(df, out, "v7", 1024, method)
    assert (tmp_path / "db" / D.VERSION_FILE).read_text() == "v7\n"
    assert not [n for n in Folder(spark, out).names() if n.startswith(".")]
    for f in ("a.bin", "b.bin"):
        data, index = B.write_blocks([pack.Group(k, o) for g, _, k, o in rows if g == f], 1024, method)
        assert (tmp_path / "db" / f).read_bytes() == data and (tmp_path / "db" / f"{f}.idx").read_bytes() == index
        got = [(r.block, r.last_block, bytes(r.key), bytes(r.objects)) for r in B.read(spark, out).filter(F.col("file") == f).collect()]
        assert sorted(got) == sorted(B.read_groups(data, index, "u32"))
    whole = {}
    for r in B.read(spark, out).orderBy("file", "block").collect():
        whole[r.file, bytes(r.key)] = whole.get((r.file, bytes(r.key)), 0) + len(r.objects)
    assert whole == {(f, k): sum(map(len, o)) for f, _, k, o in rows if o}


def test_group_in_several_rows(spark, groups, tmp_path):
    """A group that comes in rows of a few objects is written as the one that comes in one row."""
    rows = [(f, n, i, k, o[i : i + 7]) for f, n, k, o in groups[0] for i in range(0, len(o), 7)]
    D.write_database(groups[1], f"file://{tmp_path}/whole", "v", 1024, B.LZ4)
    D.write_database(spark.createDataFrame(rows, "file string, order int, part int, key binary, objects array<binary>"), f"file://{tmp_path}/parts", "v", 1024, B.LZ4)
    for f in ("a.bin", "a.bin.idx", "b.bin", "b.bin.idx"):
        assert (tmp_path / "parts" / f).read_bytes() == (tmp_path / "whole" / f).read_bytes()


def test_index_is_read_once():
    """Bytes that are copied while an index is read are a few times those that it has."""

    class Counted(bytes):
        copied = 0

        def __getitem__(self, i):
            out = super().__getitem__(i)
            Counted.copied += len(out) if isinstance(i, slice) else 1
            return out

    index = Counted(B.index_header(1024) + b"".join(B.ENTRY.pack(8 * i, 8, 0) + key(i) for i in range(5000)))
    assert len(B.parse_index(index, "u32")[3]) == 5000 and Counted.copied < 3 * len(index)


def test_unpacked_length():
    """What the codec unpacks is as long as what was packed, and data that are cut off are refused."""
    for data in (b"\x0a\0\0\0abcabc", b"\x0a\0\0\0abcabcabcabc", b"\xff\0\0\0ab" * 9, b"\0" * 1024, b"\x05\0\0\0a", b"ab"):
        own = B.pack_lz4(data)
        assert B.unpack_lz4(own, 1024) == B._unpack_bytewise(own, 1024) == data
    with pytest.raises(pbf.InputRefused):
        B.unpack_lz4(B.pack_lz4(random.Random(1).randbytes(500))[:-100], 1024)


@pytest.mark.parametrize("seed", range(5))
def test_lz4(seed):
    rng = random.Random(seed)
    for n in (0, 1, 4, 12, 13, 14, 100, 5000):
        data = b"".join(rng.choice([b"abc", b"\0" * 40, rng.randbytes(3), b"abcdabcd"]) for _ in range(n))[:n]
        assert B.unpack_lz4(B.pack_lz4(data), max(n, 1)) == data
    assert len(B.pack_lz4(b"ab" * 3000)) < 100
    raw = rng.randbytes(900)
    assert B.payload_length(B.framed(raw, B.LZ4, 128), B.LZ4) == 904 and len(B.framed(raw, B.LZ4, 128)) == 1024


def test_damage():
    """Whatever is wrong with a file is refused, not an error of the reader."""
    data, index = B.write_blocks([pack.Group(key(1), [b"x" * 3000]), pack.Group(key(2), [b"y" * 9])], 1024)
    blocks = len(B.parse_index(index, "u32")[3])
    assert blocks == 4
    entry = 16
    for d, i in (
        (data, index[: 8 + entry]),  # a group that goes on beyond the last block
        (data, index[: 8 + entry] + index[8 + entry : 8 + 2 * entry - 4] + key(9) + index[8 + 2 * entry :]),  # another key within a group
        (data[:1000], index), (data, index[:-1]), (b"", index), (data, b""),
        (b"\xff" * 8 + data[8:], index), (data[:-128] + (9).to_bytes(4, "little") + b"\xff" * 124, index),
    ):
        with pytest.raises(pbf.InputRefused):
            list(B.read_groups(d, i, "u32"))
    with pytest.raises(pbf.InputRefused):
        B.payload_length(b"\xff\xff\xff\x7f" + b"\0" * 60, B.LZ4)
    for layout, objects in ((4, b"12345"), (B.RECORDS["areas.bin"], key(1) + key(2) + key(3)), (B.RECORDS["area_blocks.bin"], b"12345")):
        with pytest.raises(pbf.InputRefused):
            B.record_starts(layout, objects)
    assert B.record_starts(B.RECORDS["area_blocks.bin"], key(1) + b"\2\0" + b"12345" * 2 + key(2) + b"\0\0") == [0, 16]
    assert B.describe_key("string", b"\2\0ab") == '"ab"' and B.kind_of("way_frequent_tags.bin") == "string" and B.kind_of("nodes.bin") == "u32"


def test_damaged_files_by_spark(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\0" * 100)
    (tmp_path / "x.bin.idx").write_bytes(b"")
    with pytest.raises(Exception, match="without an index"):
        B.read(spark, f"file://{tmp_path}").collect()
    (tmp_path / "p").mkdir()
    for content in (b"\0\0", b"\xff\xff\xff\xff", pbf.data_blob([(1, 1, 0, 0, None, None, [])]), pbf.header_blob()[:-3], b""):
        (tmp_path / "p" / "x.pbf").write_bytes(content)
        with pytest.raises(Exception, match="InputRefused"):
            pbf.read(spark, f"file://{tmp_path}/p").collect()


def test_files_are_decoded_once(spark, tmp_path, monkeypatch):
    """What is judged of map files comes of one decoding, so a plan over them has no Python step left."""
    from types import SimpleNamespace

    from gridloom.plans import database

    pbf.write(spark.createDataFrame([(1, i, i, i, None, None, []) for i in range(1, 40)], "kind int, id long, lat long, lon long, refs array<long>, members array<struct<kind int, ref long, role string>>, tags array<struct<k string, v string>>"), f"file://{tmp_path}/pbf", 2, 1, 7)
    monkeypatch.setattr(database, "_file", lambda g: f"file://{tmp_path}/pbf")
    found = database.pbf_order(SimpleNamespace(spark=spark))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(0, 39)]


def test_file_sets():
    assert {n: len(D.file_set(*n)) for n in ((0, 0, 0), (1, 1, 1), (1, 0, 0), (1, 0, 1), (0, 1, 0), (0, 0, 1))} | {(0, 0, 0): 1} == {(0, 0, 0): 1, (1, 1, 1): 39, (1, 0, 0): 39, (1, 0, 1): 31, (0, 1, 0): 31, (0, 0, 1): 23}


def test_commit(spark, groups, tmp_path):
    """Nothing is left of a write that fails; a folder in use is refused."""
    out = f"file://{tmp_path}/db"

    def fails(folder):
        D.write_block_files(D.blocks(groups[1], 1024), folder, 1024).count()
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        D.commit(spark, out, "v", fails)
    assert Folder(spark, out).names() == []
    D.commit(spark, out, "v", lambda f: D.empty_files(spark, f, ["x.map.idx"]))
    with pytest.raises(pbf.InputRefused, match="database is there"):
        D.commit(spark, out, "v", lambda f: None)
    assert D.why_not_empty([]) is None and "didn't end" in D.why_not_empty(["nodes.bin"]) and "2 others" in D.why_not_empty(list("abcde"))


def test_compare(spark, groups, tmp_path):
    paths = [f"file://{tmp_path}/{x}" for x in "ab"]
    for p in paths:
        D.write_database(groups[1], p, "v", 1024, B.LZ4)
    report = D.compare(spark, *paths)
    assert {r.outcome for r in report.collect()} == {"identical"} and D.verdict(report) == (0, "equivalent: 5 files identical, 0 but for ignored bytes")
    block = B.layout(spark, paths[0]).filter("payload_end < end and file = 'a.bin'").first()
    data = bytearray((tmp_path / "b" / "a.bin").read_bytes())
    data[block.end - 1] ^= 1
    (tmp_path / "b" / "a.bin").write_bytes(data)
    report = D.compare(spark, *paths)
    own = report.filter("name = 'a.bin'").head()
    assert own.outcome == "equivalent" and own.padding_differing == 1 and D.verdict(report)[0] == 0
    data[block.start + 5] ^= 1
    (tmp_path / "b" / "a.bin").write_bytes(data)
    report = D.compare(spark, *paths)
    own = report.filter("name = 'a.bin'").head()
    assert (own.outcome, own.first_difference) == ("different", block.start + 5) and D.verdict(report)[0] == 1
    lines = list(D.tsv(B.layout(spark, paths[0]).filter("file = 'a.bin'"), ["block"]))
    assert lines[0].split("\t") == ["file", "block", "key", "start", "payload_end", "end"] and lines[1].startswith("a.bin\t0\t0x00000000\t0\t")


def area(spark, folder, ids, version="a", block=1024):
    rows = [("areas.bin", 1, key(5), [key(i) + key(0) for i in ids])]
    D.commit(spark, folder, version, lambda f: D.write_block_files(D.blocks(spark.createDataFrame(rows, SCHEMA), block), f, block).count(), D.AREA_VERSION_FILE)


def test_merge(spark, groups, tmp_path):
    at = lambda x: f"file://{tmp_path}/{x}"
    for name, ids, options in (("one", [1, 4, 900], {}), ("two", [2, 3], {}), ("again", [4], {}), ("other", [7], {"version": "b"}), ("wide", [7], {"block": 2048})):
        area(spark, at(name), ids, **options)
    with pytest.raises(pbf.InputRefused, match="no nodes.bin"):
        D.merge_areas(spark, [at("one")], at("none"))
    D.write_database(groups[1].filter("file = 'a.bin'").withColumn("file", F.lit("nodes.bin")), at("out"), "v", 1024)
    for shards_, why in (([], "no shards"), ([at("one"), at("nothing")], "no area_version"), ([at("one"), at("other")], "versions differ"), ([at("one"), at("wide")], "layouts"), ([at("one"), at("again")], "several shards")):
        with pytest.raises(pbf.InputRefused, match=why):
            D.merge_areas(spark, shards_, at("out"))
    D.merge_areas(spark, [at("one"), at("two")], at("out"))
    got = D.shard_objects(B.read(spark, at("out")), 0).orderBy("seq").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 900]
    with pytest.raises(pbf.InputRefused, match="already"):
        D.merge_areas(spark, [at("one"), at("two")], at("out"))


def test_shards_are_read_together(spark, tmp_path, monkeypatch):
    """Keys of all shards are looked at in one go for each file that is there, and the shard whose keys descend is named."""
    at = lambda n: f"file://{tmp_path}/{n}"
    own = spark.createDataFrame([("nodes.bin", 1, key(1), [b"x" * 12])], SCHEMA)
    D.write_database(own, at("out"), "v", 1024)
    record = lambda n: n.to_bytes(4, "little") + bytes(4)
    for name, order in (("one", 1), ("two", -1)):
        rows = spark.createDataFrame([("areas.bin", order * n, key(n), [record(i)]) for n, i in ((5, 1 + order), (9, 5 + order))], SCHEMA)
        D.commit(spark, at(name), "a", lambda f, rows=rows: D.write_block_files(D.blocks(rows, 16), f, 16).count(), D.AREA_VERSION_FILE)
    asked, real = [], D.key_order_violations
    monkeypatch.setattr(D, "key_order_violations", lambda *a: asked.append(a) or real(*a))
    with pytest.raises(pbf.InputRefused, match="two: keys of areas.bin descend"):
        D.merge_areas(spark, [at("one"), at("two")], at("out"))
    assert len(asked) == 1


def test_expectations(spark, groups, tmp_path):
    out = f"file://{tmp_path}/db"
    D.write_database(groups[1], out, "v", 1024)
    keys = lambda *n: spark.createDataFrame([(f"0x{x:08x}",) for x in n], "described string")
    wanted = [D.Expect("split key", "b.bin"), D.Expect("key set", "a.bin", wanted=keys(*range(60))), D.Expect("key set", "a.bin", wanted=keys(*range(1, 70))), D.Expect("all decode"), D.Expect("least file bytes", "a.bin", wanted=1), D.Expect("least blocks", "a.bin", wanted=10**6)]
    got = D.expectations(spark, out, wanted).orderBy("n").collect()
    assert [r.ok for r in got] == [True, True, False, True, True, False]
    assert got[2].found == "missing ['0x0000003c', '0x0000003d', '0x0000003e', '0x0000003f', '0x00000040'], unexpected ['0x00000000']"
    assert listing(spark, out).count() == 5


def test_group_of_several_blocks(spark, groups, tmp_path):
    """What stands under one key is one group, however many blocks it takes."""
    out = f"file://{tmp_path}/db"
    D.write_database(groups[1], out, "v", 1024)
    assert B.read(spark, out).filter("file = 'a.bin'").count() > 60
    got = D.expectations(spark, out, [D.Expect("group count", "a.bin", wanted=60), D.Expect("least groups", "b.bin", wanted=62)]).orderBy("n").collect()
    assert [(r.ok, r.found) for r in got] == [(True, "60"), (False, "61")]


@pytest.mark.parametrize("seed", range(3))
def test_pack_sizes(spark, seed):
    """Blocks by sizes alone are those that the bytes are packed to, large groups included."""
    rng = random.Random(seed)
    rows = [(n, 8 + 4 * rng.choice([1, 10, 60, rng.randint(1, 250), rng.randint(250, 1500)])) for n in range(150)]
    want = sorted((int.from_bytes(k, "little"), int.from_bytes(p[:4], "little")) for k, p in pack.pack_groups([pack.Group(key(n), [b"four"] * ((s - 8) // 4)) for n, s in rows], 1024))
    df = spark.createDataFrame([(0, n, s) for n, s in rows], "file long, key long, size long")
    assert sorted((r.first_key, r.bytes) for r in pack.pack_sizes(df, "file", "key", "size", 1024, each=4).collect()) == want


def test_ranges(spark):
    """Sums, gaps, order and ranks are those of one window, wherever ranges begin."""
    rng = random.Random(9)
    rows = [(f, i, rng.randint(0, 50), rng.randint(0, 20)) for f in range(2) for i in range(400)]
    df = spark.createDataFrame(rows, "file int, seq int, size int, key int").repartition(7)
    sums = {(r.file, r.seq): r.start for r in shards.prefix_sums(df, "file", "seq", "size").collect()}
    assert all(sums[f, i] == sum(s for g, j, s, _ in rows if g == f and j < i) for f, i, _, _ in rows)
    bad = {(r.file, r.seq) for r in checks.key_order_violations(df, "file", "seq", "key").collect()}
    assert bad == {(b[0], b[1]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[3] >= b[3]}
    spans = df.selectExpr("file", "seq * 7 as start", "seq * 7 + size % 9 as end")
    covered = {f: {x for g, i, s, _ in rows if g == f for x in range(i * 7, i * 7 + s % 9)} for f in range(2)}
    found = {f: {x for r in compare.gaps(spans, spark.createDataFrame([(0, 2800), (1, 2900)], "file int, length int")).filter(F.col("file") == f).collect() for x in range(r.gap_start, r.gap_end)} for f in range(2)}
    assert found == {0: set(range(2800)) - covered[0], 1: set(range(2900)) - covered[1]}
    ranks = {(r.size, r.key): r.seq for r in shards.ranked(df.select("size", "key").distinct(), "size", "key").collect()}
    assert ranks == {k: n for n, k in enumerate(sorted({(s, k) for _, _, s, k in rows}))}


def test_time_in_any_zone(spark):
    rows = spark.createDataFrame([(1_767_302_490,), (0,), (-1,), (951_782_400,)], "s long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r.t for r in rows.select(P.iso_timestamp(F.col("s")).alias("t")).collect()] == ["2026-01-01T21:21:30Z", "1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "2000-02-29T00:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_texts(spark):
    """Characters that XML and JSON escape; elements without tags, refs or members; invalid positions."""
    odd = "a\"b<c>&'\t\n\r\\\x01é"
    schema = "kind int, id long, lat long, lon long, refs array<long>, members array<struct<kind:int,ref:bigint,role:string>>, tags array<struct<k:string,v:string>>"
    rows = spark.createDataFrame([(1, 1, -5, 10_000_000, None, None, []), (1, 2, 2_000_000_000, 0, None, None, [("k", odd)]), (2, 3, None, None, [], None, []), (3, 4, None, None, None, [(3, 4, odd)], [])], schema)
    xml = {r.id: r.xml for r in datasets.xml_elements(rows).collect()}
    assert xml[1] == '  <node id="1" lat="-0.0000005" lon="1.0000000"/>'
    assert xml[2] == '  <node id="2" lat="200.0000000" lon="0.0000000">\n    <tag k="k" v="a&quot;b&lt;c&gt;&amp;&apos;&#9;&#10;&#13;\\\x01é"/>\n  </node>'
    assert xml[3] == '  <way id="3">\n  </way>' and '<member type="relation" ref="4"' in xml[4]
    assert ' user="名前">' in {r.id: r.xml for r in datasets.xml_elements(rows.filter("id = 2").withColumn("tags", F.expr("slice(tags, 1, 1)")), True).collect()}[2].split("\n")[0].replace(' lat="200.0000000" lon="0.0000000"', "")
    import json

    lines = {r.id: json.loads(r.line, strict=True) for r in datasets.json_lines(rows).collect()}
    assert lines[2] == {"type": "node", "id": 2, "lat": 1_000_000_000, "lon": 2_000_000_000, "tags": {"k": odd}}
    assert lines[4]["members"] == [{"type": "relation", "ref": 4, "role": odd}] and lines[3]["nodes"] == []


def test_sizes_and_hashes():
    assert [D.parse_size(x) for x in ("1", "64K", "2g", "3M")] == [1, 65_536, 2 << 30, 3 << 20]
    for x in ("", "K", "0", "-1", "1.5M", "9999999999G", "²"):
        with pytest.raises(ValueError):
            D.parse_size(x)
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert SplitMix64(0).next() == 0xE220A8397B1DCDAF
    draw = SplitMix64(5)
    assert {draw.below(3) for _ in range(100)} == {0, 1, 2}


def test_profiles(spark):
    """Sizes as asked for; gaps between ids and strings of any script where a profile has them."""
    for name in ("mixed", "tags"):
        p = generate.PROFILES[name]
        nodes, ways = generate.nodes(spark, p, 3), generate.ways(spark, p, 3)
        assert ways.count() == p.ways and p.nodes * 0.8 < nodes.count() <= p.nodes
        assert ways.select(F.max(F.size("refs"))).head()[0] <= p.most_refs
    wild = generate.nodes(spark, generate.PROFILES["tags"], 3).select(F.explode("tags.v").alias("v")).filter("octet_length(v) > length(v)").count()
    assert wild > 0
    assert generate.nodes(spark, generate.PROFILES["mixed"], 3).agg(F.max("id")).head()[0] > generate.PROFILES["mixed"].nodes
