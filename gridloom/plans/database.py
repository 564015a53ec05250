"""Queries over files: graphs, databases and area files are written to the shared folder from the fixture graph, and read, compared, merged and judged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators import checks as V
from gridloom.operators import database as D
from gridloom.operators import datasets as E
from gridloom.operators import search as Q
from gridloom.operators import tags as T
from gridloom.operators.pack import Group, joined, lengths
from gridloom.operators.shards import every_nth_shard
from gridloom.operators.storage import stored
from gridloom.plans.graph import _ALL, _CTE, _GEO, _NODE_TAGS, _RELATION, _WAY_TAGS, Graph
from gridloom.plans.service import BOX
from gridloom.sources import blockfile as B
from gridloom.sources import pbf
from gridloom.sources.ranges import listing, writer

SECONDS = 1_767_302_490
BLOCK = 1 << 10


def _elements(g: Graph) -> DataFrame:
    return E.elements(g.raw_nodes, g.ways, g.relations, g.refs, g.members)


def _file(g: Graph) -> str:
    """A folder of map files with the fixture graph."""
    folder = D.scratch(g.spark, "pbf")
    pbf.write(_elements(g), folder, 6, SECONDS, 500)
    return folder


def pbf_read(g: Graph) -> DataFrame:
    """Every element of files that were written by ranges of ids and are read blob by blob."""
    text = lambda c, x: F.coalesce(F.array_join(F.transform(c, x), ","), F.lit(""))
    members = text("members", lambda m: F.concat_ws(":", m["kind"].cast("string"), m["ref"].cast("string"), m["role"]))
    return pbf.read(g.spark, _file(g)).select("kind", "id", "lat", "lon", F.when(F.col("kind") == 3, members).otherwise(text("refs", lambda r: r.cast("string"))).alias("parts"), text("tags", lambda t: F.concat_ws("=", t["k"], t["v"])).alias("tags"))


def pbf_headers(g: Graph) -> DataFrame:
    return pbf.read_header(g.spark, _file(g)).select("seconds", P.iso_timestamp(F.col("seconds")).alias("iso")).distinct()


def pbf_order(g: Graph) -> DataFrame:
    """Elements that don't follow the one before in their file, which is none; counted beside all."""
    read = pbf.read(g.spark, _file(g)).select(F.struct("file", "block").alias("block"), "pos", "kind", "id")
    own = stored(read, "elements")  # files are decoded once
    return V.order_violations(own).agg(F.count(F.lit(1)).alias("violations")).crossJoin(own.agg(F.count(F.lit(1)).alias("elements")))  # one row each


def staged_kinds(g: Graph) -> DataFrame:
    """Counts and ranges of ids from tables that are staged by kind, each read by itself."""
    kinds = pbf.stage(pbf.read(g.spark, _file(g)), D.scratch(g.spark, "kinds"))
    rows = [df.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest")).select(F.lit(k).alias("kind"), "n", "least", "greatest") for k, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _turned(c: Column | str, n: int) -> Column:
    """A number with its ``n`` bytes turned."""
    own = (F.col(c) if isinstance(c, str) else c).cast("long")
    return reduce(Column.bitwiseOR, (F.shiftleft(F.shiftright(own, 8 * i).bitwiseAND(F.lit(255)), 8 * (n - 1 - i)) for i in range(n)))


def _little(c: Column | str, n: int) -> Column:
    """Bytes of a number, lowest first: the number with its bytes turned, in hex."""
    return F.unhex(F.lpad(F.hex(_turned(c, n)), 2 * n, "0"))


def _joined(*parts: Column) -> Column:
    return F.concat(*parts)


def _region_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (id, region) as objects, each once: the region in three bytes, then the id in eight, by id and then as bytes."""
    for batch in batches:
        lists = batch.column("listed")
        begins, pairs = lists.offsets.to_numpy(), lists.values
        ids, regions = (pairs.field(c).to_numpy() for c in ("id", "region"))
        row = np.repeat(np.arange(len(lists)), np.diff(begins))
        pairs = np.stack([ids, regions], 1)[begins[0] : begins[-1]]
        raw = np.ascontiguousarray(pairs.astype("<i8")).view(np.uint8).reshape(-1, 16)
        turned = raw[:, 8].astype(np.int64) << 16 | raw[:, 9].astype(np.int64) << 8 | raw[:, 10]
        order = np.lexsort((turned, pairs[:, 0], row))
        data = np.concatenate([raw[:, 8:11], raw[:, :8]], 1)[order]
        own = row[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (data[1:] != data[:-1]).any(axis=1)
        data = np.ascontiguousarray(data[new])
        objects = pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 11 * len(data) + 11, 11, dtype=np.int32)), pa.py_buffer(data)])
        ends = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(lists)))])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), batch.column("part"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), objects)], ["k", "v", "part", "objects"])


def _bytes(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` lowest bytes of numbers, lowest first, a row for each."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :n]


def _fixed(*parts: np.ndarray) -> pa.Array:
    """Binary values of one length, a row of the parts beside each other for each."""
    data = np.concatenate(parts, 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1) * data.shape[1]), pa.py_buffer(data)])


def _each(objects: pa.Array) -> pa.Array:
    """Lists of one object."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(objects) + 1), pa.int32()), objects)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_region_ids``, with the objects of a list as one value."""
    for batch in _region_ids(batches):
        lists = batch.column("objects")
        data = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(lists.offsets.to_numpy() * np.int32(REGION_ID)), lists.values.buffers()[2]])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), batch.column("part"), data], ["k", "v", "part", "data"])


REGION_ID = 11


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and objects of the rows of ``_groups``."""
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()] if len(codes) else []
        for a, b in zip(edges, [*edges[1:], len(codes)] if edges else [], strict=True):
            own, file = batch.slice(a, b - a), files.dictionary[int(codes[a])].as_py()
            number, ids, other, n = (own.column(c).to_numpy() for c in ("number", "id", "other", "n"))
            if file in ("nodes.bin", "ways.bin"):
                key = _fixed(_bytes(number, 4))
            else:
                text = own.column("text").cast(pa.large_binary())
                key = joined(_fixed(_bytes(n, 2), _bytes(lengths(text) - n, 2), _bytes(number, 3 if file == "way_tags_local.bin" else 4)), text)
            if file == "node_tags_global.bin":
                data = own.column("data")
                ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
                raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, REGION_ID)
                objects = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // REGION_ID, pa.int32()), _fixed(raw))
            elif file == "nodes.bin":
                objects = _each(_fixed(_bytes(ids, 8), _bytes(other, 4)[:, ::-1]))
            else:
                objects = _each(_fixed(_bytes(ids, 4)))
            yield pa.RecordBatch.from_arrays([own.column("file"), key, objects], ["file", "key", "objects"])


MADE = D.Made(["order.b as number", "part.a as id", "part.b as other", "octet_length(order.k) as n", "cast(concat(order.k, order.v) as binary) as text", "data"], _made)


def _groups(g: Graph) -> DataFrame:
    """Groups of four kinds of keys: nodes under tiles, ways under indexes, ids under local tags, regions and ids under global tags.

    Most keys have few objects, so each comes in a row of its own, in the order of ``part``, by id and then by the object's bytes; global tags, which are common, in rows
    of a bounded length. Keys and the other objects are made of the rows' numbers by ``_made``.
    """
    struct = lambda **c: F.struct(*(x.alias(n) for n, x in c.items()))
    number = lambda c: struct(a=F.col(c).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)), b=F.col(c).cast("long"), k=F.lit(""), v=F.lit(""))
    none, zero = F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long")
    rows_ = lambda df, file, order, a, b, data: df.select(F.lit(file).alias("file"), order.alias("order"), struct(a=F.col(a).cast("long"), b=b).alias("part"), data)
    tagged = g.node_tags.select("k", "v", F.shiftright("id", 21).alias("part"), "id", F.shiftright(P.coarse(F.col("idx")), 8).alias("region"))
    listed = tagged.groupBy("k", "v", "part").agg(F.collect_list(F.struct("id", "region")).alias("listed"))
    global_ = listed.mapInArrow(_blobs, "k string, v string, part long, data binary")
    rows = [
        rows_(g.nodes, "nodes.bin", number("tile"), "id", _turned("lower", 4), none),
        rows_(g.way_index, "ways.bin", number("idx"), "id", zero, none),
        rows_(T.local_postings(g.way_tags), "way_tags_local.bin", struct(a=F.col("region").cast("long").bitwiseAND(F.lit(0x7FFFFF)), b=F.col("region").cast("long"), k=F.col("k"), v=F.col("v")), "id", zero, none),
        rows_(global_, "node_tags_global.bin", struct(a=zero, b=zero, k=F.col("k"), v=F.col("v")), "part", zero, F.col("data")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _database(g: Graph, method: int = B.LZ4) -> str:
    out = D.scratch(g.spark, "database")
    g.nodes = stored(g.nodes, "places")  # of which groups, tags, indexes and maps are made
    maps = g.nodes.select(F.lit("nodes.map").alias("file"), "id", F.col("tile").alias("value"))
    D.write_database(stored(_groups(g), "groups"), out, "v1", BLOCK, method, maps, D.file_set(True, True, False), MADE)
    return out


#: File -> bytes before and of the id in an object, and of the object.
_IDS = {"nodes.bin": (0, 8, 12), "ways.bin": (0, 4, 4), "way_tags_local.bin": (0, 4, 4), "node_tags_global.bin": (3, 8, 11)}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for file, data in zip(batch.column("file").to_pylist(), batch.column("objects").to_pylist(), strict=True):
            skip, n, each = _IDS[file]
            if len(data) < 1 << 10:
                sums.append(sum(int.from_bytes(data[i + skip : i + skip + n], "little") for i in range(0, len(data), each)))
            else:
                digits = np.frombuffer(data, np.uint8).reshape(-1, each)[:, skip : skip + n].sum(axis=0, dtype=np.int64)
                sums.append(sum(int(d) << 8 * i for i, d in enumerate(digits)))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("described"), pa.array(map(len, batch.column("objects").to_pylist()), pa.int64()), pa.array(sums, pa.int64())], ["file", "key", "bytes", "ids"])


def blockfile_read(g: Graph) -> DataFrame:
    """Bytes and sums of ids under each key of a compressed database, read block by block; a key of several blocks is one row."""
    found = B.read(g.spark, _database(g)).select("file", "described", "objects").mapInArrow(_sums, "file string, key string, bytes long, ids long")
    return found.groupBy("file", "key").agg(F.sum("bytes").alias("bytes"), F.sum("ids").alias("ids"))


def database_listing(g: Graph) -> DataFrame:
    """Names of a database's files, and whether they are empty."""
    return listing(g.spark, _database(g)).select("name", (F.col("length") == 0).alias("is_empty"))


def map_blocks_in_use(g: Graph) -> DataFrame:
    return B.map_blocks(g.spark, _database(g)).filter("file = 'nodes.map'")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and objects of the rows of ``_single``: as many x as ``n`` tells, with a y in the hundredth place if ``other``."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy(), dtype=np.int64)
        starts = np.concatenate([[0], ends])
        data = np.full(int(starts[-1]), ord("x"), np.uint8)
        data[starts[:-1][batch.column("other").to_numpy(zero_copy_only=False)] + 99] = ord("y")
        objects = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column("file"), _fixed(_bytes(batch.column("order").to_numpy(), 4)), _each(objects)], ["file", "key", "objects"])


TEXTS = D.Made(["order", "n", "other"], _texts)


def _single(g: Graph, changed: bool = False) -> DataFrame:
    """Groups of which any two exceed a block, in six files by way; ``changed``: with another byte, a group more, or no file. Their keys and texts are made by ``_texts``."""
    n = (F.lit(700) + F.col("id") % 300).cast("int")
    other = (F.col("id") % 6 == 3) & (F.col("id") % 7 == 0) if changed else F.lit(False)
    own = g.ways.select("id", F.concat(F.lit("f"), (F.col("id") % 6).cast("string"), F.lit(".bin")).alias("file"), n.alias("n"), other.alias("other"))
    if changed:
        own = own.filter("file <> 'f1.bin'").unionByName(own.filter("file = 'f4.bin' and id <= 12").withColumn("id", F.col("id") + (1 << 31)))
    else:
        own = own.filter("file <> 'f2.bin'")
    return own.select("file", F.col("id").alias("order"), "n", "other")


def block_layout(g: Graph) -> DataFrame:
    """Where each block stands, in files where every group has a block of its own."""
    out = D.scratch(g.spark, "layout")
    D.write_database(_single(g), out, "v1", BLOCK, made=TEXTS)
    return B.layout(g.spark, out)


def compare_databases(g: Graph) -> DataFrame:
    """Two databases: files that only one has, with another byte, with a group more, and one with other bytes where nobody reads."""
    paths = []
    for changed in (False, True):
        out = D.scratch(g.spark, "compared")
        D.write_database(_single(g, changed), out, "v1", BLOCK, made=TEXTS)
        data, index = B.write_blocks([Group(i.to_bytes(4, "little"), [b"abc" * 250]) for i in range(4)], BLOCK, B.LZ4)
        tail = b"\1\2" if changed else b"\0\0"  # after the last block, and at the end of its padding
        with writer(f"{out}/g.bin") as f:
            f.write(data[:-2] + tail + tail)
        with writer(f"{out}/g.bin.idx") as f:
            f.write(index)
        paths.append(out)
    return D.compare(g.spark, *paths).filter("name like '%.bin'").select("name", "outcome", "first_difference", "unreferenced_bytes", "unreferenced_differing", "padding_differing")


def _area_shards(g: Graph) -> list[str]:
    """Areas of all relations in three shards: a skeleton under the relation's index, and its id under its tag."""
    sharded = stored(every_nth_shard(g.relation_index, "id", 3).join(g.relations, "id"), "sharded")
    folders = []
    for i in range(3):
        own, out = sharded.filter(F.col("shard") == i), D.scratch(g.spark, f"shard{i}")
        n = (F.col("id") % 4).cast("int")
        skeleton = F.concat(_little("id", 4), _little(n, 4), F.unhex(F.repeat(F.hex(_little("id", 4)), n)))
        number = F.struct(F.col("idx").bitwiseAND(F.lit(0x7FFFFFFF)).alias("a"), F.col("idx").alias("b"), F.lit("").alias("k"), F.lit("").alias("v"))
        ids = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("id", x.alias("o")))), lambda y: y["o"]).alias("objects")
        areas = own.groupBy(F.lit("areas.bin").alias("file"), number.alias("order"), _little("idx", 4).alias("key")).agg(ids(skeleton))
        value = F.coalesce(F.col("tags")[0]["v"], F.lit(""))
        key = _joined(_little(F.lit(7), 2), _little(F.octet_length(value), 2), _little(F.lit(0), 4), F.encode(F.lit("segment"), "utf-8"), F.encode(value, "utf-8"))
        order = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("segment").alias("k"), value.alias("v"))
        tags = own.groupBy(F.lit("area_tags_global.bin").alias("file"), order.alias("order"), key.alias("key")).agg(ids(_little("id", 4)))
        D.commit(g.spark, out, "a1", lambda f, df=areas.unionByName(tags): D.write_block_files(D.blocks(df, BLOCK), f, BLOCK).count(), D.AREA_VERSION_FILE)
        folders.append(out)
    return folders


def merged_areas(g: Graph) -> DataFrame:
    """Objects of merged area files, in order under each key."""
    out = D.scratch(g.spark, "merged")
    D.write_database(_groups(g).filter("file = 'nodes.bin'"), out, "v1", BLOCK, made=MADE)
    D.merge_areas(g.spark, _area_shards(g), out)
    objects = D.shard_objects(B.read(g.spark, out), 0)
    found = D.merged_objects(objects.withColumnRenamed("id", "own").withColumn("id", F.lit(0))).drop("id")  # as they stand
    described = F.when(F.col("file") == "areas.bin", F.lower(F.concat(*(F.hex(F.substring("key", i, 1)) for i in (4, 3, 2, 1))))).otherwise(F.decode(F.expr("substring(key, 16)"), "utf-8"))
    return found.select("file", described.alias("key"), "place", F.col("own").alias("id"), F.octet_length("object").alias("bytes"))


def database_expectations(g: Graph) -> DataFrame:
    """What is found in a database, for predicates of which some hold and some don't."""
    wanted = [
        *(D.Expect(w, f) for w in ("present", "absent") for f in ("nodes.bin", "areas.bin")),
        D.Expect("empty", "way_keys.bin"), D.Expect("empty", "nodes.map.idx", wanted=0), D.Expect("file count", wanted=39),
        D.Expect("least map blocks", "nodes.map", wanted=1 << 30), D.Expect("group count", "nodes.bin", wanted=-1), D.Expect("least groups", "ways.bin", wanted=1),
        D.Expect("object bytes", "way_tags_local.bin", wanted=-1), D.Expect("key bytes", "node_tags_global.bin", '"returnflag"="R" 0x00000000', -1),
        D.Expect("has key", "node_tags_global.bin", '"linestatus"="O" 0x00000000'), D.Expect("has key", "node_tags_global.bin", '"linestatus"="X" 0x00000000'),
        D.Expect("has classes", "ways.bin", wanted=["tile"]), D.Expect("log contains", wanted="no such text"),
    ]
    return D.expectations(g.spark, _database(g), wanted, "a log").select("n", "what", "ok", "found")


def dataset_merge(g: Graph) -> DataFrame:
    """Three datasets with ids that interleave, as one in order."""
    own = g.raw_nodes.select(F.lit(1).alias("kind"), "id").unionByName(g.ways.select(F.lit(2).alias("kind"), "id"))
    return E.merged(*(own.filter(F.col("id") % 3 == i) for i in range(3))).select("kind", "id", "seq")


def dataset_invariants(g: Graph) -> DataFrame:
    """Elements of a dataset with ids, references, texts and roles moved out of their ranges."""
    ways = g.ways.select(F.when(F.col("id") % 307 == 0, F.col("id") + (1 << 32)).otherwise(F.col("id")).alias("id"))
    nodes = g.raw_nodes.select(F.when(F.col("id") % 1009 == 0, F.lit(0)).when(F.col("id") % 1013 == 0, F.lit(65)).otherwise(F.col("id")).cast("long").alias("id"))
    refs = g.refs.select("way_id", F.when(F.col("node_id") % 499 == 0, F.lit(0)).otherwise(F.col("node_id")).alias("node_id"))
    members = g.members.select("relation_id", "kind", F.when((F.col("kind") == 2) & (F.col("ref") % 97 == 0), F.lit(1 << 32)).when(F.col("ref") % 331 == 0, F.lit(0)).otherwise(F.col("ref")).alias("ref"), F.when(F.col("relation_id") % 401 == 0, F.repeat("role", 40_000)).otherwise(F.col("role")).alias("role"))
    tags = g.way_tags.select(F.lit(2).alias("kind"), "id", "k", F.when(F.col("id") % 701 == 0, F.repeat("v", 70_000)).otherwise(F.col("v")).alias("v"))
    return V.dataset_violations(nodes, ways, g.relations, refs, members, tags)


def xml_elements(g: Graph) -> DataFrame:
    return E.xml_elements(_elements(g))


def json_lines(g: Graph) -> DataFrame:
    return E.json_lines(_elements(g))


def synthetic_metadata(g: Graph) -> DataFrame:
    own = g.raw_nodes.select(F.lit(1).alias("kind"), (F.col("id") * 100_003).alias("id")).unionByName(g.relations.select(F.lit(3).alias("kind"), "id"))
    return own.select("kind", "id", *(c.alias(n) for n, c in E.metadata(F.col("kind"), F.col("id")).items()))


def recurse_up_nested(g: Graph) -> DataFrame:
    """From nodes with a tag: their ways, the relations of these and nodes, and the relations that have those, however deep."""
    return Q.recurse_up(g.members, g.refs, g.raw_nodes.filter("exists(tags, t -> t.k = 'returnflag' and t.v = 'R')").select("id"), nested=True)


def bbox_nodes_tags(g: Graph) -> DataFrame:
    own = g.staged_nodes.filter(Q.in_box(*BOX))
    return own.select("id", "lat", "lon", F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["k"], t["v"])), ";").alias("tags"))


def around_metres(g: Graph) -> DataFrame:
    return Q.around_metres(g.staged_nodes, 100_000_000, 200_000_000, 900_000.0).select("id", F.round("metres").cast("long").alias("metres"))


def _rings(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each way of four nodes and more that are all there, closed and cut in two: refs, members and tags. Areas with an id divisible by five lack a part."""
    n = g.refs.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))
    whole = g.refs.join(g.raw_nodes.select(F.col("id").alias("node_id")), "node_id").groupBy("way_id").agg(F.count(F.lit(1)).alias("m"))
    own = g.refs.join(n.join(whole, "way_id").filter("n = m and n >= 4"), "way_id")
    first = own.filter("pos <= 1").select((F.col("way_id") * 2).alias("way_id"), "pos", "node_id")
    closing = own.filter("pos = 0").select((F.col("way_id") * 2 + 1).alias("way_id"), F.col("n").alias("pos"), "node_id")
    refs = first.unionByName(own.filter("pos >= 1").select((F.col("way_id") * 2 + 1).alias("way_id"), "pos", "node_id")).unionByName(closing)
    areas = own.select(F.col("way_id").alias("relation_id")).distinct()
    parts = areas.select("relation_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).filter("not (relation_id % 5 = 0 and part = 1)")
    members = parts.select("relation_id", F.col("part").cast("long").alias("pos"), F.lit(2).alias("kind"), (F.col("relation_id") * 2 + F.col("part")).alias("ref"), F.lit("outer").alias("role"))
    return refs, members, areas.select("relation_id", F.lit("type").alias("k"), F.lit("multipolygon").alias("v"))


def area_edges(g: Graph) -> DataFrame:
    """Edges of areas of two ways each, whose rings close."""
    refs, members, tags = _rings(g)
    return Q.area_edges(members, refs, g.raw_nodes, tags)


def within_area(g: Graph) -> DataFrame:
    """Everything with a node in the areas of a name: those of the first relations."""
    refs, members, tags = _rings(g)
    edges = Q.area_edges(members, refs, g.raw_nodes, tags.filter("relation_id in (8, 33, 34, 66)"))
    return Q.within(g.raw_nodes, g.refs, g.members, edges)


def posting_lists(g: Graph) -> DataFrame:
    """Ways under each local tag, in order."""
    lists = T.posting_lists(T.local_postings(g.way_tags).withColumn("place", F.col("region")), "place", "k", "v")
    return lists.select(F.col("place").alias("region"), "k", "v", F.array_join(F.transform("postings", lambda p: p["id"].cast("string")), ",").alias("ids"))


def invalid_positions(g: Graph) -> DataFrame:
    return V.invalid_positions(g.raw_nodes.select("id", (F.col("lat") * 2).alias("lat"), "lon"))


_LISTED = _CTE.rstrip() + """, nl as (select way_id, string_agg(node_id, ',' order by pos) as parts from refs group by way_id),
ml as (select relation_id, string_agg(kind || ':' || ref || ':' || role, ',' order by pos) as parts from member_values group by relation_id),
rel as (select o_orderkey + 1 as id, c_mktsegment as seg from orders left join customer on c_custkey = o_custkey)"""
_DEGREES = lambda c: f"(case when {c} < 0 then '-' else '' end || (abs({c}) // 10000000) || '.' || lpad((abs({c}) % 10000000)::varchar, 7, '0'))"
_TAG = lambda k, v: f"'    <tag k=\"{k}\" v=\"' || {v} || '\"/>' || chr(10)"
_KIND = "['node', 'way', 'relation']"
_SINGLE = _CTE + """, one as (select id, 'f' || (id % 6) || '.bin' as file, 708 + id % 300 as size, ((712 + id % 300 + 127) // 128) * 128 as room from ways),
placed as (select *, (sum(room) over (partition by file order by id) - room)::bigint as start from one)"""
_WHOLE_NODES = "(select way_id from refs left join nodes on nodes.id = node_id group by way_id having count(*) >= 4 and count(nodes.id) = count(*))"
_EDGES = _CTE + f""", ring as (select way_id, pos, lat, lon, lead(lat) over w as lat2, lead(lon) over w as lon2, first_value(lat) over w as lat0, first_value(lon) over w as lon0
    from refs join nodes on nodes.id = node_id where way_id in {_WHOLE_NODES} window w as (partition by way_id order by pos)),
step as (select way_id as area_id, lat, lon, coalesce(lat2, lat0) as lat2, coalesce(lon2, lon0) as lon2 from ring where way_id % 5 <> 0),
turned as (select area_id, case when (lat, lon) <= (lat2, lon2) then [lat, lon, lat2, lon2] else [lat2, lon2, lat, lon] end as e from step where (lat, lon) <> (lat2, lon2)),
edge as (select area_id, e[1] as lat1, e[2] as lon1, e[3] as lat2, e[4] as lon2 from turned group by area_id, e having count(*) % 2 = 1)"""
_FILES = ["relation_roles.bin", "relation_roles.bin.idx", *(f"{k}{x}" for k in ("nodes", "ways", "relations") for x in (".bin", ".bin.idx", ".map", ".map.idx")), *(f"{k}_{x}.bin{i}" for k in ("node", "way", "relation") for x in ("tags_local", "tags_global", "keys", "frequent_tags") for i in ("", ".idx"))]

SQL = {
    "pbf_read": _LISTED + """ select 1 as kind, id, lat, lon, '' as parts, 'returnflag=' || l_returnflag || ',linestatus=' || l_linestatus as tags from nodes
        union all select 2, id, null, null, coalesce(parts, ''), 'status=' || status || ',priority=' || priority from ways left join nl on way_id = id
        union all select 3, id, null, null, coalesce(parts, ''), 'segment=' || seg from rel left join ml on relation_id = id""",
    "pbf_headers": f"select {SECONDS}::bigint as seconds, strftime(make_timestamp({SECONDS}::bigint * 1000000), '%Y-%m-%dT%H:%M:%SZ') as iso",
    "pbf_order": _CTE + "select 0::bigint as violations, (select count(*) from nodes) + (select count(*) from ways) + (select count(*) from orders) as elements",
    "staged_kinds": _CTE + "select 1 as kind, count(*) as n, min(id) as least, max(id) as greatest from nodes union all select 2, count(*), min(id), max(id) from ways union all select 3, count(*), min(o_orderkey + 1), max(o_orderkey + 1) from orders",
    "blockfile_read": _CTE + _NODE_TAGS + _WAY_TAGS + """ select 'nodes.bin' as file, '0x' || lower(lpad(to_hex(tile), 8, '0')) as key, count(*) * 12 as bytes, sum(id)::bigint as ids from nodes group by all
        union all select 'ways.bin', '0x' || lower(lpad(to_hex(idx), 8, '0')), count(*) * 4, sum(id)::bigint from way_index group by all
        union all select 'way_tags_local.bin', '0x' || lower(lpad(to_hex((idx & 2147483392) >> 8), 6, '0')) || ' "' || k || '"="' || v || '"', count(distinct id) * 4, sum(id)::bigint from way_tags group by all
        union all select 'node_tags_global.bin', '"' || k || '"="' || v || '" 0x00000000', count(*) * 11, sum(id)::bigint from node_tags group by all""",
    "database_listing": "select * from (values ('osm_base_version', false), " + ", ".join(f"('{n}', {str(not (n.startswith(('nodes.bin', 'ways.bin', 'nodes.map', 'way_tags_local', 'node_tags_global')) or n in ('ways.map.idx', 'relations.map.idx'))).lower()})" for n in _FILES) + ") as v(name, is_empty)",
    "map_blocks_in_use": _CTE + "select distinct 'nodes.map' as file, id // 65536 as block from nodes",
    "block_layout": _SINGLE + "select file, row_number() over (partition by file order by id)::bigint - 1 as block, '0x' || lower(lpad(to_hex(id), 8, '0')) as key, start, start + room as payload_end, start + room as end from placed where file <> 'f2.bin'",
    "compare_databases": _SINGLE + """ select 'f' || n || '.bin' as name, case n when 1 then 'only first' when 2 then 'only second' when 3 then 'different' when 4 then 'different' else 'identical' end as outcome,
        case n when 3 then (select min(start) + 4 + 4 + 4 + 99 from placed where file = 'f3.bin' and id % 7 = 0) end as first_difference, null::bigint as unreferenced_bytes, null::bigint as unreferenced_differing, null::bigint as padding_differing from range(6) r(n)
        union all select 'g.bin', 'equivalent', null, 2, 2, 2""",
    "merged_areas": _CTE + _RELATION + """ select 'areas.bin' as file, lower(lpad(to_hex(idx), 8, '0')) as key, row_number() over (partition by idx order by id)::bigint - 1 as place, id, (8 + id % 4 * 4)::int as bytes from relation_index
        union all select 'area_tags_global.bin', v, row_number() over (partition by v order by id)::bigint - 1, id, 4 from (select id, 'segment'[8:] || v as v from relation_tags)""",
    "database_expectations": _CTE + _NODE_TAGS + _WAY_TAGS + """, found(n, what, ok, found) as (
        select 0, 'present', true, 'True' union all select 1, 'present', false, 'False' union all select 2, 'absent', false, 'True' union all select 3, 'absent', true, 'False'
        union all select 4, 'empty', true, '0' union all select 5, 'empty', false, (8 + 8 * (1 + max(id) // 65536))::varchar from nodes union all select 6, 'file count', true, '39'
        union all select 7, 'least map blocks', false, count(distinct id // 65536)::varchar from nodes union all select 8, 'group count', false, count(distinct tile)::varchar from nodes
        union all select 9, 'least groups', true, count(distinct idx)::varchar from way_index union all select 10, 'object bytes', false, (4 * count(*))::varchar from (select distinct id, k, v from way_tags)
        union all select 11, 'key bytes', false, (11 * count(*))::varchar from node_tags where k = 'returnflag' and v = 'R' union all select 12, 'has key', true, 'True' union all select 13, 'has key', false, 'False'
        union all select 14, 'has classes', bool_or(class = 'tile'), '[' || string_agg('''' || class || '''', ', ' order by class) || ']' from (select distinct case when idx = 254 then 'none' when idx & 2147483648 = 0 then 'tile' else 'level 0x' || upper(to_hex(idx & 255 & -(idx & 255))) end as class from way_index)
        union all select 15, 'log contains', false, 'False') select n, what, ok, found from found""",
    "dataset_merge": _CTE + "select kind, id, row_number() over (order by kind, id)::bigint - 1 as seq from (select 1 as kind, id from nodes union all select 2, id from ways)",
    "dataset_invariants": _CTE + _WAY_TAGS + """, n as (select case when id % 1009 = 0 then 0 when id % 1013 = 0 then 65 else id end as id from nodes),
        w as (select case when id % 307 = 0 then id + 4294967296 else id end as id from ways),
        m as (select relation_id, kind, case when kind = 2 and ref % 97 = 0 then 4294967296 when ref % 331 = 0 then 0 else ref end as ref, case when relation_id % 401 = 0 then strlen(role) * 40000 else strlen(role) end as size from member_values)
        select distinct 'id not positive' as rule, 1 as kind, id from n where id < 1 union all select 'id twice', 1, id from n group by id having count(*) > 1
        union all select distinct 'id too large', 2, id from w where id > 4294967295 union all select distinct 'text too long', 2, id from way_tags where id % 701 = 0 and strlen(v) * 70000 > 65535
        union all select distinct 'reference not positive', 2, way_id from refs where node_id % 499 = 0 union all select distinct 'reference not positive', 3, relation_id from m where ref < 1
        union all select distinct 'reference too large', 3, relation_id from m where kind > 1 and ref > 4294967295 union all select distinct 'role too long', 3, relation_id from m where size > 65535""",
    "xml_elements": _LISTED + f""", nx as (select way_id, string_agg('    <nd ref="' || node_id || '"/>' || chr(10), '' order by pos) as x from refs group by way_id),
        mx as (select relation_id, string_agg('    <member type="' || {_KIND}[kind] || '" ref="' || ref || '" role="' || role || '"/>' || chr(10), '' order by pos) as x from member_values group by relation_id)
        select 1 as kind, id, '  <node id="' || id || '" lat="' || {_DEGREES('lat')} || '" lon="' || {_DEGREES('lon')} || '">' || chr(10) || {_TAG('returnflag', 'l_returnflag')} || {_TAG('linestatus', 'l_linestatus')} || '  </node>' as xml from nodes
        union all select 2, id, '  <way id="' || id || '">' || chr(10) || coalesce(x, '') || {_TAG('status', 'status')} || {_TAG('priority', 'priority')} || '  </way>' from ways left join nx on way_id = id
        union all select 3, id, '  <relation id="' || id || '">' || chr(10) || coalesce(x, '') || {_TAG('segment', 'seg')} || '  </relation>' from rel left join mx on relation_id = id""",
    "json_lines": _LISTED + f""", mj as (select relation_id, string_agg('{{"type":"' || {_KIND}[kind] || '","ref":' || ref || ',"role":"' || role || '"}}', ',' order by pos) as x from member_values group by relation_id)
        select 1 as kind, id, '{{"type":"node","id":' || id || ',"lat":' || case when abs(lat) <= 900000000 and abs(lon) <= 1800000000 then lat else 1000000000 end || ',"lon":' || case when abs(lat) <= 900000000 and abs(lon) <= 1800000000 then lon else 2000000000 end || ',"tags":{{"returnflag":"' || l_returnflag || '","linestatus":"' || l_linestatus || '"}}}}' as line from nodes
        union all select 2, id, '{{"type":"way","id":' || id || ',"nodes":[' || coalesce(parts, '') || '],"tags":{{"status":"' || status || '","priority":"' || priority || '"}}}}' from ways left join nl on way_id = id
        union all select 3, id, '{{"type":"relation","id":' || id || ',"members":[' || coalesce(x, '') || '],"tags":{{"segment":"' || seg || '"}}}}' from rel left join mj on relation_id = id""",
    "synthetic_metadata": _CTE + """select kind, id, 1 + id % 9 as version, strftime(make_timestamp((1191715200 + (id::hugeint * 40503 % 18446744073709551616 % 600000000)::bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as iso,
        1 + (id::hugeint * 2654435761 % 18446744073709551616 % 150000000)::bigint as changeset, 1 + id % 20000000 + kind - 1 as uid, ['mapper', 'Zoë & co', '名前', 'a"b<c>'][id % 4 + 1] as "user"
        from (select 1 as kind, id * 100003 as id from nodes union all select 3, o_orderkey + 1 from orders)""",
    "recurse_up_nested": "with recursive" + _CTE[4:] + """, own as (select id from nodes where l_returnflag = 'R'), w as (select distinct way_id as id from refs where node_id in (select id from own)),
        rel(id) as (select relation_id from member_values where (kind = 1 and ref in (select id from own)) or (kind = 2 and ref in (select id from w)) union select relation_id from rel join member_values on kind = 3 and ref = id)
        select 'way' as type, id from w union all select 'relation', id from rel""",
    "bbox_nodes_tags": _CTE + f"select id, lat, lon, 'returnflag=' || l_returnflag || ';linestatus=' || l_linestatus as tags from nodes where lat between {BOX[0]} and {BOX[2]} and lon between {BOX[1]} and {BOX[3]}",
    "around_metres": _CTE + """select id, round(m)::bigint as metres from (select id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat / 1e7) - radians(10.0)) / 2), 2) + cos(radians(lat / 1e7)) * cos(radians(10.0)) * pow(sin(radians((lon - 200000000) / 1e7) / 2), 2)))) as m from nodes) where m <= 900000""",
    "area_edges": _EDGES + " select area_id, lat1, lon1, lat2, lon2 from edge",
    "within_area": _EDGES + """, met as (select n.id, area_id from nodes n join edge on area_id in (8, 33, 34, 66) and (case when lat1 < lat2 then n.lat >= lat1 and n.lat < lat2 else n.lat >= lat2 and n.lat < lat1 end)
        and case when lat2 > lat1 then (n.lon - lon1)::hugeint * (lat2 - lat1) < (n.lat - lat1)::hugeint * (lon2 - lon1) else (n.lon - lon1)::hugeint * (lat2 - lat1) > (n.lat - lat1)::hugeint * (lon2 - lon1) end),
        i as (select area_id, id from met group by all having count(*) % 2 = 1), w as (select distinct area_id, way_id as id from refs join i on i.id = node_id)
        select area_id, 'node' as type, id from i union all select area_id, 'way', id from w union all
        select distinct area_id, 'relation', relation_id from (select area_id, relation_id from member_values join i on kind = 1 and ref = i.id union all select area_id, relation_id from member_values join w on kind = 2 and ref = w.id)""",
    "posting_lists": _CTE + _WAY_TAGS + "select region, k, v, string_agg(id, ',' order by id) as ids from (select distinct (idx & 2147483392) >> 8 as region, k, v, id from way_tags) group by all",
    "invalid_positions": _CTE + "select id, lat * 2 as lat, lon from nodes where abs(lat * 2) > 900000000 or abs(lon) > 1800000000",
}

QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for f in (pbf_read, pbf_headers, pbf_order, staged_kinds, blockfile_read, database_listing, map_blocks_in_use, block_layout, compare_databases, merged_areas, database_expectations, dataset_merge, dataset_invariants, xml_elements, json_lines, synthetic_metadata, recurse_up_nested, bbox_nodes_tags, around_metres, area_edges, within_area, posting_lists, invalid_positions)}
