"""Queries over binary formats and generated graphs. Bytes are made in memory from the fixture graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import extents as X
from gridloom.operators.pack import Group
from gridloom.plans.graph import _CTE, Graph
from gridloom.sources import blockfile, generate, pbf


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of nodes as a file, and that decoded again."""
    for batch in batches:
        rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("id", "lat", "lon", "flag")), strict=True))
        data = pbf.encode([(1, i, a, o, None, None, [("returnflag", f)]) for i, a, o, f in rows])
        for kind, blob in pbf.blobs(data):
            if kind == pbf.DATA_BLOB:
                found = pbf.decode_block(pbf.inflate(blob))
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in found]), pa.array([r[2] for r in found]), pa.array([r[3] for r in found]), pa.array([r[6][0]["v"] for r in found])], ["id", "lat", "lon", "returnflag"])


def pbf_decode(g: Graph) -> DataFrame:
    own = g.nodes.select("id", "lat", "lon", F.col("tags")[0]["v"].alias("flag"))
    return own.mapInArrow(_encoded, "id long, lat long, lon long, returnflag string")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile groups packed to block files, and these scanned."""
    for batch in batches:
        groups: dict[int, list[bytes]] = {}
        for tile, number, lower in sorted(zip(*(batch.column(c).to_pylist() for c in ("tile", "id", "lower")), strict=True)):
            groups.setdefault(tile, []).append(number.to_bytes(8, "little") + lower.to_bytes(4, "little"))
        data, index = blockfile.write_blocks([Group(k.to_bytes(4, "little"), v) for k, v in sorted(groups.items())], 1 << 12)
        found = [(int.from_bytes(k, "little"), len(o) // 12) for _, _, k, o in blockfile.read_groups(data, index, "u32")]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["tile", "n"])


def blockdb_scan(g: Graph) -> DataFrame:
    """Objects of each tile, from block files written of parts of the nodes."""
    return g.nodes.select("tile", "id", "lower").mapInArrow(_written, "tile long, n long").groupBy("tile").agg(F.sum("n").cast("long").alias("n"))


def generated_profile(g: Graph) -> DataFrame:
    """Classes of way indexes of a generated graph."""
    p = generate.PROFILES["mixed"]
    nodes, ways = generate.nodes(g.spark, p, 1), generate.ways(g.spark, p, 1)
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    return X.index_classes(X.way_index(ways, X.located_refs(refs, X.placed(nodes))))


SQL = {
    "pbf_decode": _CTE + "select id, lat, lon, l_returnflag as returnflag from nodes",
    "blockdb_scan": _CTE + "select tile, count(*) as n from nodes group by tile",
}
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for f in (pbf_decode, blockdb_scan, generated_profile)}
