"""Cases that the fixture graph doesn't have."""

import os
from collections import Counter

from pyspark.sql import functions as F

from gridloom.operators import compare, search, shards, tags
from gridloom.streaming.tiles import region_counts


def test_gaps(spark):
    spans = spark.createDataFrame([("f", 4, 8), ("f", 0, 2), ("g", 1, 9), ("g", 2, 3)], "file string, start long, end long")
    lengths = spark.createDataFrame([("f", 10), ("g", 9), ("h", 3)], "file string, length long")
    assert {tuple(r) for r in compare.gaps(spans, lengths).collect()} == {("f", 2, 4), ("f", 8, 10), ("g", 0, 1), ("h", 0, 3)}


def test_dictionary(spark):
    words = spark.createDataFrame([(2, 0, "a"), (1, 1, "b"), (1, 0, "c"), (3, 0, "b")], "id long, pos long, k string")
    assert {r.k: r.k_id for r in tags.dictionary(words, "k", "id", "pos").collect()} == {"c": 0, "b": 1, "a": 2}


def test_box_over_the_date_line(spark):
    nodes = spark.createDataFrame([(1, 0, 1_799_000_000), (2, 0, -1_799_000_000), (3, 0, 0)], "id long, lat long, lon long")
    from gridloom.operators.extents import placed

    assert {r.id for r in search.bbox_nodes(placed(nodes), (-10, 1_700_000_000, 10, -1_700_000_000)).collect()} == {1, 2}


def test_around_metres(spark):
    nodes = spark.createDataFrame([(1, 0, 1_799_999_000), (2, 0, -1_799_999_000), (3, 100_000, 0), (4, 899_990_000, 900_000_000)], "id long, lat long, lon long")
    from gridloom.operators.extents import placed

    assert {r.id for r in search.around_metres(placed(nodes), 0, 1_800_000_000, 100.0).collect()} == {1, 2}
    assert {r.id for r in search.around_metres(placed(nodes), 899_990_000, -900_000_000, 300.0).collect()} == {4}


def test_cycles_end(spark):
    members = spark.createDataFrame([(1, 0, 3, 2, ""), (2, 0, 3, 1, ""), (2, 1, 2, 5, ""), (1, 1, 1, 9, "")], "relation_id long, pos long, kind int, ref long, role string")
    refs = spark.createDataFrame([(5, 0, 7)], "way_id long, pos long, node_id long")
    got = {tuple(r) for r in search.recurse_down(members, refs, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {("relation", 1), ("relation", 2), ("way", 5), ("node", 9), ("node", 7)}


def test_deep_nesting(spark):
    """A chain that is longer than 64, back to its middle at the end."""
    members = spark.createDataFrame([(i, 0, 3, i + 1 if i < 70 else 30, "") for i in range(1, 71)] + [(70, 1, 1, 9, "")], "relation_id long, pos long, kind int, ref long, role string")
    refs = spark.createDataFrame([], "way_id long, pos long, node_id long")
    got = Counter(tuple(r) for r in search.recurse_down(members, refs, spark.createDataFrame([(1,)], "id long")).collect())
    assert got == Counter([*(("relation", i) for i in range(1, 71)), ("node", 9)])


def test_areas(spark):
    """A square with a square hole, of two ways each, and an open ring that makes no area."""
    nodes = spark.createDataFrame([(1, 0, 0), (2, 0, 100), (3, 100, 100), (4, 100, 0), (5, 40, 40), (6, 40, 60), (7, 60, 60), (8, 60, 40)], "id long, lat long, lon long")
    paths = {1: [1, 2, 3], 2: [3, 4, 1], 3: [5, 6, 7], 4: [7, 8, 5], 5: [1, 3]}
    refs = spark.createDataFrame([(w, i, n) for w, ns in paths.items() for i, n in enumerate(ns)], "way_id long, pos long, node_id long")
    members = spark.createDataFrame([(1, i, 2, w, "") for i, w in enumerate((1, 2, 3, 4))] + [(2, 0, 2, 5, "")], "relation_id long, pos long, kind int, ref long, role string")
    own = spark.createDataFrame([(1, "type", "multipolygon"), (2, "type", "boundary")], "relation_id long, k string, v string")
    edges = search.area_edges(members, refs, nodes, own)
    points = spark.createDataFrame([(1, 10, 10), (2, 50, 50), (3, 200, 5), (4, 50, 10)], "point_id long, lat long, lon long")
    assert {tuple(r) for r in search.is_in(points, edges, 16).collect()} == {(1, 1), (4, 1)}


def test_every_node_in_every_rectangle(spark):
    """All pairs of a node and a rectangle, looked at one by one."""
    from gridloom.plans import service
    from gridloom.plans.graph import Graph

    g = Graph(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    places = {r.id: (r.lat, r.lon) for r in g.nodes.select("id", "lat", "lon").collect()}
    own = {}
    for r in g.refs.collect():
        if r.node_id in places:
            own.setdefault(r.way_id, []).append(places[r.node_id])
    boxes = {way: (min(lats), max(lats), min(lons), max(lons)) for way, at in own.items() for lats, lons in [zip(*at, strict=True)]}
    boxes = {way: (s, n, w, e) for way, (s, n, w, e) in boxes.items() if s < n and w < e}
    want = {(node, way) for way, (s, n, w, e) in boxes.items() for node, (lat, lon) in places.items() if s <= lat < n and w <= lon < e}
    assert Counter(tuple(r) for r in service.is_in_rect(g).collect()) == Counter(want)
    assert {r.area_id: (r.ok, r.n_edges) for r in service.ring_closure(g).collect()} == {way: (way % 3 != 0, 4 if way % 3 else 2) for way in boxes}


def test_every_relation_and_node(spark):
    from gridloom.plans import service
    from gridloom.plans.graph import Graph

    g = Graph(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    members, ways = g.members.collect(), {r.id for r in g.ways.select("id").collect()}
    assert {(r.relation_id, r.id) for r in service.member_ways_foreach(g).collect()} == {(m.relation_id, m.ref) for m in members if m.kind == 2 and m.ref in ways}
    lats = {r.id: r.lat for r in g.nodes.select("id", "lat").collect()}
    assert {r.id for r in service.unaligned_coordinates(g).collect()} == {node for node, lat in lats.items() if (lat * 150 + 50) % 100}
    up = {r.way_id for r in g.refs.collect() if r.node_id in lats}
    relations = {m.relation_id for m in members if (m.kind == 1 and m.ref in lats) or (m.kind == 2 and m.ref in up)}
    assert Counter(tuple(r) for r in service.recurse_up(g).collect()) == Counter([*(("way", x) for x in up), *(("relation", x) for x in relations)])


def test_absent_text_of_both_remainders(spark):
    """An id that 701 and 709 divide has no text, whose length doesn't matter then."""
    from types import SimpleNamespace

    from gridloom.plans import service

    tags = spark.createDataFrame([(701 * 709, "status", "F"), (701, "status", "F"), (701, "priority", "1-URGENT"), (709, "status", "F"), (3, "status", "F")], "id long, k string, v string")
    assert sorted(tuple(r) for r in service.text_refusals(SimpleNamespace(way_tags=tags)).collect()) == [(701, "priority", "value"), (709, "status", "value"), (701 * 709, "status", "value")]


def test_as_of_across_ranges(spark):
    starts = spark.createDataFrame([(0, 10), (1, 70_000), (2, 400_000)], "bucket long, start long")
    asked = spark.createDataFrame([(5,), (10,), (69_999,), (70_000,), (300_000,), (900_000,)], "id long")
    assert [r.bucket for r in shards.bucket_of(asked, starts, "id").orderBy("id").collect()] == [None, 0, 0, 1, 1, 2]


def test_region_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0, 0), ("2024-01-01 00:02:00", 1, 1), ("2024-01-01 00:12:00", 0, 0)], "t string, lat long, lon long").select(F.to_timestamp("t").alias("ts"), "lat", "lon")
    assert sorted(r.n for r in region_counts(rows).collect()) == [1, 2]
