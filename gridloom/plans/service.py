"""Queries of validation, comparison, sharding and search over the fixture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators import checks as V
from gridloom.operators import compare as M
from gridloom.operators import pack as B
from gridloom.operators import search as Q
from gridloom.operators import shards as S
from gridloom.operators import tags as T
from gridloom.plans.graph import _CTE, _NODE_TAGS, _RELATION, _TYPED, _WAY_TAGS, Graph

#: Bounds of the box, centre and radius that the queries ask for.
BOX = (-500_000_000, -900_000_000, 300_000_000, 700_000_000)
LAT, LON, RADIUS = 0, 0, 200_000_000


def _sequence(g: Graph) -> DataFrame:
    """Nodes and ways as they would stand in a file, in blocks of 4096 ids, some of them displaced."""
    nodes = g.nodes.select(F.lit(1).alias("kind"), "id")
    ways = g.ways.select(F.lit(2).alias("kind"), "id")
    every = nodes.unionByName(ways).withColumn("block", F.col("kind") * 1_000_000 + F.floor(F.col("id") / 4096).cast("long")).withColumn("pos", F.col("id"))
    # an element with id % 97 = 5 stands a place further on, one with id % 89 = 7 bears the id before its own, a few ways come in a block of nodes
    moved = every.withColumn("pos", F.when(F.col("id") % 97 == 5, F.col("id") * 2 + 3).otherwise(F.col("id") * 2))
    moved = moved.withColumn("id", F.when(F.col("id") % 89 == 7, F.col("id") - 1).otherwise(F.col("id")))
    return moved.withColumn("block", F.when((F.col("kind") == 2) & (F.col("id") % 501 == 0), F.lit(1_000_000)).otherwise(F.col("block")))


def order_violations_lag(g: Graph) -> DataFrame:
    return V.order_violations(_sequence(g)).select("block", "pos", "kind", "id", "violation")


def duplicate_ids(g: Graph) -> DataFrame:
    return V.duplicate_ids(_sequence(g))


def id_range_refusals(g: Graph) -> DataFrame:
    shifted = _sequence(g).select("kind", (F.when(F.col("id") % 211 == 0, F.col("id") - 5_000).when(F.col("id") % 223 == 0, F.col("id") + F.lit(1 << 42)).otherwise(F.col("id"))).alias("id"))
    return V.id_range_refusals(shifted).distinct()


def unaligned_coordinates(g: Graph) -> DataFrame:
    """All nodes, with a granularity that leaves some of them between units."""
    return V.unaligned_coordinates(g.nodes.select("id", (F.col("lat") * 2).alias("raw")), 75, 50).select("id", "nano")


def text_refusals(g: Graph) -> DataFrame:
    wide = g.way_tags.select("id", "k", F.when(F.col("id") % 709 == 0, F.lit(None).cast("string")).when(F.col("id") % 701 == 0, F.repeat("v", 40_000)).otherwise(F.col("v")).alias("v"))
    return V.text_refusals(wide).select("id", "k", "reason")


def empty_ways(g: Graph) -> DataFrame:
    return V.empty_or_unplaced(g.ways, g.refs).select("id")


def key_order_violations(g: Graph) -> DataFrame:
    groups = g.way_index.filter("idx <> 254").select((F.col("id") % 50).alias("file"), F.col("id").alias("seq"), F.floor(F.col("idx") / (1 << 26)).alias("key"))
    return V.key_order_violations(groups, "file", "seq", "key").select("file", "seq", "key")


def _copies(g: Graph) -> tuple[DataFrame, DataFrame]:
    a = g.way_index.filter("id % 13 <> 0")
    b = g.way_index.filter("id % 17 <> 0").withColumn("idx", F.when(F.col("id") % 19 == 0, F.col("idx") + 1).otherwise(F.col("idx")))
    return a, b


def dataset_diff_full_outer(g: Graph) -> DataFrame:
    return M.dataset_diff(*_copies(g), ["id"])


def outcome_counts(g: Graph) -> DataFrame:
    return M.outcome_counts(M.dataset_diff(*_copies(g), ["id"]))


def keyset_symmetric_difference(g: Graph) -> DataFrame:
    a, b = _copies(g)
    return M.keyset_symmetric_difference(a.select("idx"), b.select("idx"))


def _spans(g: Graph) -> DataFrame:
    return g.refs.filter("pos % 3 <> 1").select((F.col("way_id") % 100).alias("file"), (F.col("way_id") * 8 + F.col("pos")).alias("start"), (F.col("way_id") * 8 + F.col("pos") + 5).alias("end"))


def span_gaps(g: Graph) -> DataFrame:
    spans = _spans(g)
    lengths = spans.groupBy("file").agg((F.max("end") + F.col("file")).alias("length"))
    return M.gaps(spans, lengths)


def first_difference(g: Graph) -> DataFrame:
    chunk = lambda odd: g.ways.select((F.col("id") % 40).alias("file"), (F.floor(F.col("id") / 40) * 16).cast("long").alias("offset"), F.encode(F.format_string("%016d", F.when(odd, F.col("id") + 1000).otherwise(F.col("id"))), "utf-8").alias("data"))
    return M.first_difference(chunk(F.lit(False)), chunk((F.col("id") % 40 < 20) & (F.col("id") % 77 == 0)))


def prefix_sum_positions(g: Graph) -> DataFrame:
    sizes = g.refs.groupBy("way_id").agg((F.count(F.lit(1)) * 8 + 8).alias("size")).withColumn("file", F.col("way_id") % 64)
    return S.prefix_sums(sizes, "file", "way_id", "size").select("file", "way_id", "size", "start")


def bucket_lookup_range(g: Graph) -> DataFrame:
    return S.bucket_of(g.refs, S.bucket_starts(g.nodes, 512), "node_id").select("way_id", "pos", "node_id", "bucket")


def every_nth_shard(g: Graph) -> DataFrame:
    return S.every_nth_shard(g.relations.select("id"), "id", 7)


def _overlapping(g: Graph) -> DataFrame:
    own = S.every_nth_shard(g.relations.select("id"), "id", 7)
    return own.unionByName(own.filter("id % 31 = 0").withColumn("shard", ((F.col("shard") + 2) % 7).cast("int"))).filter("id % 43 <> 0")


def shard_disjointness(g: Graph) -> DataFrame:
    return S.pairwise_overlaps(_overlapping(g), "id")


def shard_coverage(g: Graph) -> DataFrame:
    return S.uncovered(g.relations, _overlapping(g), "id")


def shard_merge(g: Graph) -> DataFrame:
    sharded = S.every_nth_shard(g.relations.select("id"), "id", 5).withColumn("key", F.col("id") % 300)
    return S.merge_shards(sharded, "key", ["id"]).select("key", "seq", "id", "shard")


def version_agreement(g: Graph) -> DataFrame:
    """Shards of relations, of which one bears other versions than the rest."""
    own = S.every_nth_shard(g.relations.select("id"), "id", 7)
    return S.version_agreement(own.withColumn("version", F.when(F.col("shard") == 3, F.concat(F.lit("w"), (F.col("id") % 5).cast("string"))).otherwise("v")), "version")


def _sizes(g: Graph) -> DataFrame:
    return g.refs.groupBy("way_id").agg(F.count(F.lit(1)).alias("n")).select((F.col("way_id") % 8).alias("file"), F.col("way_id").alias("key"), (8 + F.col("n") * 37 + F.when(F.col("way_id") % 23 == 0, 700).otherwise(0)).cast("long").alias("size"))


def pack_segments(g: Graph) -> DataFrame:
    return B.segments(_sizes(g), "file", "key", "size", 1024).groupBy("file", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def pack_blocks(g: Graph) -> DataFrame:
    return B.pack_sizes(_sizes(g), "file", "key", "size", 1024)


def bbox_count(g: Graph) -> DataFrame:
    return Q.bbox_counts(g.staged_nodes, g.refs, g.members, BOX)


def bbox_nodes(g: Graph) -> DataFrame:
    return Q.bbox_nodes(g.staged_nodes, BOX).select("id", "lat", "lon")


def id_lookup(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("id").isin([65, 66, 129, 700, 1000, 64 * 700 + 1])).select("id", "tile")


def ways_by_tag_bbox(g: Graph) -> DataFrame:
    """Ways of one priority in the box, with their geometry in order."""
    found = Q.bbox_ways(g.staged_nodes, g.refs, BOX).join(Q.with_tag(g.way_tags.withColumn("type", F.lit("way")), "priority", "1-URGENT").select("id"), "id", "left_semi")
    own = g.located.join(found.withColumnRenamed("id", "way_id"), "way_id", "left_semi").filter("tile is not null")
    return own.groupBy(F.col("way_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tile"))), lambda x: x["tile"].cast("string")), ",").alias("tiles"))


def tag_equality_nwr(g: Graph) -> DataFrame:
    return Q.union(Q.with_tag(g.all_tags, "status", "F"), Q.with_tag(g.all_tags, "returnflag", "R"), Q.with_tag(g.all_tags, "segment", "BUILDING"))


def tag_key_exists(g: Graph) -> DataFrame:
    return Q.with_tag(g.all_tags, "segment")


def tag_regex(g: Graph) -> DataFrame:
    return Q.with_tag(g.all_tags, "priority", pattern="^[12]-.*[GH]")


def recurse_down(g: Graph) -> DataFrame:
    """Everything below the relations with a tag; most of their sub-relations don't have it."""
    return Q.recurse_down(g.members, g.refs, g.relations.filter("exists(tags, t -> t.k = 'segment' and t.v = 'BUILDING')").select("id"))


def recurse_up(g: Graph) -> DataFrame:
    """From all nodes."""
    return Q.recurse_up(g.members, g.refs, g.nodes.select("id"))


def around(g: Graph) -> DataFrame:
    return Q.around(g.staged_nodes, LAT, LON, RADIUS)


def _rectangles(g: Graph) -> DataFrame:
    """A rectangle's four edges for each way whose nodes span one."""
    boxes = g.refs.join(g.nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").groupBy(F.col("way_id").alias("area_id")).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    ring = [("s", "w", "s", "e"), ("s", "e", "n", "e"), ("n", "e", "n", "w"), ("n", "w", "s", "w")]
    edges = F.explode(F.array(*(F.struct(*(F.col(c).alias(a) for c, a in zip(r, ("lat1", "lon1", "lat2", "lon2"), strict=True))) for r in ring)))
    return boxes.filter("s < n and w < e").select("area_id", edges.alias("x")).select("area_id", "x.*")


def is_in_rect(g: Graph) -> DataFrame:
    """All nodes in all rectangles."""
    return Q.is_in(g.nodes.select(F.col("id").alias("point_id"), "lat", "lon"), _rectangles(g), 1 << 26)


def ring_closure(g: Graph) -> DataFrame:
    """All rectangles, those with an id divisible by three without two of their edges."""
    return Q.closed_rings(_rectangles(g).filter("not (area_id % 3 = 0 and lat1 = lat2)"))


def way_centres(g: Graph) -> DataFrame:
    return Q.centres(g.nodes, g.refs)


def relation_nesting(g: Graph) -> DataFrame:
    """Relations that are members of themselves or of a relation that is their member."""
    child = g.members.filter("kind = 3").select(F.col("relation_id").alias("parent"), F.col("ref").alias("child"))
    back = child.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return child.join(back, ["parent", "child"], "left_semi").distinct()


def member_ways_foreach(g: Graph) -> DataFrame:
    """For each relation, its member ways with a status tag."""
    own = g.members.filter("kind = 2").select("relation_id", F.col("ref").alias("id"))
    return own.join(g.way_tags.filter("k = 'status'").select("id", "v"), "id").select("relation_id", "id", "v").distinct()


def iso_timestamp(g: Graph) -> DataFrame:
    events = g.spark.read.parquet(f"{g.sf_dir}/events.parquet")
    return events.select("event_id", P.iso_timestamp(F.unix_timestamp("ts")).alias("iso"))


_BOX = f"lat between {BOX[0]} and {BOX[2]} and lon between {BOX[1]} and {BOX[3]}"
_SEQ = _CTE + """, seq as (select kind, case when id % 89 = 7 then id - 1 else id end as id,
    case when kind = 2 and case when id % 89 = 7 then id - 1 else id end % 501 = 0 then 1000000 else kind * 1000000 + id // 4096 end as block,
    case when id % 97 = 5 then id * 2 + 3 else id * 2 end as pos
  from (select 1::bigint as kind, id from nodes union all select 2, id from ways))"""
_COPIES = _CTE + """, a as (select * from way_index where id % 13 <> 0),
b as (select id, case when id % 19 = 0 then idx + 1 else idx end as idx from way_index where id % 17 <> 0)"""
_DIFF = "select coalesce(a.id, b.id) as id, case when b.id is null then 'only first' when a.id is null then 'only second' when a.idx = b.idx then 'identical' else 'different' end as outcome from a full join b on a.id = b.id"
_SPANS = _CTE + ", spans as (select way_id % 100 as file, way_id * 8 + pos as s, way_id * 8 + pos + 5 as e from refs where pos % 3 <> 1), bounded as (select file, s, e from spans union all select file, max(e) + file, max(e) + file from spans group by file)"
_SHARD = _CTE + ", sh as (select id, ((row_number() over (order by id) - 1) % {n})::int as shard from (select o_orderkey + 1 as id from orders))"
_OVER = _SHARD.replace("{n}", "7") + ", ov as (select id, shard from sh where id % 43 <> 0 union all select id, ((shard + 2) % 7)::int from sh where id % 31 = 0 and id % 43 <> 0)"
_RECT = _CTE + """, rect as (select way_id as area_id, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from refs join nodes on id = node_id group by way_id having min(lat) < max(lat) and min(lon) < max(lon))"""
_SIZES = _CTE + ", sizes as (select way_id % 8 as file, way_id as key, 8 + count(*) * 37 + case when way_id % 23 = 0 then 700 else 0 end as size from refs group by way_id)"

SQL = {
    "order_violations_lag": _SEQ + """select block, pos, kind, id, case when kind < pk then 'kind after a later one' when id = pid then 'duplicate' else 'descending' end as violation
        from (select *, lag(kind) over (order by block, pos, kind, id) as pk, lag(id) over (order by block, pos, kind, id) as pid from seq) where kind < pk or (kind = pk and id <= pid)""",
    "duplicate_ids": _SEQ + "select kind, id, count(*) as n from seq group by all having count(*) > 1",
    "id_range_refusals": _SEQ + """, moved as (select kind, case when id % 211 = 0 then id - 5000 when id % 223 = 0 then id + 4398046511104 else id end as id from seq)
        select distinct kind, id, case when id < 1 then 'not positive' else 'too large' end as reason from moved where id < 1 or id > case when kind = 1 then 4398046511103 else 4294967295 end""",
    "unaligned_coordinates": _CTE + "select id, 50 + lat * 150 as nano from nodes where (50 + lat * 150) % 100 <> 0",
    "text_refusals": _CTE + _WAY_TAGS + "select id, k, 'value' as reason from way_tags where id % 709 = 0 or (id % 701 = 0 and strlen(v) * 40000 > 65535)",
    "empty_ways": _CTE + "select id from ways where id not in (select way_id from refs)",
    "key_order_violations": _CTE + "select file, seq, key from (select *, lag(key) over (partition by file order by seq) as prior from (select id % 50 as file, id as seq, idx // 67108864 as key from way_index where idx <> 254)) where prior >= key",
    "dataset_diff_full_outer": _COPIES + _DIFF,
    "outcome_counts": _COPIES + f"select outcome, count(*) as n from ({_DIFF}) group by outcome",
    "keyset_symmetric_difference": _COPIES + """select distinct idx, 'missing' as side from (select idx from a except all select idx from b)
        union all select distinct idx, 'unexpected' from (select idx from b except all select idx from a)""",
    "span_gaps": _SPANS + "select file, coalesce(p, 0) as gap_start, s as gap_end from (select *, max(e) over (partition by file order by s, e rows between unbounded preceding and 1 preceding) as p from bounded) where s > coalesce(p, 0)",
    "first_difference": _CTE + """, c as (select id % 40 as file, id // 40 * 16 as o, lpad(id::varchar, 16, '0') as x, lpad((case when id % 40 < 20 and id % 77 = 0 then id + 1000 else id end)::varchar, 16, '0') as y from ways)
        select file, min(case when x <> y then o + list_min([i for i in range(16) if x[i + 1] <> y[i + 1]]) end) as first_difference from c group by file""",
    "prefix_sum_positions": _CTE + "select way_id % 64 as file, way_id, size, (sum(size) over (partition by way_id % 64 order by way_id) - size)::bigint as start from (select way_id, count(*) * 8 + 8 as size from refs group by way_id)",
    "bucket_lookup_range": _CTE + """, starts as (select (n // 512)::bigint as bucket, id as start from (select id, row_number() over (order by id) - 1 as n from nodes) where n % 512 = 0)
        select way_id, pos, node_id, bucket from refs asof left join starts on node_id >= start""",
    "every_nth_shard": _SHARD.replace("{n}", "7") + "select id, shard from sh",
    "shard_disjointness": _OVER + "select a.shard as shard_a, b.shard as shard_b, a.id from ov a join ov b on a.id = b.id and a.shard < b.shard",
    "shard_coverage": _OVER + "select id from sh where id not in (select id from ov)",
    "shard_merge": _SHARD.replace("{n}", "5") + "select id % 300 as key, row_number() over (partition by id % 300 order by id, shard)::bigint - 1 as seq, id, shard from sh",
    "version_agreement": _SHARD.replace("{n}", "7") + "select count(distinct v) as versions, min(v) as version, count(distinct v) <= 1 as agree from (select case when shard = 3 then 'w' || (id % 5) else 'v' end as v from sh)",
    "pack_segments": _SIZES + """select file, segment, count(*) as n, sum(size)::bigint as bytes from (
        select *, (sum(case when size >= 1020 or prior >= 1020 or size + prior > 1020 then 1 else 0 end) over (partition by file order by key))::bigint as segment
        from (select *, lag(size) over (partition by file order by key) as prior from sizes)) group by file, segment""",
    "bbox_count": _CTE + f""", bn as (select id from nodes where {_BOX}), bw as (select distinct way_id as id from refs where node_id in (select id from bn)),
        br as (select distinct relation_id from member_values where (kind = 1 and ref in (select id from bn)) or (kind = 2 and ref in (select id from bw)))
        select 'node' as type, (select count(*) from bn) as n union all select 'way', (select count(*) from bw) union all select 'relation', (select count(*) from br)""",
    "bbox_nodes": _CTE + f"select id, lat, lon from nodes where {_BOX}",
    "id_lookup": _CTE + "select id, tile from nodes where id in (65, 66, 129, 700, 1000, 44801)",
    "ways_by_tag_bbox": _CTE + f"""select way_id as id, string_agg(tile, ',' order by pos) as tiles from refs join nodes on nodes.id = node_id
        where way_id in (select way_id from refs join nodes on nodes.id = node_id where {_BOX}) and way_id in (select id from ways where priority = '1-URGENT') group by way_id""",
    "tag_equality_nwr": _CTE + "select 'way' as type, id from ways where status = 'F' union all select 'node', id from nodes where l_returnflag = 'R' union all select 'relation', o_orderkey + 1 from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'",
    "tag_key_exists": "select 'relation' as type, o_orderkey + 1 as id from orders",
    "tag_regex": "select 'way' as type, o_orderkey + 1 as id from orders where regexp_matches(o_orderpriority, '^[12]-.*[GH]')",
    "recurse_down": "with recursive" + _CTE[4:] + """, rel(id) as (select o_orderkey + 1 from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' union select ref from rel join member_values on relation_id = id where kind = 3),
        w as (select distinct ref as id from member_values where kind = 2 and relation_id in (select id from rel))
        select 'relation' as type, id from rel union all select 'way', id from w union all
        select 'node', id from (select ref as id from member_values where kind = 1 and relation_id in (select id from rel) union select node_id from refs where way_id in (select id from w))""",
    "recurse_up": _CTE + """, w as (select distinct way_id as id from refs where node_id in (select id from nodes))
        select 'way' as type, id from w union all select distinct 'relation', relation_id from member_values where (kind = 1 and ref in (select id from nodes)) or (kind = 2 and ref in (select id from w))""",
    "around": _CTE + f"select id, lat * lat + lon * lon as distance2 from nodes where lat * lat + lon * lon <= {RADIUS * RADIUS}",
    "is_in_rect": _RECT + "select id as point_id, area_id from nodes join rect on lat >= s and lat < n and lon >= w and lon < e",
    "ring_closure": _RECT + "select area_id, area_id % 3 <> 0 as ok, case when area_id % 3 = 0 then 2 else 4 end::bigint as n_edges from rect",
    "way_centres": _CTE + "select way_id, floor((min(lat) + max(lat)) / 2)::bigint as lat, floor((min(lon) + max(lon)) / 2)::bigint as lon from refs join nodes on id = node_id group by way_id",
    "relation_nesting": _CTE + "select distinct a.relation_id as parent, a.ref as child from member_values a join member_values b on b.kind = 3 and b.relation_id = a.ref and b.ref = a.relation_id where a.kind = 3",
    "member_ways_foreach": _CTE + "select distinct relation_id, ref as id, status as v from member_values join ways on id = ref where kind = 2",
    "iso_timestamp": "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as iso from events",
}

QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for f in (order_violations_lag, duplicate_ids, id_range_refusals, unaligned_coordinates, text_refusals, empty_ways, key_order_violations, dataset_diff_full_outer, outcome_counts, keyset_symmetric_difference, span_gaps, first_difference, prefix_sum_positions, bucket_lookup_range, every_nth_shard, shard_disjointness, shard_coverage, shard_merge, version_agreement, pack_segments, pack_blocks, bbox_count, bbox_nodes, id_lookup, ways_by_tag_bbox, tag_equality_nwr, tag_key_exists, tag_regex, recurse_down, recurse_up, around, is_in_rect, ring_closure, way_centres, relation_nesting, member_ways_foreach, iso_timestamp)}
