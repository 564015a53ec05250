"""Queries of extents, tags and members over the fixture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators import extents as X
from gridloom.operators import tags as T
from gridloom.operators.shards import ranked
from gridloom.operators.storage import sorted_by_tile, staged
from gridloom.sources import fixture as G


class Graph:
    """The fixture graph's tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        made = {
            "lines": lambda: self._staged("lines", G.lines),
            "raw_nodes": lambda: G.nodes(self.lines),
            "nodes": lambda: X.placed(self.raw_nodes),
            "staged_nodes": lambda: staged(self.spark, ("by tile", self.sf_dir), lambda: sorted_by_tile(self.nodes)),
            "refs": lambda: G.refs(self.lines),
            "ways": lambda: G.ways(self.spark, self.sf_dir),  # columns of orders as they are
            "relations": lambda: self._staged("relations", G.relations),
            "members": lambda: self._staged("members", G.members),
            "located": lambda: X.located_refs(self.refs, self.nodes),
            "way_index": lambda: X.way_index(self.ways, self.located),
            "values": lambda: X.member_values(self.members, self.nodes, self.way_index),
            "relation_index": lambda: X.relation_index(self.relations, self.values),
            "node_tags": lambda: self._node_tags(),
            "way_tags": lambda: T.exploded(self.ways, self.way_index),
            "relation_tags": lambda: T.exploded(self.relations, self.relation_index),
        }
        if name not in made:
            raise AttributeError(name)
        self.__dict__[name] = value = made[name]()
        return value

    def _staged(self, name: str, make) -> DataFrame:
        """The fixture's table, made once a session: it stands for a file that was read."""
        return staged(self.spark, (name, self.sf_dir), lambda: make(self.spark, self.sf_dir))

    def _node_tags(self) -> DataFrame:
        own = self.nodes.select("id", F.col("tile").alias("idx"), F.posexplode("tags").alias("pos", "t"))
        return own.select("id", "idx", F.col("pos").cast("long").alias("pos"), "t.k", "t.v")

    @property
    def all_tags(self) -> DataFrame:
        """(type, id, idx, pos, k, v)"""
        typed = [df.withColumn("type", F.lit(t)) for t, df in (("node", self.node_tags), ("way", self.way_tags), ("relation", self.relation_tags))]
        return typed[0].unionByName(typed[1]).unionByName(typed[2])


def node_place(g: Graph) -> DataFrame:
    return g.nodes.select("id", "tile", "lower")


def tile_histogram(g: Graph) -> DataFrame:
    return g.nodes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


def coarse_region_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy(P.coarse(F.col("tile")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def invalid_marker_nodes(g: Graph) -> DataFrame:
    moved = g.raw_nodes.withColumn("lat", F.col("lat") + F.when(F.col("id") % 101 == 0, 2_000_000_000).otherwise(0))
    return X.placed(moved.filter(~P.is_valid(F.col("lat"), F.col("lon")))).select("id", "tile")


def way_index(g: Graph) -> DataFrame:
    return g.way_index


def way_index_classes(g: Graph) -> DataFrame:
    return X.index_classes(g.way_index)


def way_geometry(g: Graph) -> DataFrame:
    return X.way_geometry(g.located, g.way_index)


def missing_refs_anti(g: Graph) -> DataFrame:
    return g.refs.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("way_id", "pos", "node_id")


def located_refs_semi(g: Graph) -> DataFrame:
    return g.refs.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("way_id", "pos", "node_id")


def relation_members_join(g: Graph) -> DataFrame:
    return g.values.select("relation_id", "pos", "kind", "ref", "value")


def relation_index(g: Graph) -> DataFrame:
    return g.relation_index


def relation_index_classes(g: Graph) -> DataFrame:
    return X.index_classes(g.relation_index)


def relation_geometry(g: Graph) -> DataFrame:
    """Located members of relations whose index asks for geometry: nodes' tiles, then ways' indexes, each in order."""
    from pyspark.sql import Window

    wanted = g.relation_index.filter(P.has_geometry(F.col("idx"))).select(F.col("id").alias("relation_id"))
    own = g.values.filter("value is not null").join(wanted, "relation_id", "left_semi")
    return own.select("relation_id", (F.row_number().over(Window.partitionBy("relation_id").orderBy("kind", "pos")) - 1).cast("long").alias("at"), "kind", "value")


def local_tag_postings(g: Graph) -> DataFrame:
    return T.local_postings(g.way_tags)


def node_local_tag_postings(g: Graph) -> DataFrame:
    return T.local_postings(g.node_tags)


def relation_local_tag_postings(g: Graph) -> DataFrame:
    return T.local_postings(g.relation_tags)


def global_tag_postings(g: Graph) -> DataFrame:
    return T.global_postings(g.node_tags)


def way_global_tag_postings(g: Graph) -> DataFrame:
    return T.global_postings(g.way_tags)


def tag_pair_rank(g: Graph) -> DataFrame:
    return T.pair_rank(g.all_tags)


def key_dictionary(g: Graph) -> DataFrame:
    return T.dictionary(g.way_tags, "k", "id", "pos")


def role_dictionary(g: Graph) -> DataFrame:
    return T.dictionary(g.members, "role", "relation_id", "pos")


def distinct_key_counts(g: Graph) -> DataFrame:
    return g.all_tags.groupBy("type").agg(F.countDistinct("k").alias("keys"), F.countDistinct("k", "v").alias("pairs"))


def id_map_blocks(g: Graph) -> DataFrame:
    return X.id_map_blocks(g.nodes)


def kind_counts(g: Graph) -> DataFrame:
    """Elements, references and members by type, with the least and greatest id."""
    rows = [g.nodes.select(F.lit("node").alias("type"), "id", F.lit(0).alias("parts"))]
    parts = g.refs.groupBy(F.col("way_id").alias("id")).agg(F.count(F.lit(1)).alias("parts"))
    rows.append(g.ways.join(parts, "id", "left").select(F.lit("way").alias("type"), "id", F.coalesce("parts", F.lit(0)).alias("parts")))
    parts = g.members.groupBy(F.col("relation_id").alias("id")).agg(F.count(F.lit(1)).alias("parts"))
    rows.append(g.relations.join(parts, "id", "left").select(F.lit("relation").alias("type"), "id", F.coalesce("parts", F.lit(0)).alias("parts")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.sum("parts").cast("long").alias("parts"))


def object_bytes_by_file(g: Graph) -> DataFrame:
    rows = [T.object_bytes(T.local_postings(df), n).select(F.lit(t).alias("type"), "local_bytes", "global_bytes") for t, df, n in (("node", g.node_tags, 8), ("way", g.way_tags, 4), ("relation", g.relation_tags, 4))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def split_keys(g: Graph) -> DataFrame:
    return T.split_keys(T.global_postings(g.node_tags), 8, 1 << 14)


def class_of_key(g: Graph) -> DataFrame:
    return g.relation_index.select("id", P.class_of(F.col("idx")).alias("class"), P.describe_index(F.col("idx")).alias("key"))


def index_sort_order(g: Graph) -> DataFrame:
    """Groups of the way index in file order: by the lower 31 bits, then the whole."""
    keys = g.way_index.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).withColumn("low", P.index_order(F.col("idx"))[0])
    return ranked(keys, "low", "idx").select("idx", "n", (F.col("seq") + 1).cast("long").alias("at"))


def coordinate_text(g: Graph) -> DataFrame:
    return g.nodes.select("id", P.degrees_text(F.col("lat")).alias("lat_text"), P.degrees_text(F.col("lon")).alias("lon_text"))


def tile_origins(g: Graph) -> DataFrame:
    tiles = g.nodes.select("tile").distinct()
    column = P.upper_column(F.col("tile"))
    return tiles.select("tile", P.tile_south(F.col("tile")).alias("south"), P.tile_west(F.col("tile")).alias("west"), P.tile_of_cell(P.upper_row(F.col("tile")), column).alias("again"))


def json_elements(g: Graph) -> DataFrame:
    """Ways as JSON lines: type, id, nodes, tags."""
    nodes = g.refs.groupBy(F.col("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    own = g.ways.join(nodes, "id", "left")
    tags = F.map_from_entries(F.transform("tags", lambda t: F.struct(t["k"], t["v"])))
    return own.select("id", F.to_json(F.struct(F.lit("way").alias("type"), "id", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"), tags.alias("tags"))).alias("line"))


_CTE = "with " + G.graph_sql()
_NODE_TAGS = ", node_tags as (select id, tile as idx, 0::bigint as pos, 'returnflag' as k, l_returnflag as v from nodes union all select id, tile, 1, 'linestatus', l_linestatus from nodes)"
_WAY_TAGS = ", way_tags as (select id, idx, 0::bigint as pos, 'status' as k, status as v from ways join way_index using (id) union all select id, idx, 1, 'priority', priority from ways join way_index using (id))"


def _corner_sql(v: str) -> str:
    """Corners of an index's area, in SQL, one level after the other."""
    rows = {}
    for name in ("rlo", "rhi", "clo", "chi"):
        axis = 715827882 if name[0] == "r" else 1431655765
        cases = [f"when {v} & 2147483648 = 0 then {v} & {axis}"]
        for level, step in ((1, 1), (2, 3), (4, 5), (8, 7), (16, 9), (32, 11), (64, 13)):
            mask = axis & (2147483647 - ((1 << 2 * step) - 1))
            corner = f"({v} & {mask})"
            if name[1:] == "hi":
                shift = 1 if name[0] == "r" else 0
                cell = f"(({G._unbits(corner, shift)} + {(1 << step + 1) - 1}) & 65535)"
                corner = f"({G._bit_sum(cell, shift)})"
            cases.append(f"when {v} & {level} > 0 then {corner}")
        rows[name] = f"(case {' '.join(cases)} end)::bigint as {name}"
    return ", ".join(rows.values())


_RELATION = f""", corner as (select relation_id, pos, value, {_corner_sql('value')}, value & 2147483648 > 0 as comp, value & 2147483648 > 0 and value & 127 = 0 as anyw
    from member_values where value is not null),
folded as (select relation_id, list_reduce(list({{'rlo': rlo, 'rhi': rhi, 'clo': clo, 'chi': chi, 'comp': comp, 'anyw': anyw, 'value': value}} order by pos),
    lambda a, x: {{'rlo': least(a.rlo, x.rlo), 'rhi': case when not x.comp and x.rlo < a.rlo then a.rhi else greatest(a.rhi, x.rhi) end,
      'clo': least(a.clo, x.clo), 'chi': case when not x.comp and x.clo < a.clo then a.chi else greatest(a.chi, x.chi) end,
      'comp': a.comp, 'anyw': a.anyw or x.anyw, 'value': a.value}}) as f from corner group by relation_id),
relation_index as materialized (select o_orderkey + 1 as id, (case when f is null then 254 when f.anyw then 2147483776 else {G.extent_sql('f.value', 'f.rlo', 'f.rhi', 'f.clo', 'f.chi')} end)::bigint as idx
  from orders left join folded on relation_id = o_orderkey + 1),
relation_tags as (select o_orderkey + 1 as id, idx, 0::bigint as pos, 'segment' as k, c_mktsegment as v from orders join relation_index on id = o_orderkey + 1 left join customer on c_custkey = o_custkey)
"""
_ALL = _NODE_TAGS + _WAY_TAGS + _RELATION
_TYPED = ", all_tags as (select 'node' as type, * from node_tags union all select 'way', * from way_tags union all select 'relation', * from relation_tags)"
_CLASS = "case when idx = 254 then 'none' when idx & 2147483648 = 0 then 'tile' else 'level 0x' || lower(to_hex(idx & 255 & -(idx & 255))) end"
_GEO = "idx & 2147483648 > 0 and idx & 1 = 0"

SQL = {
    "node_place": _CTE + "select id, tile, lower from nodes",
    "tile_histogram": _CTE + "select tile, count(*) as n from nodes group by tile",
    "coarse_region_counts": _CTE + "select tile & 2147483392 as region, count(*) as n from nodes group by 1",
    "invalid_marker_nodes": _CTE + "select id, 2132256657::bigint as tile from nodes where id % 101 = 0",
    "way_index": _CTE + "select id, idx from way_index",
    "way_index_classes": _CTE + f"select {_CLASS} as class, count(*) as n from way_index group by 1",
    "way_geometry": _CTE + f"select way_id, pos, coalesce(tile, 0) as tile, coalesce(lower, 0) as lower from refs join way_index w on w.id = way_id and {_GEO} left join nodes n on n.id = node_id",
    "missing_refs_anti": _CTE + "select way_id, pos, node_id from refs where node_id not in (select id from nodes)",
    "located_refs_semi": _CTE + "select way_id, pos, node_id from refs where node_id in (select id from nodes)",
    "relation_members_join": _CTE + "select relation_id, pos, kind, ref, value from member_values",
    "relation_index": _CTE + _RELATION + "select id, idx from relation_index",
    "relation_index_classes": _CTE + _RELATION + f"select {_CLASS} as class, count(*) as n from relation_index group by 1",
    "relation_geometry": _CTE + _RELATION + f"select relation_id, row_number() over (partition by relation_id order by kind, pos)::bigint - 1 as at, kind, value from member_values join relation_index on id = relation_id and {_GEO} where value is not null",
    "local_tag_postings": _CTE + _WAY_TAGS + "select distinct (idx & 2147483392) >> 8 as region, k, v, id from way_tags",
    "node_local_tag_postings": _CTE + _NODE_TAGS + "select distinct (idx & 2147483392) >> 8 as region, k, v, id from node_tags",
    "relation_local_tag_postings": _CTE + _RELATION + "select distinct (idx & 2147483392) >> 8 as region, k, v, id from relation_tags",
    "global_tag_postings": _CTE + _NODE_TAGS + "select distinct k, v, (idx & 2147483392) >> 8 as region, id from node_tags",
    "way_global_tag_postings": _CTE + _WAY_TAGS + "select distinct k, v, (idx & 2147483392) >> 8 as region, id from way_tags",
    "tag_pair_rank": _CTE + _ALL + _TYPED + "select k, v, dense_rank() over (order by k, v)::bigint as rank from (select distinct k, v from all_tags)",
    "key_dictionary": _CTE + _WAY_TAGS + "select k, row_number() over (order by seen)::bigint - 1 as k_id from (select k, min((id, pos)) as seen from way_tags group by k)",
    "role_dictionary": _CTE + "select role, row_number() over (order by seen)::bigint - 1 as role_id from (select role, min((relation_id, pos)) as seen from member_values group by role)",
    "distinct_key_counts": _CTE + _ALL + _TYPED + "select type, count(distinct k) as keys, count(distinct (k, v)) as pairs from all_tags group by type",
    "id_map_blocks": _CTE + "select id // 65536 as block, count(*) as n, min(id % 65536 * 4) as min_slot, max(id % 65536 * 4) as max_slot from nodes group by 1",
    "kind_counts": _CTE + """select 'node' as type, count(*) as n, min(id) as least, max(id) as greatest, 0::bigint as parts from nodes
        union all select 'way', count(*), min(id), max(id), (select count(*) from refs) from ways
        union all select 'relation', count(*), min(o_orderkey + 1), max(o_orderkey + 1), (select count(*) from members) from orders""",
    "object_bytes_by_file": _CTE + _ALL + "".join(f"{u} select '{t}' as type, n * {b} as local_bytes, n * {b + 3} as global_bytes from (select count(*) as n from (select distinct id, k, v, idx & 2147483392 from {t}_tags))" for u, t, b in (("", "node", 8), (" union all", "way", 4), (" union all", "relation", 4))),
    "split_keys": _CTE + _NODE_TAGS + "select k, v, bytes, ceil(bytes / 11 / ((16368 - strlen(k) - strlen(v)) // 11))::bigint as blocks from (select k, v, count(*) * 11 as bytes from (select distinct k, v, id from node_tags) group by k, v) where bytes + 12 + strlen(k) + strlen(v) >= 16380",
    "class_of_key": _CTE + _RELATION + f"select id, {_CLASS} as class, '0x' || lower(lpad(to_hex(idx), 8, '0')) as key from relation_index",
    "index_sort_order": _CTE + "select idx, n, row_number() over (order by idx & 2147483647, idx)::bigint as at from (select idx, count(*) as n from way_index group by idx)",
    "coordinate_text": _CTE + "select id, case when lat < 0 then '-' else '' end || (abs(lat) // 10000000) || '.' || lpad((abs(lat) % 10000000)::varchar, 7, '0') as lat_text, case when lon < 0 then '-' else '' end || (abs(lon) // 10000000) || '.' || lpad((abs(lon) % 10000000)::varchar, 7, '0') as lon_text from nodes",
    "tile_origins": _CTE + "select distinct tile, ((lat + 910000000) >> 16 << 16) - 910000000 as south, lon - (lon + 2147483648) % 65536 as west, tile as again from nodes",
    "json_elements": _CTE + """select id, '{"type":"way","id":' || id || ',"nodes":[' || coalesce(n, '') || '],"tags":{"status":"' || status || '","priority":"' || priority || '"}}' as line
        from ways left join (select way_id, string_agg(node_id, ',' order by pos) as n from refs group by way_id) on way_id = id""",
}

QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for f in (node_place, tile_histogram, coarse_region_counts, invalid_marker_nodes, way_index, way_index_classes, way_geometry, missing_refs_anti, located_refs_semi, relation_members_join, relation_index, relation_index_classes, relation_geometry, local_tag_postings, node_local_tag_postings, relation_local_tag_postings, global_tag_postings, way_global_tag_postings, tag_pair_rank, key_dictionary, role_dictionary, distinct_key_counts, id_map_blocks, kind_counts, object_bytes_by_file, split_keys, class_of_key, index_sort_order, coordinate_text, tile_origins, json_elements)}
