"""A graph made from order tables by integer rules, the same in Spark and in SQL.

A node is a line of an order, a way the order, a relation a small group per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, rn, id, lat, lon, flags) of every line; rn numbers the lines of an order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    own = _table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus").withColumn("rn", F.row_number().over(w).cast("long"))
    own = own.select(F.col("l_orderkey").alias("ok"), "rn", (F.col("l_orderkey") * 64 + F.col("rn")).alias("id"), "l_returnflag", "l_linestatus")
    row = F.expr("200 + (ok * 7919) % 20000 + (rn * shiftleft(1L, cast(ok % 14 as int))) % 7000")
    column = F.expr("5400 + (ok * 104729) % 40000 + (rn * rn * shiftleft(1L, cast(ok % 13 as int))) % 14000")
    own = own.withColumn("row", row).withColumn("column", column)
    return own.select("ok", "rn", "id", F.expr("row * 65536 - 910000000 + (id * 40503) % 65536").alias("lat"), F.expr("(column - 32768) * 65536 + (id * 30011) % 65536").alias("lon"), "l_returnflag", "l_linestatus")


def nodes(lines: DataFrame) -> DataFrame:
    """(id, lat, lon, tags) of ``lines``; some that ways refer to are missing."""
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    return lines.filter("id % 29 <> 0").select("id", "lat", "lon", F.array(pair("returnflag", "l_returnflag"), pair("linestatus", "l_linestatus")).alias("tags"))


def refs(lines: DataFrame) -> DataFrame:
    """(way_id, pos, node_id) of ``lines``, pos from 0."""
    return lines.select((F.col("ok") + 1).alias("way_id"), (F.col("rn") - 1).alias("pos"), F.col("id").alias("node_id"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags); their refs are apart, and may be none."""
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    return _table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"), F.array(pair("status", "o_orderstatus"), pair("priority", "o_orderpriority")).alias("tags"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return own.select((F.col("o_orderkey") + 1).alias("id"), F.array(F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))).alias("tags"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation_id, pos, kind, ref, role), pos from 0; kinds are 1 node, 2 way, 3 relation."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_orderpriority").alias("priority"))
    counted = orders.crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("n"))))  # one row
    member = "named_struct('kind', {}, 'ref', {}, 'role', {})"
    node, way = member.format("1", "ok * 64 + 1", "'label'"), member.format("2", "ok + 1", "priority")
    more = [
        f"if(ok % 12 = 0, array({member.format('2', '(ok + 1) % n + 1', chr(39) + 'next' + chr(39))}), array())",
        f"if(ok % 7 = 0, array({member.format('1', 'ok * 64 + 2', chr(39) + 'stop' + chr(39))}), array())",
        f"if(ok % 5 = 0, array({member.format('3', '(ok * 31) % n + 1', chr(39) + 'sub' + chr(39))}), array())",
    ]
    listed = counted.withColumn("own", F.expr(f"concat(if(ok % 3 = 0, array({way}, {node}), array({node}, {way})), {', '.join(more)})"))
    return listed.select((F.col("ok") + 1).alias("relation_id"), F.posexplode("own").alias("pos", "m")).select("relation_id", F.col("pos").cast("long").alias("pos"), F.col("m.kind").cast("int").alias("kind"), F.col("m.ref").cast("long").alias("ref"), "m.role")


def _bit_sum(x: str, shift: int) -> str:
    return " + ".join(f"((({x}) >> {i}) & 1) * {1 << 2 * i + shift}" for i in range(16))


#: The same in SQL, as common table expressions.
SQL = f"""
lines as (
  select *, 200 + (ok * 7919) % 20000 + (rn * (1::bigint << (ok % 14)::int)) % 7000 as r,
    5400 + (ok * 104729) % 40000 + (rn * rn * (1::bigint << (ok % 13)::int)) % 14000 as c
  from (select l_orderkey as ok, rn, l_orderkey * 64 + rn as id, l_returnflag, l_linestatus
    from (select *, row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)})::bigint as rn from lineitem))),
nodes as materialized (
  select ok, rn, id, lat, lon, l_returnflag, l_linestatus,
    xor(({_bit_sum('(lat + 910000000) >> 16', 1)}) + ({_bit_sum('((lon + 4294967296) % 4294967296) >> 16', 0)}), 1073741824)::bigint as tile,
    (({_bit_sum('(lat + 910000000) & 65535', 1)}) + ({_bit_sum('((lon + 4294967296) % 4294967296) & 65535', 0)}))::bigint as lower
  from (select *, r * 65536 - 910000000 + (id * 40503) % 65536 as lat, (c - 32768) * 65536 + (id * 30011) % 65536 as lon from lines)
  where id % 29 <> 0),
refs as (select ok + 1 as way_id, rn - 1 as pos, id as node_id from lines),
ways as (select o_orderkey + 1 as id, o_orderstatus as status, o_orderpriority as priority from orders),
way_box as (
  select w.id, min(tile & 715827882) as rlo, max(tile & 715827882) as rhi, min(tile & 1431655765) as clo, max(tile & 1431655765) as chi, min(tile) as first
  from ways w left join refs on way_id = w.id left join nodes n on n.id = node_id group by w.id),
way_index as materialized (select id, {{extent}} as idx from way_box),
members as materialized (
  select ok + 1 as relation_id, (generate_subscripts(own, 1) - 1)::bigint as pos, unnest(own) as m from (
    select ok, list_concat(case when ok % 3 = 0 then [way, node] else [node, way] end,
      case when ok % 12 = 0 then [{{{{'kind': 2, 'ref': (ok + 1) % n + 1, 'role': 'next'}}}}] else [] end,
      case when ok % 7 = 0 then [{{{{'kind': 1, 'ref': ok * 64 + 2, 'role': 'stop'}}}}] else [] end,
      case when ok % 5 = 0 then [{{{{'kind': 3, 'ref': (ok * 31) % n + 1, 'role': 'sub'}}}}] else [] end) as own
    from (select o_orderkey as ok, {{{{'kind': 1, 'ref': o_orderkey * 64 + 1, 'role': 'label'}}}} as node, {{{{'kind': 2, 'ref': o_orderkey + 1, 'role': o_orderpriority}}}} as way, (select count(*) from orders) as n from orders))),
member_values as materialized (
  select relation_id, pos, m.kind as kind, m.ref as ref, m.role as role, case m.kind when 1 then n.tile when 2 then w.idx end as value
  from members left join nodes n on m.kind = 1 and n.id = m.ref left join way_index w on m.kind = 2 and w.id = m.ref)
"""


def _unbits(x: str, shift: int) -> str:
    return "(" + " + ".join(f"(({x}) >> {2 * i + shift} & 1) * {1 << i}" for i in range(16)) + ")"


def extent_sql(first: str = "first", rlo: str = "rlo", rhi: str = "rhi", clo: str = "clo", chi: str = "chi") -> str:
    """Extent index of a box in SQL, from its definition: rows and columns are decoded bit by bit."""
    sizes = [(1, 1), (2, 3), (4, 5), (8, 7), (16, 9), (32, 11), (64, 13)]
    fits = []
    for level, step in sizes:
        mask, bound = 65535 - (1 << step) + 1, 1 << step + 1
        conditions = [f"((({_unbits(hi, s)}) & {mask}) - (({_unbits(lo, s)}) & {mask}) + 4294967296) % 4294967296 < {bound}" for lo, hi, s in ((rlo, rhi, 1), (clo, chi, 0))]
        fits.append(f"when {' and '.join(conditions)} then (({rlo} | {clo}) & {4294967296 - (1 << 2 * step)}) | {2147483648 + level}")
    return f"(case when {rlo} is null then 254 when {rlo} = {rhi} and {clo} = {chi} then {first} {' '.join(fits)} else 2147483776 end)::bigint"


def graph_sql() -> str:
    return SQL.format(extent=extent_sql())
