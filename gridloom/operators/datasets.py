"""Datasets of nodes, ways and relations: joined, numbered, and written as XML and JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators.shards import ranked

KINDS = ("node", "way", "relation")


def merged(*parts: DataFrame) -> DataFrame:
    """Elements (kind, id, ...) of datasets with disjoint ids, with their place in the order of kind and id."""
    return ranked(reduce(DataFrame.unionByName, parts), "kind", "id").withColumn("seq", F.col("seq").cast("long"))


def listed_parts(refs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, refs) of ways and (id, members) of relations, in order."""
    of_ways = refs.groupBy(F.col("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("refs"))
    of_relations = members.groupBy(F.col("relation_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "ref", "role"))), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["role"].alias("role"))).alias("members"))
    return of_ways, of_relations


def elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """One table of (kind, id, lat, lon, refs, members, tags) from those of a graph."""
    of_ways, of_relations = listed_parts(refs, members)
    no_refs, no_members = F.lit(None).cast("array<bigint>").alias("refs"), F.lit(None).cast("array<struct<kind:int,ref:bigint,role:string>>").alias("members")
    nowhere = [F.lit(None).cast("long").alias(c) for c in ("lat", "lon")]
    rows = [
        nodes.select(F.lit(1).alias("kind"), "id", "lat", "lon", no_refs, no_members, "tags"),
        ways.join(of_ways, "id", "left").select(F.lit(2).alias("kind"), "id", *nowhere, F.coalesce("refs", F.array().cast("array<bigint>")).alias("refs"), no_members, "tags"),
        relations.join(of_relations, "id", "left").select(F.lit(3).alias("kind"), "id", *nowhere, no_refs, F.coalesce("members", F.array().cast("array<struct<kind:int,ref:bigint,role:string>>")).alias("members"), "tags"),
    ]
    return reduce(DataFrame.unionByName, rows)


# Characters that XML attributes and JSON strings don't bear.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))
#: What invented metadata are made of.
USERS = ("mapper", "Zoë & co", "名前", 'a"b<c>')


def xml_text(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), XML, text)


def json_text(text: Column) -> Column:
    """A JSON string, quotes included; what isn't ASCII stays as it is."""
    quoted = F.to_json(F.struct(text.alias("x")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def metadata(kind: Column, id_: Column) -> dict[str, Column]:
    """Invented version, time, changeset and user of an element, from its id alone."""
    big = id_.cast("decimal(20,0)")
    wrapped = lambda factor, most: ((big * F.lit(factor).cast("decimal(12,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)") % most).cast("long")
    return {
        "version": (1 + id_ % 9).cast("long"),
        "iso": P.iso_timestamp(1_191_715_200 + wrapped(40_503, 600_000_000)),
        "changeset": 1 + wrapped(2_654_435_761, 150_000_000),
        "uid": (1 + id_ % 20_000_000 + kind - 1).cast("long"),
        "user": F.element_at(F.array(*map(F.lit, USERS)), (id_ % len(USERS) + 1).cast("int")),
    }


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind.cast("int"))


def xml_elements(rows: DataFrame, with_metadata: bool = False) -> DataFrame:
    """(kind, id, xml) of ``elements``: lines as they stand in a file, coordinates with seven decimals."""
    kind, id_ = F.col("kind"), F.col("id")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    head = [F.lit("  <"), _name(kind), attribute("id", id_.cast("string"))]
    if with_metadata:
        m = metadata(kind, id_)
        head += [attribute("version", m["version"].cast("string")), attribute("timestamp", m["iso"]), attribute("changeset", m["changeset"].cast("string")), attribute("uid", m["uid"].cast("string")), attribute("user", xml_text(m["user"]))]
    place = F.when(kind == 1, F.concat(attribute("lat", P.degrees_text(F.col("lat"))), attribute("lon", P.degrees_text(F.col("lon"))))).otherwise("")
    lines = lambda name, fields: F.array_join(F.transform(name, lambda x: F.concat(*fields(x))), "")
    refs = F.coalesce(lines("refs", lambda r: [F.lit('    <nd ref="'), r.cast("string"), F.lit('"/>\n')]), F.lit(""))
    members = F.coalesce(lines("members", lambda m: [F.lit('    <member type="'), _name(m["kind"]), F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), xml_text(m["role"]), F.lit('"/>\n')]), F.lit(""))
    tags = lines("tags", lambda t: [F.lit('    <tag k="'), xml_text(t["k"]), F.lit('" v="'), xml_text(t["v"]), F.lit('"/>\n')])
    short = (kind == 1) & (F.size("tags") == 0)
    return rows.select("kind", "id", F.concat(*head, place, F.when(short, "/>").otherwise(F.concat(F.lit(">\n"), refs, members, tags, F.lit("  </"), _name(kind), F.lit(">")))).alias("xml"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(kind, id, line) of ``elements``: coordinates in units, the marker in place of invalid ones."""
    kind, valid = F.col("kind"), P.is_valid(F.col("lat"), F.col("lon"))
    place = F.concat(F.lit(',"lat":'), F.when(valid, F.col("lat")).otherwise(F.lit(P.MARKER_LAT)).cast("string"), F.lit(',"lon":'), F.when(valid, F.col("lon")).otherwise(F.lit(P.MARKER_LON)).cast("string"))
    refs = F.concat(F.lit(',"nodes":['), F.array_join(F.transform("refs", lambda r: r.cast("string")), ","), F.lit("]"))
    member = lambda m: F.concat(F.lit('{"type":"'), _name(m["kind"]), F.lit('","ref":'), m["ref"].cast("string"), F.lit(',"role":'), json_text(m["role"]), F.lit("}"))
    members = F.concat(F.lit(',"members":['), F.array_join(F.transform("members", member), ","), F.lit("]"))
    tags = F.concat(F.lit(',"tags":{'), F.array_join(F.transform("tags", lambda t: F.concat(json_text(t["k"]), F.lit(":"), json_text(t["v"]))), ","), F.lit("}}"))
    body = F.when(kind == 1, place).when(kind == 2, refs).otherwise(members)
    return rows.select("kind", "id", F.concat(F.lit('{"type":"'), _name(kind), F.lit('","id":'), F.col("id").cast("string"), body, tags).alias("line"))
