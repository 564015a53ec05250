"""Tiles of nodes, extent indexes of ways and relations, and the joins that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import position as P


def placed(nodes: DataFrame) -> DataFrame:
    """nodes (id, lat, lon, ...) with the tile and the position in it; invalid positions go to the marker's."""
    return nodes.withColumns({"tile": P.place_tile(F.col("lat"), F.col("lon")), "lower": P.place_lower(F.col("lat"), F.col("lon"))})


def located_refs(refs: DataFrame, places: DataFrame) -> DataFrame:
    """refs (way_id, pos, node_id) with tile and lower of their nodes; null where the node is missing."""
    return refs.join(places.select(F.col("id").alias("node_id"), "tile", "lower"), "node_id", "left").select("way_id", "pos", "node_id", "tile", "lower")


def way_index(ways: DataFrame, located: DataFrame) -> DataFrame:
    """(id, idx) of every way: minima and maxima of row and column bits, summed up before the shuffle."""
    rows, columns = F.col("tile").bitwiseAND(F.lit(P.ROW_BITS)), F.col("tile").bitwiseAND(F.lit(P.COLUMN_BITS))
    boxes = located.groupBy(F.col("way_id").alias("id")).agg(F.min(rows).alias("row_lo"), F.max(rows).alias("row_hi"), F.min(columns).alias("col_lo"), F.max(columns).alias("col_hi"), F.min("tile").alias("first"))
    return ways.select("id").join(boxes, "id", "left").select("id", P.extent_index(*(F.col(c) for c in ("first", *P.CORNERS[:4]))).alias("idx"))


def way_geometry(located: DataFrame, indexes: DataFrame) -> DataFrame:
    """(way_id, pos, tile, lower) for ways whose index asks for it; zeros where a node is missing, so that positions match refs."""
    wanted = indexes.filter(P.has_geometry(F.col("idx"))).select(F.col("id").alias("way_id"))
    return located.join(wanted, "way_id", "left_semi").select("way_id", "pos", F.coalesce("tile", F.lit(0)).alias("tile"), F.coalesce("lower", F.lit(0)).alias("lower"))


def member_values(members: DataFrame, places: DataFrame, indexes: DataFrame) -> DataFrame:
    """members (relation_id, pos, kind, ref, role) with ``value``: a node's tile, a way's index (NO_POSITION included), else null."""
    nodes = places.select(F.lit(1).alias("kind"), F.col("id").alias("ref"), F.col("tile").alias("value"))
    ways = indexes.select(F.lit(2).alias("kind"), F.col("id").alias("ref"), F.col("idx").alias("value"))
    return members.join(nodes.unionByName(ways), ["kind", "ref"], "left").select("relation_id", "pos", "kind", "ref", "role", "value")


def relation_index(relations: DataFrame, values: DataFrame) -> DataFrame:
    """(id, idx): members folded in order, since near the date line the order decides. Corners are computed before the fold."""
    parts = values.select("relation_id", "pos", "value", *(c.alias(n) for n, c in P.corners(F.col("value")).items()))
    names = P.CORNERS
    listed = parts.groupBy(F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value", *names)))).alias("parts"))

    def widen(low: str, high: str):
        """Plain parts below the box don't also raise it."""

        def both(acc, x):
            stays = ~x["compound"] & (x[low] < acc[low])
            return F.least(acc[low], x[low]).alias(low), F.when(stays, acc[high]).otherwise(F.greatest(acc[high], x[high])).alias(high)

        return both

    rows, columns = widen("row_lo", "row_hi"), widen("col_lo", "col_hi")
    first = F.get(F.col("parts"), F.lit(0))
    start = F.struct(*(first[n].alias(n) for n in names[:4]), first["anywhere"].alias("anywhere"))
    fold = lambda acc, x: F.struct(*rows(acc, x), *columns(acc, x), (acc["anywhere"] | x["anywhere"]).alias("anywhere"))
    boxes = listed.select("id", first["value"].alias("first"), F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), start, fold).alias("box"))
    index = F.when(F.col("box.anywhere"), F.lit(P.ANYWHERE)).otherwise(P.extent_index(F.col("first"), *(F.col(f"box.{n}") for n in names[:4])))
    return relations.select("id").join(boxes.select("id", index.alias("idx")), "id", "left").select("id", F.coalesce("idx", F.lit(P.NO_POSITION)).alias("idx"))


def index_classes(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy(P.class_of(F.col("idx")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def id_map_blocks(indexes: DataFrame) -> DataFrame:
    """Blocks of 65,536 ids that are in use."""
    own = indexes.select(P.block_number(F.col("id")).alias("block"), P.slot(F.col("id")).alias("slot"))
    return own.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("min_slot"), F.max("slot").alias("max_slot"))
