"""Validation: each function returns the rows that violate a rule, with what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators.shards import in_ranges

MOST_NODE, MOST_OTHER, LONGEST_TEXT = 1 << 42, (1 << 32) - 1, 65_535


def order_violations(elements: DataFrame, block: str = "block", pos: str = "pos") -> DataFrame:
    """Elements (block, pos, kind 1-3, id) that don't follow the one before: kinds ascend, ids ascend within a kind.

    Blocks are checked apart, then the seams between them over one row a block, so no task sees all elements.
    """
    own = Window.partitionBy(block).orderBy(pos)
    inside = elements.withColumns({"prior_kind": F.lag("kind").over(own), "prior_id": F.lag("id").over(own), "nth": F.row_number().over(own)})
    last = elements.groupBy(block).agg(F.max_by(F.struct("kind", "id"), pos).alias("last"))
    seams = last.select(block, F.lag("last").over(Window.orderBy(block)).alias("before"))  # a row a block
    first = inside.filter("nth = 1").drop("prior_kind", "prior_id").join(seams, block).select(*elements.columns, F.col("before.kind").alias("prior_kind"), F.col("before.id").alias("prior_id"))
    pairs = inside.filter("nth > 1").select(*elements.columns, "prior_kind", "prior_id").unionByName(first)
    what = (
        F.when(F.col("kind") < F.col("prior_kind"), "kind after a later one")
        .when((F.col("kind") == F.col("prior_kind")) & (F.col("id") == F.col("prior_id")), "duplicate")
        .when((F.col("kind") == F.col("prior_kind")) & (F.col("id") < F.col("prior_id")), "descending")
    )
    return pairs.withColumn("violation", what).filter("violation is not null")


def duplicate_ids(elements: DataFrame) -> DataFrame:
    return elements.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def id_range_refusals(elements: DataFrame) -> DataFrame:
    """Elements (kind, id) whose id the index can't hold."""
    top = F.when(F.col("kind") == 1, F.lit(MOST_NODE - 1)).otherwise(F.lit(MOST_OTHER))
    return elements.withColumn("reason", F.when(F.col("id") < 1, "not positive").when(F.col("id") > top, "too large")).filter("reason is not null")


def invalid_positions(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~P.is_valid(F.col("lat"), F.col("lon")))


def text_refusals(tags: DataFrame) -> DataFrame:
    """Tags (id, k, v) with a text that is too long in UTF-8, or absent."""
    long_ = lambda c: F.coalesce(F.octet_length(c) > LONGEST_TEXT, F.lit(True))
    return tags.withColumn("reason", F.when(long_("k"), "key").when(long_("v"), "value")).filter("reason is not null")


def unaligned_coordinates(raw: DataFrame, granularity: int, offset: int = 0) -> DataFrame:
    """Raw coordinates (id, raw) in nanodegrees (offset + granularity * raw) that aren't whole 1e-7 degrees."""
    nano = F.lit(offset) + F.lit(granularity) * F.col("raw")
    return raw.withColumn("nano", nano).filter(F.col("nano") % 100 != 0)


def empty_or_unplaced(ways: DataFrame, refs: DataFrame) -> DataFrame:
    """Ways without references."""
    return ways.join(refs.select(F.col("way_id").alias("id")), "id", "left_anti")


def key_order_violations(groups: DataFrame, file: str, seq: str, *key: str) -> DataFrame:
    """Groups whose key doesn't follow that before it in its file."""
    own = in_ranges(groups.withColumn("_key", F.struct(*key)), file, seq)
    earlier = Window.partitionBy(file).orderBy("_part")
    seams = own.groupBy(file, "_part").agg(F.max_by("_key", seq).alias("_last")).select(file, "_part", F.lag("_last").over(earlier).alias("_seam"))  # a row a range
    inside = F.lag("_key").over(Window.partitionBy(file, "_part").orderBy(seq))
    found = own.withColumn("_inside", inside).join(seams, [file, "_part"]).withColumn("prior", F.coalesce("_inside", "_seam"))
    return found.filter(F.col("prior") >= F.col("_key")).drop("_part", "_key", "_inside", "_seam")


LONGEST_ROLE = LONGEST_TEXT


def dataset_violations(nodes: DataFrame, ways: DataFrame, relations: DataFrame, refs: DataFrame, members: DataFrame, tags: DataFrame) -> DataFrame:
    """(rule, kind, id) of elements that break an invariant of datasets: nodes, ways, relations (id), refs (way_id, node_id), members (relation_id, kind, ref, role), tags (kind, id, k, v)."""
    every = nodes.select(F.lit(1).alias("kind"), "id").unionByName(ways.select(F.lit(2).alias("kind"), "id")).unionByName(relations.select(F.lit(3).alias("kind"), "id"))
    rule = lambda df, name, kind="kind": df.select(F.lit(name).alias("rule"), kind, "id")
    parts = [
        rule(every.filter("id < 1"), "id not positive"),
        rule(duplicate_ids(every), "id twice"),
        rule(every.filter((F.col("kind") > 1) & (F.col("id") > MOST_OTHER)), "id too large"),
        rule(text_refusals(tags), "text too long"),
        rule(refs.filter("node_id < 1").select(F.lit(2).alias("kind"), F.col("way_id").alias("id")), "reference not positive"),
        rule(members.filter("ref < 1").select(F.lit(3).alias("kind"), F.col("relation_id").alias("id")), "reference not positive"),
        rule(members.filter((F.col("kind") > 1) & (F.col("ref") > MOST_OTHER)).select(F.lit(3).alias("kind"), F.col("relation_id").alias("id")), "reference too large"),
        rule(members.filter(F.octet_length("role") > LONGEST_ROLE).select(F.lit(3).alias("kind"), F.col("relation_id").alias("id")), "role too long"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
