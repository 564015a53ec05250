"""Sharding of a sequence, checks that shards part it, and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.storage import stored


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows written in ranges of ``order``, with the range of each (``_part``); what a window needs of the ranges before is then one row each."""
    return stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``seq`` from 0 in this order: counted within ranges, then the ranges' starts are added."""
    own = in_ranges(rows, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return own.withColumn("_at", inside).join(F.broadcast(starts), "_part").withColumn("seq", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def numbered(rows: DataFrame, order: str, width: int = 1 << 16) -> DataFrame:
    """rows with ``seq`` from 0 in the order of a long column: counted within ranges of it, then the ranges' starts are added."""
    block = F.floor(F.col(order) / width)
    own = rows.withColumn("_range", block)
    starts = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return own.withColumn("_at", inside).join(starts, "_range").withColumn("seq", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def every_nth_shard(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """rows with the shard of each: its place in the sequence modulo the number of shards."""
    return numbered(rows, order).withColumn("shard", (F.col("seq") % shards).cast("int")).drop("seq")


def overlaps(sharded: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that more than one shard has."""
    return sharded.groupBy(key).agg(F.countDistinct("shard").alias("n")).filter("n > 1")


def pairwise_overlaps(sharded: DataFrame, key: str) -> DataFrame:
    """(shard_a, shard_b, key) for every key that two shards have."""
    a, b = (sharded.select(F.col("shard").alias(f"shard_{x}"), key).distinct() for x in "ab")
    return a.join(b, key).filter("shard_a < shard_b").select("shard_a", "shard_b", key)


def uncovered(whole: DataFrame, sharded: DataFrame, key: str) -> DataFrame:
    """Keys of the whole that no shard has."""
    return whole.select(key).exceptAll(sharded.select(key).distinct()).distinct()


def merge_shards(sharded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Objects of all shards numbered under each key, by ``order``, then by shard: a stable merge."""
    w = Window.partitionBy(key).orderBy(*order, "shard")
    return sharded.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def version_agreement(sharded: DataFrame, version: str) -> DataFrame:
    """One row: whether all shards have one version, and which."""
    n = F.countDistinct(version)
    return sharded.agg(n.alias("versions"), F.min(version).alias("version"), (n <= 1).alias("agree"))


def prefix_sums(rows: DataFrame, partition: str, order: str, size: str) -> DataFrame:
    """rows with ``start``: the sum of the sizes before each in its partition, within ranges and then over their sums."""
    own = in_ranges(rows, partition, order)
    earlier = Window.partitionBy(partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = own.groupBy(partition, "_part").agg(F.sum(size).alias("_sum")).select(partition, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    before = Window.partitionBy(partition, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = own.withColumn("_inside", F.coalesce(F.sum(size).over(before), F.lit(0))).join(starts, [partition, "_part"])
    return found.withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def bucket_starts(ids: DataFrame, every: int) -> DataFrame:
    """(bucket, start): every ``every``-th id begins a bucket."""
    at = numbered(ids.select("id"), "id").filter(F.col("seq") % every == 0)
    return at.select((F.col("seq") / every).cast("long").alias("bucket"), F.col("id").alias("start"))


def bucket_of(requests: DataFrame, starts: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """requests with the bucket of the greatest start at or below ``key``; null below all.

    An as-of lookup without a theta join: starts and requests are merged in ranges of the key, and each range begins with
    the last start before it.
    """
    place = lambda c: F.floor(F.col(c) / width)
    marks = starts.select(F.col("start").alias("_key"), "bucket", place("start").alias("_range"))
    last = marks.groupBy("_range").agg(F.max("bucket").alias("_last"))
    ranges = requests.select(place(key).alias("_range")).union(marks.select("_range")).distinct().join(last, "_range", "left")  # a row a range
    carried = F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_range", carried.alias("_before"))
    asked = requests.withColumns({"_key": F.col(key), "_range": place(key), "_asks": F.lit(1)})
    merged = asked.unionByName(marks.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("_range").orderBy("_key", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_found", F.last("bucket", ignorenulls=True).over(w)).filter("_asks = 1").drop("bucket")
    return found.join(ranges, "_range", "left").select(*requests.columns, F.coalesce("_found", "_before").alias("bucket"))
