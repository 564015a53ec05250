"""Differences between datasets and between files of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.shards import in_ranges


def dataset_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison by key: outcome is ``only first``, ``only second``, ``different`` or ``identical``. Compares whole rows."""
    rest = [c for c in a.columns if c not in key]
    left = a.select(*key, F.struct(*rest).alias("left"), F.lit(True).alias("in_a"))
    right = b.select(*key, F.struct(*rest).alias("right"), F.lit(True).alias("in_b"))
    same = F.col("left").eqNullSafe(F.col("right"))
    outcome = F.when(F.col("in_b").isNull(), "only first").when(F.col("in_a").isNull(), "only second").when(same, "identical").otherwise("different")
    return left.join(right, key, "full_outer").select(*key, outcome.alias("outcome"))


def outcome_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def keyset_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one of two key sets, with ``side``: missing from b, or unexpected in it."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("unexpected")))


def gaps(spans: DataFrame, lengths: DataFrame, file: str = "file") -> DataFrame:
    """Ranges of [0, length) of each file that no span (file, start, end) covers."""
    bounded = spans.select(file, "start", "end").unionByName(lengths.select(file, F.col("length").alias("start"), F.col("length").alias("end")))
    own = in_ranges(bounded, file, "start", "end")
    # the furthest end of earlier ranges, a row a range, then of earlier spans
    earlier = Window.partitionBy(file).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reached = own.groupBy(file, "_part").agg(F.max("end").alias("_end")).select(file, "_part", F.max("_end").over(earlier).alias("_reached"))
    before = Window.partitionBy(file, "_part").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.greatest("_reached", F.max("end").over(before)), F.lit(0))
    return own.join(reached, [file, "_part"]).withColumn("from", covered).filter(F.col("start") > F.col("from")).select(file, F.col("from").alias("gap_start"), F.col("start").alias("gap_end"))


def first_difference(a: DataFrame, b: DataFrame, file: str = "file") -> DataFrame:
    """For each file of chunks (file, offset, data) that both have: the first byte that differs, or null."""
    both = a.select(file, "offset", F.col("data").alias("x")).join(b.select(file, "offset", F.col("data").alias("y")), [file, "offset"], "full_outer")
    n = F.least(F.octet_length("x"), F.octet_length("y"))
    hexes = lambda c, i: F.substring(c, i + 1, F.lit(1))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: ~hexes(F.col("x"), i).eqNullSafe(hexes(F.col("y"), i)))[0]
    differing = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(file, (F.col("offset") + F.coalesce(at, F.lit(0))).alias("byte"))
    return both.select(file).distinct().join(differing.groupBy(file).agg(F.min("byte").alias("first_difference")), file, "left")
