"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Every node u joins its neighbours v to the least m of u and its neighbours: those over u, or for small stars u itself and those under u."""
    if small:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        joined = around.join(least, "u")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long, not null); root is the least node that links reach.

    Each round is written to the shared folder. Rounds end when one changes nothing, after a number of them that grows with
    the logarithm of the longest chain. A node of any number of links is joined in parts by adaptive skew joins; the
    minimum is taken before the shuffle.
    """
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _state(links)
    while before[0]:
        links = stored(_stars(_stars(links, small=False), small=True), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
