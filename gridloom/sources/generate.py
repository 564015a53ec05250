"""Seeded graphs to test with: columns are drawn by hashes of (seed, id), so Spark makes them in parallel and again alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import position as P


@dataclass(frozen=True)
class Profile:
    """Sizes and shares (in percent) of a graph."""

    nodes: int = 6_000
    ways: int = 1_200
    relations: int = 250
    clusters: int = 6
    radius: int = 30
    clustered: int = 80
    extreme: int = 1
    tagged: int = 30
    most_tags: int = 6
    missing: int = 3
    most_refs: int = 30
    most_members: int = 20
    #: Percent of tag values of other scripts and control characters, and of nodes whose ids stand far from the others'.
    wild: int = 0
    far: int = 0


PROFILES = {
    "mixed": Profile(most_refs=300, wild=5, far=1),
    "dense": Profile(nodes=250_000, ways=30_000, relations=3_000, clusters=2, radius=1, clustered=99, extreme=0, tagged=20, most_tags=4, missing=1),
    "global": Profile(nodes=30_000, ways=6_000, relations=1_500, clusters=1, clustered=0, extreme=5, tagged=20, most_tags=3, missing=2),
    "tags": Profile(nodes=20_000, ways=5_000, relations=1_000, clusters=4, radius=10, clustered=90, tagged=90, most_tags=40, missing=1, wild=20),
    "topology": Profile(nodes=10_000, ways=6_000, relations=8_000, clusters=5, radius=20, clustered=90, missing=15, most_members=60),
    "big": Profile(nodes=1_000_000, ways=160_000, relations=20_000, clusters=60, radius=40, clustered=90, tagged=10, most_refs=500, far=1),
}
#: How far apart ids are made, by a power of two; and texts that tags may have.
FAR = 1 << 36
WILD = ("é", "名前", "😀 x", "a\"b<c>&'", "tab\there", "line\nbreak", "", "\u0301", "нет", "x" * 300)
EXTREMES = ((900_000_000, 1_800_000_000), (-900_000_000, -1_800_000_000), (0, 1_800_000_000), (0, 0), (900_000_001, 0), (-900_000_000, 1_799_999_999))


class Draw:
    """Numbers below a bound by a hash of the seed, a purpose and columns."""

    def __init__(self, seed: int):
        self.seed = seed

    def __call__(self, purpose: str, bound: int, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(purpose), *columns), F.lit(bound))

    def tags(self, p: Profile, kind: str, key: Column) -> Column:
        n = F.when(self(f"{kind} tagged", 100, key) < p.tagged, self(f"{kind} tags", p.most_tags, key) + 1).otherwise(0)
        tag = lambda i: F.struct(F.concat(F.lit("k"), self("key", 12, key, i).cast("string")).alias("k"), F.when(self("wild", 100, key, i) < p.wild, F.element_at(F.array(*map(F.lit, WILD)), (self("which wild", len(WILD), key, i) + 1).cast("int"))).otherwise(F.concat(F.lit("v"), self("value", 50, key, i).cast("string"))).alias("v"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), tag)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def nodes(spark: SparkSession, p: Profile, seed: int) -> DataFrame:
    """(id, lat, lon, tags); some ids below p.nodes are left out, so that what refers to them misses them."""
    draw, key = Draw(seed), F.col("id")
    cluster = draw("cluster", p.clusters, key)
    around = lambda axis, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), cluster), F.lit(2 * most)) - most + (draw(axis + " offset", 2 * p.radius + 1, key) - p.radius) * 65_536 + draw(axis + " low", 65_536, key)
    anywhere = lambda axis, most: draw(axis + " anywhere", 2 * most + 1, key) - most
    extreme = lambda at: F.element_at(F.array(*(F.lit(e[at]) for e in EXTREMES)), (draw("which extreme", len(EXTREMES), key) + 1).cast("int")).cast("long")
    share = draw("share", 100, key)
    place = lambda axis, most, at: F.when(share < p.extreme, extreme(at)).when(share < p.extreme + p.clustered, around(axis, most)).otherwise(anywhere(axis, most)).cast("long")
    own = spark.range(1, p.nodes + 1).filter(draw("missing", 100, key) >= p.missing)
    far = F.when(draw("far", 100, key) < p.far, key + (draw("how far", 50, key) + 1) * FAR).otherwise(key)  # what refers to these misses them
    return own.select(far.alias("id"), place("lat", P.MAX_LAT, 0).alias("lat"), place("lon", P.MAX_LON, 1).alias("lon"), draw.tags(p, "node", key).alias("tags"))


def ways(spark: SparkSession, p: Profile, seed: int) -> DataFrame:
    """(id, refs, tags): runs of nearby ids."""
    draw, key = Draw(seed), F.col("id")
    n, start = draw("refs", p.most_refs, key) + 1, draw("start", p.nodes, key)
    refs = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.pmod(start + i * (draw("step", 3, key) + 1), F.lit(p.nodes)) + 1)
    return spark.range(1, p.ways + 1).select("id", refs.alias("refs"), draw.tags(p, "way", key).alias("tags"))


def relations(spark: SparkSession, p: Profile, seed: int) -> DataFrame:
    """(id, members, tags): about 40 nodes, 45 ways and 15 relations in a hundred members; cycles occur."""
    draw, key = Draw(seed), F.col("id")
    n = draw("members", p.most_members, key)

    def member(i: Column) -> Column:
        share = draw("kind", 100, key, i)
        kind = F.when(share < 40, 1).when(share < 85, 2).otherwise(3)
        ref = F.when(share < 40, draw("node", p.nodes, key, i)).when(share < 85, draw("way", p.ways, key, i)).otherwise(draw("relation", p.relations, key, i)) + 1
        role = F.element_at(F.array(*map(F.lit, ("", "outer", "inner", "stop"))), (draw("role", 4, key, i) + 1).cast("int"))
        return F.struct(kind.alias("kind"), ref.alias("ref"), role.alias("role"))

    empty = F.array().cast("array<struct<kind:int,ref:bigint,role:string>>")
    members = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), member)).otherwise(empty)
    return spark.range(1, p.relations + 1).select("id", members.alias("members"), draw.tags(p, "relation", key).alias("tags"))
