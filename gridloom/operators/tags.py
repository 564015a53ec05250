"""Inverted indexes over tags, and dictionaries by first appearance.

Tags come as (id, idx, pos, k, v): an element, its extent index, and where the tag stands among its tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import position as P
from gridloom.operators.shards import ranked


def exploded(elements: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tags of elements (id, tags) whose indexes are (id, idx)."""
    return elements.join(indexes, "id").select("id", "idx", F.posexplode("tags").alias("pos", "t")).select("id", "idx", F.col("pos").cast("long").alias("pos"), "t.k", "t.v")


def local_postings(tags: DataFrame) -> DataFrame:
    """(region, k, v, id), each once."""
    return tags.select(F.shiftright(P.coarse(F.col("idx")), 8).alias("region"), "k", "v", "id").distinct()


def global_postings(tags: DataFrame) -> DataFrame:
    """(k, v, region, id), each once; the order of a list is by region, then id."""
    return local_postings(tags).select("k", "v", "region", "id")


def posting_lists(postings: DataFrame, *keys: str) -> DataFrame:
    """One row a key with its sorted postings. Lists of common keys grow with the input: only for selected keys."""
    return postings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region", "id"))).alias("postings"))


def pair_rank(tags: DataFrame) -> DataFrame:
    """(k, v, rank): distinct pairs in byte order from 1, ranked within ranges."""
    return ranked(tags.select("k", "v").distinct(), "k", "v").select("k", "v", (F.col("seq") + 1).cast("long").alias("rank"))


def dictionary(words: DataFrame, word: str, *order: str) -> DataFrame:
    """(word, word_id): distinct words numbered from 0 by first appearance in ``order``, within ranges of it."""
    first = words.groupBy(word).agg(F.min(F.struct(*order)).alias("at"))
    return ranked(first, "at").select(word, F.col("seq").cast("long").alias(f"{word}_id"))


def object_bytes(postings: DataFrame, id_bytes: int) -> DataFrame:
    """Bytes that the objects of local (the id) and global postings (3 more) take."""
    n = F.count(F.lit(1))
    return postings.agg((n * id_bytes).alias("local_bytes"), (n * (id_bytes + 3)).alias("global_bytes"))


def split_keys(postings: DataFrame, id_bytes: int, block: int) -> DataFrame:
    """Global keys whose objects take more than one block, with how many blocks the packer makes of them: each begins with the key and holds whole objects."""
    sizes = postings.groupBy("k", "v").agg((F.count(F.lit(1)) * (id_bytes + 3)).alias("bytes"))
    room = F.lit(block) - 8 - (8 + F.octet_length("k") + F.octet_length("v"))
    each = F.floor(room / (id_bytes + 3))
    large = F.col("bytes") + 12 + F.octet_length("k") + F.octet_length("v") >= block - 4
    return sizes.withColumn("blocks", F.when(large, F.ceil(F.col("bytes") / (id_bytes + 3) / each)).otherwise(1).cast("long")).select("k", "v", "bytes", "blocks").filter("blocks > 1")
