"""Exact duplicates by Patricia tries.

Each input partition folds its own copies in a trie first, so that a group of copies of any size reaches its owner as
one row for each partition. Owners, dealt by length and content hash, insert the whole byte strings into a trie whose
terminals hold the identifier that stays and the counts. An owner whose trie outgrows its memory gives up whole
subtrees: their strings are written to the shared folder, piece by piece, and dealt again, to more owners, in a further round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fresh_name, lookup_join, releasing, small_batches, stored, table
from gridloom.llm.trie import NODE_BYTES, PatriciaTrie

#: Bytes that a task's trie may take, and bytes of text dealt to an owner.
TRIE_BYTES, OWNER_BYTES = 48 << 20, 24 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A class or a part of one: its digest, length, the identifier that stays, its rows, and how many of them have that identifier.
CLASS = "digest binary, n_bytes long, keep_id long, group_size long, keep_rows long"
_CLASS_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _rows(rows: list[tuple], keys: list[bytes | None]) -> pa.RecordBatch:
    names = ["digest", "n_bytes", "keep_id", "group_size", "keep_rows"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _CLASS_TYPES, strict=True)), pa.array(keys, pa.binary())], [*names, "key"])


def merger(largest: bool):
    """Joins two parts of a class; a null identifier stays only if there is no other."""

    def merge(a: tuple, b: tuple) -> tuple:
        if a[0] != b[0]:
            raise ValueError("equal texts with different digests")
        if a[2] == b[2]:
            keep, rows = a[2], a[4] + b[4]
        elif b[2] is None or a[2] is not None and (a[2] > b[2]) == largest:
            keep, rows = a[2], a[4]
        else:
            keep, rows = b[2], b[4]
        return (a[0], a[1], keep, a[3] + b[3], rows)

    return merge


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


@releasing
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 8 << 20):
        digests = [hashlib.sha256(_normal(t)).digest() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "digest"])


@releasing
def _fold(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Copies within a partition; starts a new trie whenever one is full."""
    merge = merger(largest)
    trie = PatriciaTrie(merge)

    def out():
        keys, rows, held = [], [], 0
        for key, value in trie.items():
            keys.append(key)
            rows.append(value)
            held += len(key)
            if held > 4 << 20:
                yield _rows(rows, keys)
                keys, rows, held = [], [], 0
        yield _rows(rows, keys)

    for batch in small_batches(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            key = _normal(text)
            trie.insert(key, (hashlib.sha256(key).digest(), len(key), doc_id, 1, 1))
        if trie.weight > limit:
            yield from out()
            trie = PatriciaTrie(merge)
    yield from out()


@releasing
def _own(batches: Iterator[pa.RecordBatch], largest: bool, limit: int) -> Iterator[pa.RecordBatch]:
    """Classes (key null), and strings of subtrees that were given up (with their key)."""
    trie = PatriciaTrie(merger(largest))

    def turned_away():
        for batch in small_batches(batches, "key"):
            columns = [batch.column(c).to_pylist() for c in ("digest", "n_bytes", "keep_id", "group_size", "keep_rows")]
            for key, *value in zip(batch.column("key").to_pylist(), *columns, strict=True):
                if not trie.insert(key, tuple(value)):
                    yield key, tuple(value)
                elif trie.weight > limit:
                    yield from trie.give_up()

    keys, rows, held = [], [], 0
    for key, value in turned_away():
        keys.append(key)
        rows.append(value)
        held += len(key)
        if held > 4 << 20 or len(keys) > 10_000:
            yield _rows(rows, keys)
            keys, rows, held = [], [], 0
    if rows:
        yield _rows(rows, keys)
    rows, seen = [], set()
    for value in trie.values():
        if value[0] in seen:
            raise ValueError("different texts with one digest")
        seen.add(value[0])
        rows.append(value)
    for i in range(0, len(rows), 10_000):
        yield _rows(rows[i : i + 10_000], [None] * len(rows[i : i + 10_000]))


def classes(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """One row for each distinct normalised text (columns of CLASS).

    A trie takes ``trie_bytes``, or two of the longest text if these are more, so that each round places some strings of
    every owner. Owners are counted by the bytes of the strings and of their nodes.
    """
    spark = docs.sparkSession
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    total, longest = own.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).head()
    parts = own.mapInArrow(partial(_fold, largest=largest, limit=trie_bytes), CLASS + ", key binary")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners, limit, done = max(least, (total or 0) // owner_bytes), max(trie_bytes, 2 * (longest or 0) + 4 * NODE_BYTES), None
    while True:
        dealt = parts.repartition(owners, "n_bytes", "digest")
        found = stored(dealt.mapInArrow(partial(_own, largest=largest, limit=limit), CLASS + ", key binary"), "classes")
        ended = found.filter(F.col("key").isNull()).drop("key")
        done = ended if done is None else done.unionByName(ended)
        parts = found.filter(F.col("key").isNotNull())
        left = parts.agg(F.sum(F.col("n_bytes") + 2 * NODE_BYTES)).head()[0]  # what was given up is dealt by itself
        if left is None:
            return done
        owners = max(least, left // owner_bytes)


def exact_duplicates(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z. Null counts as the empty text. Of equal texts one row stays: that
    with the largest doc_id (or the smallest, if not ``largest``); a null doc_id stays only where its group has no other.
    Of repeated rows with the same doc_id exactly one has ``kept``. Other columns, whatever their names, are not read.
    An empty table gives an empty one. Texts of any length are compared whole.
    """
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    members = stored(own.mapInArrow(_members, "doc_id long, digest binary").withColumn("row_id", F.monotonically_increasing_id()), "members")
    groups = classes(docs, largest, trie_bytes, owner_bytes)
    joined = lookup_join(members, groups, "digest", "group_size", members.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not groups.filter("keep_rows > 1").isEmpty():  # rows with the same identifier and the same text
        first = joined.filter(kept & (F.col("keep_rows") > 1)).groupBy("digest").agg(F.min("row_id").alias("row_id"))
        joined = joined.join(first.select("row_id", F.lit(True).alias("first")), "row_id", "left")
        kept = kept & ((F.col("keep_rows") == 1) | F.col("first").isNotNull())
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of texts that are equal after lower-casing A-Z.

    Null counts as the empty text. That with the largest doc_id stays (or the smallest); of rows with that doc_id in one
    group, one. A null doc_id stays only where its group has no other. Where an identifier belongs to several different
    texts, a row stays if it is the one that its own group keeps. Columns may have any names besides. An empty table
    gives an empty one. Texts of any length are compared whole.
    """
    own_id, own_digest, digest = (fresh_name(docs, n) for n in ("kept_id", "kept_digest", "digest"))
    found = exact_duplicates(docs, largest).filter("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest))
    normal = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = docs.withColumn(digest, F.sha2(normal, 256)).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_digest)), "left_semi")
    return (kept.dropDuplicates(["doc_id", digest]) if _repeats(docs) else kept).drop(digest)


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
