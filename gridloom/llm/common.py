"""Pieces that several corpus operators share: tables, shared storage, skew-safe joins."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.storage import shared_dir

#: A key that holds more than this share of the rows is joined by broadcast, so at most 1000 keys can be.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join of ``left`` (many rows a key) with ``right`` (one row a key) on ``key``, with no hot task.

    Column ``rows`` of ``right`` says how many rows of ``left`` have the key; ``total`` is the sum. Keys with more than
    1/HOT_SHARE of all rows number fewer than HOT_SHARE, so their rows of ``right`` are broadcast; the others are
    shuffled, and none of them holds more than that share. Both sides are read twice and should be stored.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(rows) > limit))
    cold = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(rows) <= limit), key)
    return cold.unionByName(left.join(hot, key))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each, at least one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back to the system; nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda keep: 0


def releasing(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``step`` of mapInArrow, at whose end the worker gives freed memory back.

    Workers outlive their tasks and serve those of later stages, and allocators keep what was freed; so a worker would hold the most that
    any of its tasks took.
    """

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch], *args, **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches, *args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


def sample_by(rows: DataFrame, label: str, each: int, labels: int, in_all: int | None = None) -> DataFrame | None:
    """About ``each`` rows of every label, or its even share of ``in_all`` if that is less, by a threshold on a hash of doc_id; None if there are no rows.

    Raises if there are more than ``labels`` labels, so that the sample is bounded by their product.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(labels + 1).collect()}
    if len(counts) > labels:
        raise ValueError(f"more than {labels} labels")
    if not counts:
        return None
    if in_all is not None:
        each = min(each, max(in_all // len(counts), 1))
    scale = 1 << 20
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(scale, -(-scale * each // n)))))
    return rows.filter(F.expr(f"pmod(xxhash64(doc_id, 'sample'), {scale})") < F.element_at(share, F.col(label)))


def gather(rows: DataFrame, column: str, most: int, most_bytes: int) -> list:
    """Distinct rows for the driver: the first ``most`` by a hash of the whole row, of at most ``most_bytes`` bytes of ``column`` in all (but one row at least).

    Which these are depends on the rows alone. Rows are written to the shared folder; sizes are looked at before rows are sent.
    """
    held = stored(rows.distinct().withColumn("_order", F.xxhash64(*rows.columns)), "sample")
    total, last = 0, None
    for r in held.select("_order", F.octet_length(column).alias("n")).orderBy("_order").limit(most).collect():
        total += r["n"]
        if last is not None and total > most_bytes:
            break
        last = r["_order"]
    return [] if last is None else held.filter(F.col("_order") <= last).orderBy("_order").limit(most).drop("_order").collect()
