"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Bins are filled one at a time: greedily with the longest piece that fits, then the smallest piece of the bin is
replaced by the two unpacked pieces that fill the gap it leaves most tightly, if they fill it better. What a bin gets
depends only on how many pieces of each length are left, so the whole corpus is packed from its histogram of lengths
(at most ``capacity`` entries): a bin that can be filled in the same way again is repeated as often as the counts
allow. The plan says which ranks within a length go where; ranks are counted in parallel.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import releasing, small_batches, stored, table
from gridloom.llm.tokens import encoder, vocabulary

CAPACITY, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
#: About so many pieces share a counter of ranks.
PIECES_A_BUCKET = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@releasing
def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = int(end_id).to_bytes(4, "little")
    for batch in small_batches(batches, "text"):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
            ids += end
            n = len(ids) // 4
            at, upto = 0, n - (n - 1) // capacity * capacity
            piece = 0
            while at < n:
                rows.append((doc_id, piece, at, upto - at, zlib.crc32(memoryview(ids)[4 * at : 4 * upto])))
                at, upto, piece = upto, upto + capacity, piece + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: whole, or if it is longer than ``capacity``, a shorter first piece and full ones."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(partial(_cut, path=path, end_id=end_id, capacity=capacity), PIECES)


class _Stock:
    """How many pieces of each length are left; ``find(x)``: the longest length up to x of which some are."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.below = [i if self.left[i] else -1 for i in range(capacity + 1)]

    def find(self, x: int) -> int:
        """0 if there is none."""
        trail = []
        while x > 0 and not self.left[x]:
            trail.append(x)
            x = min(x - 1, self.below[x]) if self.below[x] >= 0 else x - 1
        for y in trail:
            self.below[y] = max(x, 0)
        return max(x, 0)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces in each bin), longest first]) of each way in which bins are filled."""
    stock = _Stock(counts, capacity)
    out = []
    while (longest := stock.find(capacity)) > 0:
        used: Counter[int] = Counter()
        gap, x = capacity, longest
        while x > 0 and gap > 0:
            n = min(stock.left[x] - used[x], gap // x)
            if n:
                used[x] += n
                gap -= n * x
            x = stock.find(min(gap, x - 1))
        final = used.copy()
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            best, pair = smallest, None
            room = gap + smallest
            spare = lambda y: stock.left[y] - used[y]
            a = stock.find(room - 1)
            while a > 0 and 2 * a > best:
                if spare(a) > 0:
                    b = stock.find(min(a, room - a))
                    while b > 0 and a + b > best and spare(b) - (b == a) <= 0:
                        b = stock.find(b - 1)
                    if b > 0 and a + b > best:
                        best, pair = a + b, (a, b)
                        if best == room:
                            break
                a = stock.find(a - 1)
            if pair:
                final[smallest] -= 1
                final.update(pair)
        final = +final
        times = 1 + min((stock.left[y] - max(n, used[y])) // n for y, n in final.items())
        for y, n in final.items():
            stock.left[y] -= n * times
        out.append((times, sorted(final.items(), reverse=True)))
    return out


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces in each bin, first sequence, offset in it), by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for times, content in bins:
        offset = 0
        for length, n in content:
            found.setdefault(length, []).append((ranks[length], n, sequence, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


@releasing
def _place(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    where = held.value
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            table_ = where[n]
            first, each, base, at = table_[np.searchsorted(table_[:, 0], rank[own], side="right") - 1].T
            past = rank[own] - first
            sequence[own] = base + past // each
            offset[own] = at + past % each * n
        keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (columns as of ``token_pieces``)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    buckets = max(64, sum(histogram.values()) // PIECES_A_BUCKET)
    dealt = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {buckets})"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(inside)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    held = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # its size depends on the capacity only
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_place, held=held), PIECES + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Documents tokenised, ended with ``end_id``, cut where longer than ``capacity`` and packed; a row for each piece.

    Null and empty texts are one piece that is the end id alone. A null doc_id stays null. Repeated rows and repeated
    ids are packed once for each row; equal pieces take consecutive ranks, and which of them comes first doesn't show.
    Other columns, whatever their names, are not read. An empty table gives an empty one. Texts are tokenised whole.
    """
    return pack(stored(token_pieces(docs, path or vocabulary(VOCABULARY), end_id, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
