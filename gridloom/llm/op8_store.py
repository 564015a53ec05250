"""A content-addressed store of token ids.

Rolling hashes over the ids cut each document's stream into chunks, so that passages which documents share give equal
chunks wherever they stand. A chunk is stored once, under the digest of its bytes. Files of a store, all Parquet:

``chunks``    digest, n_ids, data: ids as little-endian unsigned integers of ``width`` bytes
``recipes``   kind=recipe: a row for each document in ascending doc_id order, over parts that are ordered too: its chunks,
              its number of ids, those before it in its part; kind=manifest: a row for each part with its sums and the
              root of a Merkle tree whose leaves are the part's documents
``root``      one row: the root over all parts, and the format
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lookup_join, shared_path, small_batches, table
from gridloom.llm.parts import read_parts, stored_parts, write_parts
from gridloom.llm.tokens import encoder, vocabulary

END_ID, VOCABULARY = 1, "word_bpe_49k.json"
#: Encoded pieces that a worker keeps: this tokenizer's words take longest to encode.
PIECES_KEPT = 2_000_000
#: Ids in a chunk: at least (but for a document's last), about, and at most.
LEAST, ABOUT, MOST = 64, 256, 1024
#: Ids that the rolling hash sees.
SEEN = 8
DIGEST_BYTES = 16
CHUNK_ROWS = "digest binary, n_ids int, data binary, doc_id long, n_tokens long, digests array<binary>, lengths array<int>"
RECIPES = "part int, ordinal long, doc_id long, n_tokens long, before long, digests array<binary>, lengths array<int>, n_docs long, root binary"


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash would cut, ascending."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(ids), dtype=np.uint64)
    for back in range(min(SEEN, len(ids))):
        rolled[back:] += mixed[: len(ids) - back] << np.uint64(7 * back)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(rolled >> np.uint64(32) < np.uint64((1 << 32) // ABOUT)) + 1


def cuts(start: int, end: int, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks of a document at [start, end) of a stream that has these candidates."""
    out, at = [], start
    places = candidates[np.searchsorted(candidates, start + LEAST) : np.searchsorted(candidates, end)].tolist()
    for place in [*places, end]:
        while place - at > MOST:
            at += MOST
            out.append(at)
        if place == end or place - at >= LEAST:
            if place > at:
                out.append(place)
            at = place
    return out


def _chunks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path, PIECES_KEPT)
    end = int(end_id).to_bytes(4, "little")
    width = width_of(path)
    sent: set[bytes] = set()
    for batch in small_batches(batches, "text"):
        blobs = [x + end for x in own.encode([t or "" for t in batch.column("text").to_pylist()])]
        ids = np.frombuffer(b"".join(blobs), dtype="<u4")
        data = ids.astype(f"<u{width}").tobytes()
        candidates = boundaries(ids)
        fresh, recipes, at = [], [], 0
        for blob in blobs:
            digests, lengths, begin = [], [], at
            for stop in cuts(at, at + len(blob) // 4, candidates):
                part = data[begin * width : stop * width]
                digests.append(digest_of(part))
                lengths.append(stop - begin)
                if digests[-1] not in sent:
                    sent.add(digests[-1])
                    fresh.append((digests[-1], stop - begin, part))
                begin = stop
            at += len(blob) // 4
            recipes.append((digests, lengths))
        if len(sent) > 1_000_000:
            sent.clear()
        f, r = len(fresh), len(recipes)
        cols = list(zip(*fresh, strict=True)) or [(), (), ()]
        doc_ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*cols[0], *[None] * r], pa.binary()),
                pa.array([*cols[1], *[None] * r], pa.int32()),
                pa.array([*cols[2], *[None] * r], pa.binary()),
                pa.concat_arrays([pa.nulls(f, pa.int64()), doc_ids]),
                pa.array([*[None] * f, *(sum(x[1]) for x in recipes)], pa.int64()),
                pa.array([*[None] * f, *(x[0] for x in recipes)], pa.list_(pa.binary())),
                pa.array([*[None] * f, *(x[1] for x in recipes)], pa.list_(pa.int32())),
            ],
            ["digest", "n_ids", "data", "doc_id", "n_tokens", "digests", "lengths"],
        )


def _raw(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """Binary values one after the other, and where each begins; at last where they end."""
    if not len(values):
        return b"", np.zeros(1, dtype=np.int32)
    own = values.cast(pa.binary())
    at = np.frombuffer(own.buffers()[1], dtype="<i4")[own.offset : own.offset + len(own) + 1]
    return (own.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])].to_pybytes(), at - at[0]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of documents, and of chunks. Drops repeated chunks: equal ones come to one task, one after the other, after all rows without a digest."""
    last = None
    for batch in batches:
        n = batch.column("digest").null_count
        yield "document", batch.slice(0, n)
        if n < batch.num_rows:
            own = batch.slice(n)
            raw, _ = _raw(own.column("digest"))
            halves = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
            keep = np.concatenate([[raw[:DIGEST_BYTES] != last], (halves[1:] != halves[:-1]).any(axis=1)])
            last = raw[-DIGEST_BYTES:]
            yield "chunk", own if keep.all() else own.filter(pa.array(keep))


class _Merkle:
    """Root of a binary Merkle tree of leaves that come one by one; an odd node goes up as it is."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node, level = digest_of(b"\0" + leaf), 0
        while self.stack and self.stack[-1][0] == level:
            node, level = digest_of(b"\1" + self.stack.pop()[1] + node), level + 1
        self.stack.append((level, node))

    def root(self) -> bytes:
        node = b""
        for _, left in reversed(self.stack):
            node = digest_of(b"\1" + left + node) if node else left
        return node


def _leaf(doc_id: int | None, n_tokens: int, digests: bytes) -> bytes:
    return f"{doc_id},{n_tokens},".encode() + digests


def _leaves(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Leaves of recipes."""
    digests = batch.column("digests")
    raw, at = _raw(digests.flatten())
    ends = at[np.cumsum(pc.list_value_length(digests).to_numpy(zero_copy_only=False))].tolist()
    for doc_id, n, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), [0, *ends], ends, strict=False):
        yield _leaf(doc_id, n, raw[a:b])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    tree, ordinal, before = _Merkle(), 0, 0
    names = ["part", "ordinal", "doc_id", "n_tokens", "before", "digests", "lengths", "n_docs", "root"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        for leaf in _leaves(batch):
            tree.add(leaf)
        ends = before + np.cumsum(batch.column("n_tokens").to_numpy())
        cols = [pa.repeat(pa.scalar(part, pa.int32()), n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id"), batch.column("n_tokens"), pa.array(np.concatenate([[before], ends[:-1]])), batch.column("digests"), batch.column("lengths"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        yield "recipe", pa.RecordBatch.from_arrays(cols, names)
        ordinal, before = ordinal + n, int(ends[-1])
    if ordinal:
        yield "manifest", pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, None, None, before, None, None, None, ordinal, tree.root()), types, strict=True)], names)


def width_of(path: str) -> int:
    return 2 if encoder(path, PIECES_KEPT).tokenizer.get_vocab_size() <= 1 << 16 else 4


def write_store(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise ``docs`` and write a store to the folder ``out``, which executors must share."""
    spark = docs.sparkSession
    path = path or vocabulary(VOCABULARY)
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    cut = own.mapInArrow(partial(_chunks, path=path, end_id=end_id), CHUNK_ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "n_tokens", "digests"))
    write_parts(cut.withColumn("owner", owner).repartition(parts, "owner").drop("owner").sortWithinPartitions("digest"), _once, CHUNK_ROWS, f"{out}/chunks")
    made = read_parts(spark, CHUNK_ROWS, f"{out}/chunks").filter("kind = 'document'")
    # without a number, small ranges that adjoin are read by one task
    ordered = made.select("doc_id", "n_tokens", "digests", "lengths").repartitionByRange("doc_id", "n_tokens", "digests").sortWithinPartitions("doc_id", "n_tokens", "digests")
    write_parts(ordered, _recipes, RECIPES, f"{out}/recipes")
    tree = _Merkle()
    for row in manifests(spark, out).orderBy("part").toLocalIterator():  # a row for each part
        tree.add(bytes(row["root"]))
    spark.createDataFrame([(tree.root(), width_of(path), "ids-1")], "root binary, width int, format string").coalesce(1).write.parquet(f"{out}/root")


def chunks(spark: SparkSession, out: str) -> DataFrame:
    return read_parts(spark, CHUNK_ROWS, f"{out}/chunks").filter("kind = 'chunk'").select("digest", "n_ids", "data")


def recipes(spark: SparkSession, out: str) -> DataFrame:
    return read_parts(spark, RECIPES, f"{out}/recipes").filter("kind = 'recipe'").drop("kind", "n_docs", "root")


def manifests(spark: SparkSession, out: str) -> DataFrame:
    return read_parts(spark, RECIPES, f"{out}/recipes").filter("kind = 'manifest'").select("part", "n_docs", "n_tokens", "root")


def verify(spark: SparkSession, out: str) -> bool:
    """Whether recipes give the sums and roots of their parts, and these the root of the store. Chunks are held against their digests on every read."""
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, _Merkle] = {}
        sums: dict[int, list[int]] = {}
        broken: set[int] = set()
        for batch in batches:
            for leaf, part, n, before in zip(_leaves(batch), *(batch.column(c).to_pylist() for c in ("part", "n_tokens", "before")), strict=True):
                trees.setdefault(part, _Merkle()).add(leaf)
                own = sums.setdefault(part, [0, 0])
                if before != own[1]:
                    broken.add(part)
                own[0], own[1] = own[0] + 1, own[1] + n
        found = [None if k in broken else t.root() for k, t in trees.items()]
        n_docs, n_tokens = ([x[i] for x in sums.values()] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(trees), pa.int32()), pa.array(n_docs, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(found, pa.binary())], ["part", "docs", "tokens", "found"])

    rows = recipes(spark, out)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "part").sortWithinPartitions("part", "ordinal").mapInArrow(roots, "part int, docs long, tokens long, found binary")
    if not manifests(spark, out).join(found, "part", "full").filter("not (root <=> found and n_docs <=> docs and n_tokens <=> tokens)").isEmpty():
        return False
    tree = _Merkle()
    for row in manifests(spark, out).orderBy("part").toLocalIterator():
        tree.add(bytes(row["root"]))
    return tree.root() == bytes(spark.read.parquet(f"{out}/root").head()["root"])


def _checked(batches: Iterator[pa.RecordBatch], width: int, full: bool) -> Iterator[pa.RecordBatch]:
    """The crc of each chunk's ids as 32-bit integers; raises if its bytes aren't those of its digest."""
    for batch in batches:
        sums, wide = [], []
        raw, at = _raw(batch.column("data"))
        if not np.array_equal(np.diff(at), batch.column("n_ids").to_numpy() * width):
            raise ValueError("a chunk differs from its digest")
        ids, data, ends = memoryview(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()), memoryview(raw), at.tolist()
        for digest, begin, end in zip(batch.column("digest").to_pylist(), ends[:-1], ends[1:], strict=True):
            if digest_of(data[begin:end]) != digest:
                raise ValueError("a chunk differs from its digest")
            own = ids[4 * begin // width : 4 * end // width]
            sums.append(zlib.crc32(own))
            if full:
                wide.append(bytes(own))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_ids"), pa.array(sums, pa.int64()), *([pa.array(wide, pa.binary())] if full else [])], ["digest", "n_ids", "crc", *["ids"] * full])


#: Fixed value: the polynomial of crc32, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of crc32."""
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return out


def followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part with this crc adds (by xor) to the crc of a whole in which so many bytes follow it."""
    crc = crc.astype(np.uint32)
    power = np.full(len(crc), 1 << 31, dtype=np.uint32)
    square, left = np.array([1 << 23], dtype=np.uint32), n_bytes.astype(np.int64)  # the power for one byte
    while left.any():
        odd = np.flatnonzero(left & 1)
        power[odd] = _times(power[odd], square)
        square = _times(square, square)
        left = left >> 1
    return _times(power, crc)


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column("crc").null_count:
            raise ValueError("a chunk is missing")
        if not batch.column("length").equals(batch.column("n_ids")):
            raise ValueError("a chunk hasn't the length that a recipe gives")
        crc, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after"))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ordinal"), pa.array(followed_by(crc, 4 * after).astype(np.int64))], ["part", "ordinal", "share"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to rows of their chunks, with running sums of the lengths."""
    for batch in batches:
        digests, lengths = batch.column("digests"), batch.column("lengths")
        size = pc.list_value_length(lengths).to_numpy(zero_copy_only=False)
        if not np.array_equal(size, pc.list_value_length(digests).to_numpy(zero_copy_only=False)):
            raise ValueError("a recipe has more or fewer lengths than digests")
        flat, owner = lengths.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
        sums, first = np.concatenate([[0], np.cumsum(flat)]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        whole = sums[first[1:]] - sums[first[:-1]]
        if not np.array_equal(whole, batch.column("n_tokens").to_numpy()):
            raise ValueError("the lengths of a recipe differ from its sum")
        after = sums[first[1:]][owner] - sums[1:]
        pos = np.arange(len(flat)) - first[:-1][owner]
        yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(owner)), batch.column("ordinal").take(pa.array(owner)), pa.array(pos.astype(np.int32)), digests.flatten(), lengths.flatten(), pa.array(after)], ["part", "ordinal", "pos", "digest", "length", "after"])


#: Chunks of documents, and the ids that follow each in its document.
REFERENCES = "part int, ordinal long, pos int, digest binary, length int, after long"


def _held(spark: SparkSession, out: str) -> DataFrame:
    """What ``_listed`` takes, which raises if a recipe's lengths aren't those of its document."""
    return recipes(spark, out).select("part", "ordinal", "n_tokens", "digests", "lengths")


def read_sums(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a store; raises if a chunk is missing or isn't as long as a recipe says."""
    width = spark.read.parquet(f"{out}/root").head()["width"]
    sums = chunks(spark, out).mapInArrow(partial(_checked, width=width, full=False), "digest binary, n_ids int, crc long")
    references, total = stored_parts(_held(spark, out), REFERENCES, "references", _listed)
    uses = references.groupBy("digest").agg(F.count(F.lit(1)).alias("uses"))
    known, _ = stored_parts(uses.join(sums, "digest", "left").select("digest", "uses", "n_ids", "crc"), "digest binary, uses long, n_ids int, crc long", "sums")
    shares = lookup_join(references, known, "digest", "uses", total).select("part", "ordinal", "length", "n_ids", "crc", "after").mapInArrow(_shifted, "part int, ordinal long, share long")
    whole = shares.groupBy("part", "ordinal").agg(F.bit_xor("share").alias("ids_crc32"))
    starts = manifests(spark, out).select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))  # a row for each part
    return recipes(spark, out).select("part", "ordinal", "doc_id", "n_tokens", "before").join(whole, ["part", "ordinal"]).join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id and ids (array) of each document, put together from its chunks."""
    width = spark.read.parquet(f"{out}/root").head()["width"]
    wide = chunks(spark, out).mapInArrow(partial(_checked, width=width, full=True), "digest binary, n_ids int, crc long, ids binary")
    joined = _held(spark, out).mapInArrow(_listed, REFERENCES).join(wide, "digest", "left")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(x["ids"] is None or x["length"] != x["n_ids"] for own in batch.column("own").to_pylist() for x in own):
                raise ValueError("a chunk is missing, or hasn't the length that a recipe gives")
            ids = [np.frombuffer(b"".join(x["ids"] for x in own), dtype="<u4").tolist() for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ordinal"), pa.array(ids, pa.list_(pa.int64()))], ["part", "ordinal", "ids"])

    own = joined.groupBy("part", "ordinal").agg(F.array_sort(F.collect_list(F.struct("pos", "length", "n_ids", "ids"))).alias("own")).mapInArrow(whole, "part int, ordinal long, ids array<long>")
    return recipes(spark, out).select("part", "ordinal", "doc_id").join(own, ["part", "ordinal"]).select("doc_id", "ids")


def store_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32, a row per row of ``docs``.

    Null and empty texts are stored as the end id alone. Rows with a null doc_id come first, repeated ids follow each other by
    length and content, and each keeps its own range. Texts are tokenised whole. Other columns, whatever their names,
    are not read. An empty table gives a store without documents and an empty result. Raises if the recipes don't give the roots.
    """
    out = shared_path(docs.sparkSession, "store")
    write_store(docs, out, path, end_id)
    if not verify(docs.sparkSession, out):
        raise ValueError("the recipes of the store differ from its roots")
    return read_sums(docs.sparkSession, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))
