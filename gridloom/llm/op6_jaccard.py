"""Documents whose sets of word shingles have a Jaccard similarity of 0.75 or more, and the groups that such links make.

1. Texts are hashed to sets, in chunks of documents. A chunk sends its hashes to buckets by their leading bits, packed.
2. A bucket counts in how many documents each of its hashes occurs, and answers each chunk with those that others have too.
3. A chunk hands the answers to its documents. A document of which fewer than 75 % of the set is shared can't link. Of
   the others, those with equal sets are one class; the rarest shared hashes of a class are its prefix, such that similar
   classes share one.
4. The classes of each prefix hash are its list. In rounds, every class of a list is held against a few of the list; what links
   joins groups. Lists that then still hold several groups give the pairs between these that sizes and ranks allow.
5. What a class is held against is divided into blocks; a block's sets that overlap enough are found by DivideSkip.

Nothing is dropped: pairs that aren't compared are in one group already, or can't be similar. Blocks bound what a task holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fresh_name, lookup_join, releasing, small_batches, stored, table
from gridloom.llm.components import components
from gridloom.llm.divideskip import least_overlap, search
from gridloom.llm.shingles import HASH_BITS, WORDS, shingle_sets

PERCENT = 75
#: Hashes in a chunk and in a block, about; a hash that more documents of a chunk have is sent without their numbers.
CHUNK, BLOCK, OFTEN = 700_000, 1 << 14, 64
#: Entries of a list that the others are held against in a round; so many pairs for each entry are compared without a further round.
PIVOTS, FEW = 4, 1
#: Bytes of text for each bucket, and buckets at most.
BUCKET_BYTES, BUCKETS = 4 << 20, 1 << 12
PACKED = "chunk long, bucket int, n int, data binary, numbers binary, counts binary"
NUMBER = "<u4"
#: Marks an answer that holds for every document of the chunk that has the hash.
ALL = 0xFFFFFFFF


def _zip(x: np.ndarray) -> bytes:
    """Bytes of integers, plane by plane: in sorted differences and small numbers the upper ones are nearly constant."""
    width = x.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unzip(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1).T.tobytes(), dtype=dtype)


def _packed(chunk: int, bucket: int, hashes: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple:
    """Hashes are ascending."""
    return (chunk, bucket, len(hashes), _zip(np.diff(hashes, prepend=np.uint64(0)).astype("<u8")), _zip(numbers.astype(NUMBER)), _zip(counts.astype(NUMBER)))


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unzip(row[3], "<u8"), dtype=np.uint64), _unzip(row[4], NUMBER), _unzip(row[5], NUMBER)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk", "bucket", "n", "data", "numbers", "counts"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "n", "data", "numbers", "counts")), strict=True)


#: A chunk's documents: -1 as the bucket, and these arrays instead of hashes.
DOCUMENTS = -1


def _chunk_rows(chunk: int, doc_ids: list, sets: list[np.ndarray], bits: int) -> Iterator[tuple]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(hashes)))
    often = counts > OFTEN
    kept = ~np.repeat(often, counts)
    # documents with a hash that many of the chunk have stay here, under the hash
    held = (hashes[~kept], owner[~kept])
    all_hashes = np.concatenate([hashes[kept], hashes[first[often]]])
    all_numbers = np.concatenate([owner[kept], np.full(often.sum(), ALL)])
    all_counts = np.concatenate([np.ones(kept.sum(), dtype=np.int64), counts[often]])
    order = np.argsort(all_hashes, kind="stable")
    all_hashes, all_numbers, all_counts = all_hashes[order], all_numbers[order], all_counts[order]
    ends = np.searchsorted(all_hashes, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - bits))
    begin = 0
    for bucket, end in enumerate(ends.tolist()):
        if end > begin:
            yield _packed(chunk, bucket, all_hashes[begin:end], all_numbers[begin:end], all_counts[begin:end])
        begin = end
    digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    nulls = np.array([d is None for d in doc_ids])
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    yield (chunk, DOCUMENTS, len(sets), ids.tobytes() + nulls.astype(np.uint8).tobytes() + digests, _zip(sizes.astype(NUMBER)), b"")
    yield (chunk, DOCUMENTS - 1, len(held[0]), *_packed(chunk, 0, *held, np.zeros(0))[3:])


@releasing
def _hash(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    base, ordinal = TaskContext.get().partitionId() << 24, 0
    doc_ids, sets, held = [], [], 0

    def out():
        rows, size = [], 0
        for row in _chunk_rows(base + ordinal, doc_ids, sets, bits):
            rows.append(row)
            size += len(row[3])
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    for batch in small_batches(batches, "text", 1 << 20):
        doc_ids += batch.column("doc_id").to_pylist()
        sets += shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], words)
        held += sum(len(s) for s in sets[-batch.num_rows :])
        if held > CHUNK:
            yield from out()
            ordinal += 1
            doc_ids, sets, held = [], [], 0
    if doc_ids:
        yield from out()


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows in runs of one chunk or bucket."""
    at, held = None, []
    for batch in batches:
        for row in _rows(batch):
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


@releasing
def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket and chunk, the hashes that occur in more than one document, with the number of those. Rows of documents pass."""
    for bucket, rows in _grouped(batches, 1):
        if bucket < 0:
            for i in range(0, len(rows), 16):
                yield _batch(rows[i : i + 16])
            continue
        parts = [_unpacked(r) for r in rows]
        hashes, numbers, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        chunk = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
        order = np.argsort(hashes, kind="stable")  # within a hash, chunks stay in order
        hashes, numbers, counts, chunk = hashes[order], numbers[order], counts[order], chunk[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), first)
        total = np.repeat(total, np.diff(np.append(first, len(hashes))))
        shared = np.flatnonzero(total > 1)
        shared = shared[np.argsort(chunk[shared], kind="stable")]
        ends = np.searchsorted(chunk[shared], np.arange(len(rows) + 1))
        out, size = [], 0
        for row, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b > a:
                own = shared[a:b]
                out.append(_packed(row[0], bucket, hashes[own], numbers[own], np.minimum(total[own], ALL)))
                size += len(out[-1][3])
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)


#: ``members``: shared hashes by value; ``prefix``: the rarest of them, one of which any similar set has in its own.
SETS = "doc_id long, n_shingles long, digest binary, members binary, prefix array<long>"


@releasing
def _sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "digest", "members", "prefix"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    for _, rows in _grouped(batches, 0):
        documents = next(r for r in rows if r[1] == DOCUMENTS)
        often = _unpacked(next(r for r in rows if r[1] == DOCUMENTS - 1))
        n = documents[2]
        raw = documents[3]
        ids, nulls, digests = np.frombuffer(raw[: 8 * n], dtype="<i8").tolist(), raw[8 * n : 9 * n], raw[9 * n :]
        sizes = _unzip(documents[4], NUMBER).astype(np.int64)
        answers = [_unpacked(r) for r in rows if r[1] >= 0]
        if answers:
            hashes, numbers, total = (np.concatenate(x) for x in zip(*answers, strict=True))
            every = np.flatnonzero(numbers == ALL)
            every = every[np.argsort(hashes[every])]
            # the documents of hashes that many have: all of these are shared
            at = np.searchsorted(hashes[every], often[0])
            one = numbers != ALL
            hashes, total, numbers = (np.concatenate(x) for x in ((hashes[one], often[0]), (total[one], total[every][at]), (numbers[one], often[1])))
            order = np.lexsort((hashes, total, numbers))
            hashes, total, numbers = hashes[order], total[order], numbers[order]
        else:
            hashes, numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        ends = np.searchsorted(numbers, np.arange(n + 1)).tolist()
        out, held = [], 0
        for i, size in enumerate(sizes.tolist()):
            own, need = hashes[ends[i] : ends[i + 1]], least_overlap(size, percent)
            doc_id = None if nulls[i] else ids[i]
            if doc_id is None or size == 0 or len(own) < need:
                out.append((doc_id, size, None, None, None))
            else:  # of all its hashes, rarest first, size - need + 1 are the prefix; those that nobody shares come first
                prefix = own[: len(own) - need + 1]
                out.append((doc_id, size, digests[16 * i : 16 * i + 16], np.sort(own).astype("<u8").tobytes(), prefix.astype(np.int64).tolist()))
                held += 8 * len(own)
            if held > 4 << 20 or len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def shared_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``, with a digest, members and a prefix if it can link at all."""
    spark = docs.sparkSession
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    total = own.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(4, min(BUCKETS, max(1, total // BUCKET_BYTES)).bit_length())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, (total // BUCKET_BYTES) // 4)
    packed = own.mapInArrow(partial(_hash, words=words, bits=bits), PACKED)
    # rows of documents have no bucket to go to; they spread by chunk
    by_bucket = packed.withColumn("to", F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(-1 - F.col("chunk"))).repartition(max(least, min(parts, 1 << bits)), "to")
    answered = by_bucket.sortWithinPartitions("bucket", "chunk").drop("to").mapInArrow(_answer, PACKED)
    return answered.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(partial(_sets, percent=percent), SETS)


@releasing
def _searched(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block, in each first the query (its own id is null), then the sets that it is held against."""

    def done(rows):
        if rows[0][3] is not None:
            raise ValueError("a block without its query")
        members = [np.frombuffer(r[5], dtype="<u8") for r in rows]
        sizes = np.array([r[4] for r in rows])
        found = search(members[0], int(sizes[0]), members[1:], sizes[1:], percent)
        return [(rows[0][1], rows[1 + i][3]) for i in found.tolist()]

    at, held, out = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "query", "part", "doc_id", "n_shingles", "members")), strict=True):
            if held and row[:3] != at:
                out += done(held)
                held = []
            at = row[:3]
            held.append(row)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    out += done(held) if held else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _verified(pairs: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Of the pairs (query, doc_id, n: size of the query's set) those that link, as (a, b). Sets are sought in blocks of a query and about ``block`` hashes of others."""
    sets = classes.select("doc_id", "n_shingles", "members")
    pairs = stored(pairs.distinct(), "pairs")
    loads = pairs.groupBy("query").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    dealt = stored(pairs.select("query", "doc_id").join(loads, "query").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)")).drop("parts"), "dealt")
    others = dealt.join(sets, "doc_id").select("query", "part", "doc_id", "n_shingles", "members")
    own = dealt.select("query", "part").distinct().join(sets.withColumnRenamed("doc_id", "query"), "query").select("query", "part", F.lit(None).cast("long").alias("doc_id"), "n_shingles", "members")
    rows = others.unionByName(own).withColumn("block", F.xxhash64("query", "part"))
    parts = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "query", "part", F.asc_nulls_first("doc_id")).mapInArrow(partial(_searched, percent=percent), "a long, b long")


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether sets that share the hash of two entries can be similar if it is the first that they share: sizes are near, and enough is left of both from there on."""
    return (
        f"100 * {x}.n >= {percent} * {y}.n and 100 * {y}.n >= {percent} * {x}.n and "
        f"{100 + percent} * least({x}.n - {x}.rank, {y}.n - {y}.rank) >= {percent} * ({x}.n + {y}.n)"
    )


def _pairs_left(placed: DataFrame) -> int:
    """Pairs of entries of one list and different groups, at most: those of several lists count in each."""
    sizes = placed.groupBy("hash", "group").agg(F.count(F.lit(1)).cast("double").alias("n"))
    lists = sizes.groupBy("hash").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return int(lists.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).head()[0] or 0)


def jaccard_links(classes: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same classes as all links do (columns doc_id, n_shingles, members, prefix; stored).

    Entries of the lists of prefix hashes form groups. In a round, each entry of a list that holds several groups is held
    against a few entries of the list's largest group, others in each round; what links joins groups. So large groups of near copies are
    joined in a number of comparisons that grows with the entries. Rounds go on as long as they leave a tenth fewer pairs of
    entries of different groups, and more than a few for each entry; all those pairs that are left are then compared.
    """
    ranked = classes.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "hash"), F.expr("n_shingles - octet_length(members) / 8").cast("long").alias("unshared"))
    placed = stored(ranked.select("hash", "doc_id", "n", (F.col("unshared") + F.col("at")).alias("rank"), F.col("doc_id").alias("group")), "entries")
    links, before, entry = [], None, ("doc_id", "n", "rank", "group")
    for turn in count():
        # of a list's largest group, some entries by a hash; at first every class is a group, and the list's first entry serves
        own = F.struct(*entry)
        some = [F.min_by(own, F.col("doc_id"))] if turn == 0 else [F.min_by(own, F.xxhash64("doc_id", F.lit(turn), F.lit(i))) for i in range(PIVOTS)]
        largest = placed.groupBy("hash", "group").agg(F.count(F.lit(1)).alias("size"), F.array(*some).alias("pivots"))
        lists = largest.groupBy("hash").agg(F.max_by("pivots", F.struct("size", -F.col("group"))).alias("pivots"), F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
        lists = stored(lists.drop("groups"), "lists")
        met = stored(lookup_join(placed, lists, "hash", "rows", placed.count()), "met")
        pairs = met.withColumn("own", own).withColumn("pivot", F.explode("pivots")).filter("group <> pivot.group").filter(_may_link("own", "pivot", percent))
        links.append(stored(_verified(pairs.select(F.col("pivot.doc_id").alias("query"), "doc_id", F.col("pivot.n").alias("n")), classes, percent, block), "links"))
        placed = met.select("hash", *entry)
        if not links[-1].isEmpty():
            own = placed.select("doc_id", "group").distinct()
            joined = links[-1].join(own.withColumnsRenamed({"doc_id": "a", "group": "x"}), "a").join(own.withColumnsRenamed({"doc_id": "b", "group": "y"}), "b")
            roots = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnsRenamed({"node": "group"})
            placed = stored(placed.join(roots, "group", "left").select("hash", "doc_id", "n", "rank", F.coalesce("root", "group").alias("group")), "placed")
        left = _pairs_left(placed)
        if left <= FEW * max(placed.count(), 1) or before is not None and 10 * left > 9 * before:
            break
        before = left
    mixed = placed.groupBy("hash").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("hash")
    rest = stored(placed.join(mixed, "hash", "left_semi"), "mixed")
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.hash") == F.col("y.hash")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.group") != F.col("y.group")) & F.expr(_may_link("x", "y", percent)))
    links.append(_verified(across.select(F.col("x.doc_id").alias("query"), F.col("y.doc_id").alias("doc_id"), F.col("x.n").alias("n")), classes, percent, block))
    return reduce(DataFrame.unionByName, links)


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A document's set is that of its distinct runs of ``words`` words, lower-cased (A-Z) and divided by ASCII white space, or of all
    its words as one if they are fewer. Two documents link if 100 times their intersection is at least ``percent`` times
    their union. Without words or text, a document has no set and no links. component_id is the least doc_id that links
    reach, its own if there are none. Rows with a null doc_id have no links and a null component. Rows that repeat a
    doc_id are one node with the links of all of them. Other columns, whatever their names, are not read. An empty table
    gives an empty one. Whole texts are read. Hashes have 56 bits.
    """
    sets = stored(shared_sets(docs, words, percent), "sets")
    able = sets.filter("digest is not null")
    equal = stored(able.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "equal")
    # of a class the first document stands for it; a repeated row of it is taken once
    firsts = able.join(equal.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    classes = stored(firsts.dropDuplicates(["doc_id", "digest"]), "firsts")
    links = jaccard_links(classes.filter("n_shingles > 0"), percent, block)
    # an identifier with several sets links them all: its sets' first documents are joined
    ties = able.select("doc_id", "digest").distinct().join(equal.select("digest", "first"), "digest").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")) if _repeats(able) else None
    groups = components(links if ties is None else links.unionByName(ties))
    by_set = equal.join(groups.withColumnsRenamed({"node": "first", "root": "component_id"}), "first", "left").select("digest", "rows", F.coalesce("component_id", "first").alias("component_id"))
    by_set = stored(by_set, "components")
    members = sets.select("doc_id", "n_shingles", "digest")
    linked = lookup_join(members.filter("digest is not null"), by_set, "digest", "rows", able.count())
    alone = members.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _repeats(able: DataFrame) -> bool:
    return not able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: those whose doc_id is its component_id.

    Rows with a null doc_id, and rows without text or words, stay. Rows that repeat the doc_id of one that stays all stay.
    Columns may have any names besides. An empty table gives an empty one. Whole texts are read.
    """
    name = fresh_name(docs, "dropped")
    dropped = near_groups(docs, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t from documents),
s as (
  select doc_id, case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')]
    else list_distinct([array_to_string(t[i:i + 4], ' ') for i in range(1, len(t) - 3)]) end as g from w),
n as (select doc_id, len(g) as n from s),
u as (select doc_id, unnest(g) as h from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from u a join u b on a.h = b.h and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
e as (select x as a, y as b from l union select y, x from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as b from r group by a)
select doc_id, n as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id from n left join c on a = doc_id
"""
