"""Threshold-scaled sketches of documents, by SQL functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash space. Whether a hash is kept depends on nothing
else, so sketches merge by union and compare fairly between texts of very different lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: Words in a shingle, and one in how many hashes is kept.
WORDS, SCALE = 5, 4
#: Ranges of doc_id for each shuffle partition.
RANGES_A_PARTITION = 8
LOWEST = -(1 << 63)
#: Type of a row's place in the order: doc_id, then 60 bits of a hash of the text.
PLACE = "decimal(38,0)"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """struct(digest of the words, number of shingles, kept hashes in ascending order). A text of fewer words is one shingle; one without words has none."""
    limit = F.lit(LOWEST + (1 << 64) // scale)

    def shingles(h: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(h[i + k] for k in range(words))))
        return F.when(F.size(h) >= words, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def kept(s: Column, h: Column) -> Column:
        return F.struct(F.xxhash64(h).alias("digest"), F.size(s).cast("long").alias("n"), F.array_sort(F.array_distinct(F.filter(s, lambda x: x < limit))).alias("kept"))

    return _bound(hashed, lambda h: _bound(shingles(h), lambda s: kept(s, h)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches; 1 if their words are the same, 0 if they differ and nothing is kept of either."""
    return F.when((a["digest"] == b["digest"]) & (a["n"] == b["n"]), F.lit(1.0)).otherwise(
        _bound(F.size(F.array_intersect(a["kept"], b["kept"])), lambda both: F.when(both == 0, F.lit(0.0)).otherwise(both / (F.size(a["kept"]) + F.size(b["kept"]) - both)))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of ``a``'s shingles that ``b`` has; null if nothing is kept of ``a``."""
    n = F.size(a["kept"])
    return F.when((a["digest"] == b["digest"]) & (a["n"] == b["n"]), F.lit(1.0)).when(n > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / n)


def merged(a: Column, b: Column) -> Column:
    """Kept hashes of a union of shingle sets."""
    return F.array_sort(F.array_union(a["kept"], b["kept"]))


def printed(s: Column) -> Column:
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat_ws(":", sixteen(s["digest"]), s["n"].cast("string"), F.array_join(F.transform(s["kept"], sixteen), "")))


def _listed(bounds: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<{PLACE}>)")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below the key, by halving steps."""
    held = _listed(bounds)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    n = len(bounds)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) < key), at + step).otherwise(at))


def _heads(keys: DataFrame, ranges: int) -> list[int]:
    """Largest key of each of about so many ranges of nearly equal numbers of rows, ascending."""
    shares = [i / ranges for i in range(1, ranges)]
    near = keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * ranges)).alias("b")).head()["b"]
    if not near:
        return []
    at = _range_of(F.col("key"), sorted({int(x) for x in near}))
    return sorted(int(r["head"]) for r in keys.groupBy(at.alias("at")).agg(F.max("key").alias("head")).collect())  # a row for each range


def with_next(docs: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``docs`` with ``next``: this column of the next row by descending ``key`` (of type PLACE), then ``tie``; after the last that of the first.

    Rows are dealt by ranges of the key, which rows with one doc_id but different texts don't share. The first row of
    each range also goes, as a guest, to the range above, where it follows the last row.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = _heads(docs.select("key"), ranges)
    if not heads:
        return docs.withColumn("next", F.col(column))
    n = len(heads)
    held = _listed(heads)
    placed = docs.withColumn("range", _range_of(F.col("key"), heads))
    here = F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))
    above = F.struct(F.expr(f"(range + 1) % {n}").alias("at"), F.lit(True).alias("guest"))
    places = F.when(F.col("key") == F.get(held, F.col("range")), F.array(here, above)).otherwise(F.array(here))
    dealt = placed.select("*", F.explode(places).alias("place")).select(*docs.columns, "place.*")
    order = Window.partitionBy("at").orderBy("guest", F.desc("key"), F.desc("tie"))
    return dealt.withColumn("next", F.lead(column).over(order)).filter("not guest").drop("at", "guest")


def fingerprint(docs: DataFrame, words: int = WORDS, scale: int = SCALE, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited.

    Null texts count as empty; an empty text has no shingles, and is like another empty one only. A fingerprint is the
    digest of the words, the number of shingles and the kept hashes, in hex. Words are lower-cased and divided by ASCII
    white space. Rows with a null doc_id come after all others; rows with one doc_id follow each other by a hash of
    the text, and of rows that repeat it doesn't show which comes first. Other columns, whatever their names, are not read. An empty table
    gives an empty one. Whole texts are read, whatever their length. Texts are shuffled once.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    place = F.coalesce("doc_id", F.lit(LOWEST)).cast(PLACE) * F.lit(1 << 60).cast("decimal(19,0)") + F.shiftright("tie", 4)
    own = own.withColumn("key", place.cast(PLACE))
    content = F.struct("text", sketch(F.col("text"), words, scale).alias("sketch"))
    paired = with_next(own.select("doc_id", "key", "tie", content.alias("own")), "own", ranges)
    n = F.length("own.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("own.text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "own.sketch", F.col("next.sketch").alias("next_sketch"), _bound(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha256"), sketch(e, words, scale).alias("sketch"))).alias("edited"))
    a, b = F.col("sketch"), F.col("edited.sketch")
    return made.select("doc_id", "n_chars", F.col("edited.sha256").alias("edited_sha256"), printed(a).alias("fingerprint"), printed(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, F.col("next_sketch")).alias("near_next"), containment(a, b).alias("contained_edited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
