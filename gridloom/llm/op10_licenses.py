"""Licence scans: canonical digests of whole texts, and of notice lines, joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.license_texts import DIGESTS, EQUIVALENT, FORMS, NOTICES, TEXTS

#: A line that says whose the work is; it differs from copy to copy of one licence.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[]|by )|\(c\)[ \t]*(copyright|[0-9<\[])|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Every known notice has this word in canonical form, so only lines with it are looked up.
NOTICE_WORD = "license"


def spelled(text: Column) -> Column:
    """Lower case, with equivalent spellings made one."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for other, usual in EQUIVALENT:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def canonical(text: Column) -> Column:
    return words(F.regexp_replace(spelled(text), COPYRIGHT_LINE, " "))


def known(spark: SparkSession) -> DataFrame:
    """license_id and digest of every known licence and notice: a fixed list of a few hundred rows."""
    rows = [*TEXTS.items(), *((v, k) for k, v in NOTICES.items()), *FORMS]
    short = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return short.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))


def digest_store(texts: DataFrame) -> DataFrame:
    """license_id and digest of a table of licence texts (license_id, text); the canonical form is that of ``scan_licenses``."""
    return texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id")).select("license_id", "digest")


def scan_licenses(docs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256, license_id, notice_ids.

    license_id names the licence that the whole text is, after case, punctuation, copyright lines and equivalent spellings
    are normalised; else null. notice_ids names, sorted, once each and joined by commas, the licences whose notices stand
    on lines of their own; empty if none do. A null text counts as empty, and is no licence. A null doc_id, repeated
    rows and repeated ids stay as they are. Texts are read whole, whatever their length. Other columns are not read. An empty table gives an empty one.
    ``store``: known licences (license_id, digest), as of ``digest_store``; by default the fixed list of ``known``, which is
    short and so is broadcast: documents aren't shuffled. Another store is joined as Spark sees fit. Notices are looked up in the fixed list.
    """
    fixed = known(docs.sparkSession).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    digests = F.broadcast(fixed) if store is None else store.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    notices = {r["digest"]: r["license_id"] for r in fixed.collect()}  # the fixed list
    by_digest = F.create_map(*(F.lit(x) for pair in notices.items() for x in pair))
    lines = F.filter(F.split(F.col("_spelled"), "\n"), lambda x: F.contains(x, F.lit(NOTICE_WORD)))
    named = F.filter(F.transform(lines, lambda x: F.element_at(by_digest, F.sha2(words(x), 256))), lambda x: x.isNotNull())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spelled(F.col("text")).alias("_spelled"))
    found = own.select("doc_id", F.sha2(words(F.regexp_replace("_spelled", COPYRIGHT_LINE, " ")), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notice_ids"))
    return found.join(digests, "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", "notice_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def spell(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        for other, usual in EQUIVALENT:
            x = f"replace({x}, {quoted(other)}, {quoted(usual)})"
        return x

    word = lambda x: rf"trim(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in [*TEXTS.items(), *((v, k) for k, v in NOTICES.items())])
    whole = lambda x: word(f"regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g')")
    return f"""
with k as (select license_id, {spell('text')} as s from (values {rows}) as v(license_id, text)),
known as (select min(license_id) as license_id, sha256({whole('s')}) as digest from k group by 2),
d as (select doc_id, {spell('text')} as s from documents),
l as (select distinct doc_id, license_id from
  (select doc_id, sha256({word('line')}) as digest from (select doc_id, unnest(string_split(s, chr(10))) as line from d) where contains(line, '{NOTICE_WORD}')) join known using (digest)),
n as (select doc_id, string_agg(license_id, ',' order by license_id) as notice_ids from l group by doc_id),
w as (select doc_id, sha256({whole('s')}) as canonical_sha256 from d)
select w.doc_id, canonical_sha256, license_id, coalesce(notice_ids, '') as notice_ids
from w left join known on known.digest = canonical_sha256 left join n using (doc_id)
"""
