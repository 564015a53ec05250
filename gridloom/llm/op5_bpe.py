"""Byte-level BPE encoding and decoding of whole texts by segment trees (see ``bpe.py``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import bpe_for
from gridloom.llm.common import small_batches, table
from gridloom.llm.tokens import BYTE_LEVEL
from gridloom.llm.wordcache import PieceCache, pieces

#: Encoded pieces between spaces, and encoded matches of the pattern, that a worker keeps at most.
PIECES_KEPT, WORDS_KEPT = 900_000, 600_000
DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[PieceCache, object]:
    bpe = bpe_for(path)
    # the tokenizer library's \s is the Unicode property; the regex module's also takes U+001C to U+001F
    match = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    words = PieceCache(lambda texts: bpe.encode_many([t.encode() for t in texts]), WORDS_KEPT, str)

    def encode(texts: list[str]) -> list[bytes]:
        matches = [match(t) for t in texts]
        known = words.fill({m for own in matches for m in own})
        return [b"".join(map(known.__getitem__, own)) for own in matches]

    return PieceCache(encode, PIECES_KEPT), bpe


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    cache, _ = _encoder(path, pattern)
    # other patterns may match across a single space
    cut = [pieces(t) if pattern in (default_pattern(), BYTE_LEVEL) else None for t in texts]
    known = cache.fill({k for own in cut if own for k in own})
    return [b"".join(map(known.__getitem__, own)) if own is not None else cache.encode([t])[0] for t, own in zip(texts, cut, strict=True)]


def decode_ids(ids: list[int], path: str) -> bytes:
    return bpe_for(path).decode(ids)


def _run(batches: Iterator[pa.RecordBatch], path: str, pattern: str, full: bool) -> Iterator[pa.RecordBatch]:
    _, bpe = _encoder(path, pattern)
    for batch in small_batches(batches, "text"):
        counts, id_digests, text_digests, all_ids = [], [], [], []
        for blob in encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern):
            ids = np.frombuffer(blob, dtype="<u4").tolist()
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            text_digests.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if full:
                all_ids.append(ids)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Null and empty texts have no tokens, and their digests are those of the empty string. A null doc_id, repeated rows
    and repeated ids stay as they are, one row each. Texts of any length are encoded whole: a long match takes time
    in proportion to n log n. Other columns, whatever their names, are not read. An empty table gives an empty one.
    No shuffle; each worker keeps PIECES_KEPT and WORDS_KEPT encoded strings at most.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    run = partial(_run, path=path or default_path(), pattern=pattern or default_pattern(), full=with_ids)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))
