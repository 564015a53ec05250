"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword. For each bit a linear classifier of n-gram indicators, fitted by hinge loss, tells the
languages with +1 from those with -1. Decoding adds up each language's losses over the bits, weighted by how reliable
the bit is for that language; the codeword with the least loss wins, and a close second flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import gather, releasing, sample_by, small_batches, table
from gridloom.llm.linear import fit_hinge
from gridloom.llm.ngrams import distinct_grams

#: n-gram orders and hash bits; documents of each language to fit on, about; documents and bytes of their n-grams in all, at most; languages at most.
ORDERS, BITS, SAMPLE, SAMPLE_IN_ALL, SAMPLE_BYTES, LANGUAGES = (1, 2, 3), 16, 1200, 20_000, 128 << 20, 200
#: A text whose second language loses no more than this above its first is ambiguous.
MARGIN = 0.1
UNKNOWN = "und"
#: A text of so many distinct n-grams is in no learned language if its first language loses more than bits that tell nothing would make it lose.
LEAST_GRAMS, FAR = 50, float(np.log(2.0))
has_letter = regex.compile(r"\p{L}").search


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split in two for up to 5 languages, else 12 seeded even splits for each doubling, of which any two rows differ in a quarter or more."""
    if n <= 5:
        splits = range(1, 1 << max(n - 1, 0))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], dtype=np.int8).reshape(n, -1)
    random = np.random.default_rng(n)
    half = np.where(np.arange(n) % 2 == 0, 1, -1)
    while True:
        code = np.stack([random.permutation(half) for _ in range(12 * int(np.ceil(np.log2(n))))], axis=1).astype(np.int8)
        alike = code.astype(int) @ code.T - code.shape[1] * np.eye(n, dtype=int)
        if alike.max() <= code.shape[1] // 2:
            return code


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    return distinct_grams([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], ORDERS, BITS)


class LanguageModel:
    """Bits are fitted on four fifths of each language's rows; how far they are to be trusted is seen on the others."""

    def __init__(self, rows: list[np.ndarray], languages: list[str]):
        self.names = sorted(set(languages))
        own = np.searchsorted(self.names, languages)
        self.code = codewords(len(self.names))
        place = np.zeros(len(own), dtype=int)
        for i in range(len(self.names)):
            place[own == i] = np.arange((own == i).sum())
        back = place % 5 == 4
        fitted, ones = [r for r, x in zip(rows, back, strict=True) if not x], np.ones(1 << BITS)
        bits = [fit_hinge(fitted, self.code[own[~back], k], ones, 10.0, 15, unit=True) for k in range(self.code.shape[1])]
        self.weights = np.array([w for w, _ in bits], dtype=np.float32).reshape(len(bits), 1 << BITS).T.copy()
        self.bias = np.array([b for _, b in bits])
        held, own = [r for r, x in zip(rows, back, strict=True) if x], own[back]
        right = np.array([self.outputs(r) for r in held]).reshape(len(held), -1) * self.code[own] > 0
        trust = np.array([(right[own == i].sum(axis=0) + 1) / ((own == i).sum() + 2) for i in range(len(self.names))]).reshape(self.code.shape)
        self.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12)

    def outputs(self, row: np.ndarray) -> np.ndarray:
        return self.weights[row].sum(axis=0) / max(np.sqrt(len(row)), 1.0) + self.bias

    def losses(self, row: np.ndarray) -> np.ndarray:
        """What each language loses, over its bits."""
        return (self.trust * np.log1p(np.exp(-2.0 * self.code * self.outputs(row)))).sum(axis=1)

    def decode(self, row: np.ndarray) -> tuple[str, float, float]:
        """Language, score, and how much more the next one loses."""
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0
        losses = self.losses(row)
        first, second = np.argsort(losses, kind="stable")[:2]
        shares = np.exp(-4.0 * (losses - losses[first]))
        return self.names[first], float(1 / shares.sum()), float(losses[second] - losses[first])

    def knows(self, row: np.ndarray) -> bool:
        """Whether the bits speak for some codeword rather than against every one; short texts count as known."""
        return len(row) < LEAST_GRAMS or float(self.losses(row).min()) <= FAR


@releasing
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        rows = [x.astype("<u4").tobytes() for x in features(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """From about ``sample`` documents of each language, chosen by a hash of doc_id, of those with a language and a text; None if there are none.

    Documents whose n-grams are the same count once. The driver gets SAMPLE_IN_ALL rows and SAMPLE_BYTES bytes at most.
    """
    own = docs.select("doc_id", "text", F.col("lang").cast("string").alias("label")).filter("label is not null and text is not null")
    chosen = sample_by(own, "label", sample, LANGUAGES, SAMPLE_IN_ALL)
    if chosen is None:
        return None
    # the bound is shared out above; this cuts only what the hash of doc_id lets through beyond that, of no language more than of others
    rows = gather(chosen.mapInArrow(_features, "label string, features binary"), "features", SAMPLE_IN_ALL, SAMPLE_BYTES)
    return LanguageModel([np.frombuffer(r["features"], dtype="<u4") for r in rows], [r["label"] for r in rows]) if rows else None


@releasing
def _predict(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in small_batches(batches, "text"):
        texts = batch.column("text").to_pylist()
        found = [model.decode(row) if model is not None and text and has_letter(text) else (UNKNOWN, 0.0, 0.0) for text, row in zip(texts, features(texts), strict=True)]
        names, scores, leads = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array([x < MARGIN for x in leads])], ["doc_id", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, ambiguous.

    lang_pred is a language of the model, or ``und`` with score 0 and ``ambiguous`` if the text is null or has no letter, or there was
    nothing to learn from. Whole texts are read, whatever their length. A null doc_id, repeated rows and repeated ids
    stay as they are. Other columns, whatever their names, are not read. An empty table gives an empty one.
    No shuffle; the model, whose size is fixed by BITS and the number of bits, is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(partial(_predict, held=held), "doc_id long, lang_pred string, score double, ambiguous boolean")


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"


def language_id(docs: DataFrame) -> DataFrame:
    """``identify`` by a model of the documents that aren't held out (a null doc_id is not, and isn't learned from); adds ``held_out``."""
    model = fit(docs.filter(f"not ({HELD_OUT})"))
    return identify(docs, model).selectExpr("doc_id", f"coalesce({HELD_OUT}, false) as held_out", "lang_pred", "score", "ambiguous")


@releasing
def _identified(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in small_batches(batches, "text"):
        texts = batch.column("text").to_pylist()
        yield batch.filter(pa.array([bool(t and has_letter(t)) and model.knows(row) for t, row in zip(texts, features(texts), strict=True)]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language: it has a letter, and its bits don't speak against every codeword (``LanguageModel.knows``).

    Ambiguous texts stay; a text in two languages is clean. Null texts go; a null doc_id, repeated rows and repeated ids are
    judged each by its text. Where nothing can be learned, every row stays. Columns may have any names. An empty table gives an
    empty one. Whole texts are read, whatever their length.
    """
    model = fit(docs.filter(f"not ({HELD_OUT})"))
    if model is None:
        return docs
    return docs.mapInArrow(partial(_identified, held=docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
