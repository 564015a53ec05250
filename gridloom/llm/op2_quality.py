"""Text quality by naive Bayes support vectors.

Features are indicators of hashed byte n-grams and of runs of equal words. Each is scaled by the log of the ratio of
its counts in good and bad documents, every document's vector is brought to unit length, and a linear model is fitted
to hinge loss by dual coordinate descent. A sigmoid turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import gather, releasing, sample_by, small_batches, table
from gridloom.llm.linear import fit_hinge, fit_sigmoid
from gridloom.llm.ngrams import distinct_grams

#: n-gram orders and hash bits; labelled documents of each class to fit on, about; documents and bytes of their n-grams in all, at most; the least score of a good text.
ORDERS, BITS, SAMPLE, SAMPLE_IN_ALL, SAMPLE_BYTES, GOOD = (3,), 18, 4000, 12_000, 128 << 20, 0.7
#: Runs of so many equal words and more have one feature.
LONGEST_RUN = 6
N_FEATURES = (1 << BITS) + LONGEST_RUN + 1


def word_runs(text: str) -> list[int]:
    """n-grams of whether words equal the word before: the lengths of runs of equal words, from 1 for none."""
    words = text.split()
    found, run = set(), 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        found.add(run)
    return sorted({min(x, LONGEST_RUN) for x in found})


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    texts = [t or "" for t in texts]
    for text, grams in zip(texts, distinct_grams([t.encode("utf-8", "surrogatepass") for t in texts], ORDERS, BITS), strict=True):
        yield np.concatenate([grams, np.array(word_runs(text), dtype=np.uint32) + np.uint32(1 << BITS)]).astype(np.uint32)


class QualityModel:
    """Scores are of a model of all rows; its sigmoid is fitted on a fifth of the rows that another model didn't see."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray):
        self.constant = (good.sum() + 1) / (len(good) + 2)
        self.trained = 0 < good.sum() < len(good)
        if not self.trained:
            return
        fifth = np.arange(len(rows)) % 5 == 4
        if 0 < good[~fifth].sum() < (~fifth).sum() and fifth.any():
            self._fit([r for r, x in zip(rows, fifth, strict=True) if not x], good[~fifth])
            self.sigmoid = fit_sigmoid(np.array([self.margin(r) for r, x in zip(rows, fifth, strict=True) if x]), good[fifth])
        else:
            self.sigmoid = (1.0, 0.0)
        self._fit(rows, good)

    def _fit(self, rows, good):
        counts = np.ones((2, N_FEATURES))
        for row, label in zip(rows, good, strict=True):
            counts[int(label)][row] += 1
        ratio = np.log(counts[1] / (good.sum() + 1)) - np.log(counts[0] / ((~good).sum() + 1))
        weights, self.bias = fit_hinge(rows, np.where(good, 1, -1), ratio, 1.0, 20, unit=True)
        self.weights, self.squares = (weights * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum() / max(np.sqrt(self.squares[row].sum()), 1e-6)) + self.bias

    def score(self, row: np.ndarray) -> float:
        if not self.trained:
            return float(self.constant)
        a, b = self.sigmoid
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(row) + b, -700, 700))))


@releasing
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        rows = [x.astype("<u4").tobytes() for x in features(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """From about ``sample`` labelled documents of each class, chosen by a hash of doc_id; None if there are none. Where labels disagree, the lowest holds.

    Rows that are repeated count once. The driver gets SAMPLE_IN_ALL rows and SAMPLE_BYTES bytes at most.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = sample_by(marks, "label", sample, 2)
    if chosen is None:
        return None
    own = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").join(F.broadcast(chosen), "doc_id")  # the sample is bounded
    rows = gather(own.mapInArrow(_features, "doc_id long, label int, features binary"), "features", SAMPLE_IN_ALL, SAMPLE_BYTES)
    return QualityModel([np.frombuffer(r["features"], dtype="<u4") for r in rows], np.array([r["label"] == 1 for r in rows])) if rows else None


@releasing
def _score(batches: Iterator[pa.RecordBatch], held, good: float) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in small_batches(batches, "text"):
        scores = [model.score(row) if model is not None else 0.5 for row in features(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(x >= good) for x in scores], pa.int32())], ["doc_id", "score", "predicted"])


def rate(docs: DataFrame, model: QualityModel | None, good: float = GOOD) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 if the score is ``good`` or more).

    Null and empty texts have no features and get the score of the bias; without labels every score is 0.5. Whole texts are
    read, whatever their length. A null doc_id, repeated rows and repeated ids stay as they are. Other columns, whatever
    their names, are not read. An empty table gives an empty one. No shuffle; the model has a fixed size and is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(partial(_score, held=held, good=good), "doc_id long, score double, predicted int")


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``rate`` by a model of the labelled documents that aren't held out (a null doc_id is not); adds ``held_out``."""
    model = fit(docs.filter(f"not ({HELD_OUT})"), labels.filter(f"not ({HELD_OUT})"))
    return rate(docs, model).selectExpr("doc_id", f"coalesce({HELD_OUT}, false) as held_out", "score", "predicted")


@releasing
def _good(batches: Iterator[pa.RecordBatch], held, good: float) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in small_batches(batches, "text"):
        yield batch.filter(pa.array([model is None or model.score(row) >= good for row in features(batch.column("text").to_pylist())]))


def keep_good(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is good; all of them if no row has a label.

    Null and empty texts have no features and are judged by the bias. A null doc_id, repeated rows and repeated ids are judged
    each by its text. Columns may have any names. An empty table gives an empty one. Whole texts are read, whatever their length.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(f"not ({HELD_OUT})"), labels.filter(f"not ({HELD_OUT})")))
    return docs.mapInArrow(partial(_good, held=held, good=good), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
