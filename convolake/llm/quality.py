"""Quality of texts: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words, its adjacent pairs of words, the shapes of its words (letters by case, digits and the last signs) and adjacent pairs of
shapes, hashed into one table of weights; a word that repeats the one before has a feature of its own. A feature's value is its share of the text, so that a
score doesn't depend on length, and a score is a sparse dot product with the weights. Weights are learnt in one pass after another over a sample of the
labelled texts, of at most max_train documents, taken by a hash of their identifiers; scores cover every whole text.

A null label, or one of a document that isn't there, teaches nothing; of several labels of one document the largest counts, and of several texts of one doc_id one teaches. With no label every score is that
of the bias, 0.5. Null and empty texts score as the bias says. Rows that repeat get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import mixed, saved, texts

#: log2 of the weights.
BITS = 18
#: A text's values sum to this much for each of the kinds of features.
SCALE = 16.0
#: Letters as a or A, digits as 0, signs and white space as they are; bytes of other characters are letters.
_SHAPES = bytes(ord("a") if b >= 128 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256))


def features(text: str) -> np.ndarray:
    """Indices of all features of a text, with repetition: words, pairs, shapes and pairs of shapes, in equal numbers but for the first word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    word = np.fromiter(map(crc32, words), np.uint64, n)
    shape = np.fromiter([crc32(w[:1] + w[-3:]) for w in raw.translate(_SHAPES).split()], np.uint64, n)
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ word[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair[word[:-1] == word[1:]] = np.uint64(12345)
    shapes = shape[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ shape[1:] * np.uint64(0xA5A3564E27F8865B)
    out = np.concatenate([word * np.uint64(0xFF51AFD7ED558CCD), pair, shape * np.uint64(0xC4CEB9FE1A85EC53), shapes])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(64 - BITS)).astype(np.int64)


def score(found: np.ndarray, weights: np.ndarray, bias: float) -> float:
    """Probability of label 1."""
    z = bias + (4 * SCALE * float(weights[found].mean()) if len(found) else 0.0)
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


class Leader:
    """Weights by follow-the-regularised-leader, one coordinate at a time: z sums what pulls a weight, n its squared gradients."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 + (1 << BITS)), np.zeros(1 + (1 << BITS))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, found: np.ndarray, label: int) -> None:
        at, counts = np.unique(found, return_counts=True)
        at = np.append(at, 1 << BITS)  # the bias comes last
        x = np.append(4 * SCALE * counts / max(len(found), 1), 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8192, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, bias) from docs (doc_id, text) and labels (doc_id, label). Texts become features where they are read; one task then learns from at most max_train of them."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(mixed("doc_id"), "doc_id").limit(max_train)  # at most max_train rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["at", "found", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(alpha, beta, l1, l2)
        for batch in batches:
            for found, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leader.learn(np.frombuffer(found, np.int32), int(label > 0))
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype("<f4").tobytes()])], ["weights"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select(mixed("doc_id").alias("at"), "text", "label")
    said = rows.mapInArrow(extract, "at long, found binary, label int")
    of = said.groupBy("at").agg(F.min(F.struct(F.xxhash64("found").alias("by"), "found", "label")).alias("x"))  # one text of each doc_id, or a repeated one would not be bounded
    sample = saved(of.select("at", "x.found", "x.label"), "quality-sample")
    again = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    ordered = again.repartition(1).sortWithinPartitions("turn", "at").select("found", "label")
    learnt = ordered.mapInArrow(learn, "weights binary").collect()  # one row of 1 MB
    weights = np.frombuffer(learnt[0][0], "<f4") if learnt else np.zeros(1 + (1 << BITS), "<f4")
    return weights[:-1], float(weights[-1])


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score(features(t), weights, bias) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; learnt from the labels of the other folds."""
    taught = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").alias("label")).where(~held_out(F.col("doc_id")))
    weights, bias = train(texts(docs, id_col, text_col), taught, **settings)
    out = score_texts(docs, weights, bias, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted as good; they are filtered where they are read."""
    taught = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").alias("label")).where(~held_out(F.col("doc_id")))
    weights, bias = train(texts(docs, id_col, text_col), taught, **settings)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(features(t or ""), weights, bias) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
