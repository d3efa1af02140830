"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them, and only documents have labels.

A sentence is toxic with probability sigmoid(bias + weights of its distinct words); a word's weight is the sum of those
of its features, which are the word itself and its beginnings, so inflected forms share what they begin with. A document
is toxic unless none of its sentences is. Weights are fitted to document labels by gradient descent through that noisy-or, so the sentences that
explain a label are found without being labelled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import Scratch, crc32_of, map_arrow

#: Labelled rows, by least hash of their id, that the classifier is fitted on; features that get a weight.
FIT_ROWS, FIT_FEATURES = 10_000, 4_000
#: Documents that a feature must be in to get a weight, and standard deviations by which toxic ones must be more.
LEAST_DOCS, LEAST_LIFT = 4, 3.5
#: Characters of a word's beginnings.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
STEPS, RATE, SHRINK = 400, 0.08, 1e-4

#: Bytes: letters lower-cased, digits and all beyond ASCII kept, sentence ends as line feeds, others blank.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 10 if chr(b) in ".!?\n" else 32 for b in range(256))


def sentences(text: bytes | None) -> list[list[bytes]]:
    return [words for s in (text or b"").translate(FOLD).split(b"\n") if (words := s.split())]


def features(word: bytes) -> list[str]:
    text = word.decode(errors="replace").lower()
    return [text, *(f"{text[:k]}-" for k in BEGINNINGS if len(text) > k)]


class Weights(dict):
    """Weights of words, from those of features; remembered up to a number of words."""

    def __init__(self, of: dict[str, float]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = sum(self.of.get(f, 0.0) for f in features(word))
        return found


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature of the task's texts how many have it, and how many of these are toxic."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = {w for s in sentences(text) for w in s}
            counts[min(toxic, 1)].update({f for w in words for f in features(w)})
    every = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(every), 50_000):
        part = every[at : at + 50_000]
        columns = [pa.array(part), pa.array([counts[0][f] + counts[1][f] for f in part], pa.int64()), pa.array([counts[1][f] for f in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "n", "k"])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass(frozen=True)
class Bags:
    """toxic, plain: for each document its label and how many sentences have no weighted word; sentence, word: one entry for each weighted word of a sentence; doc: the document of each sentence that has one."""

    toxic: np.ndarray
    plain: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    word: np.ndarray


def loss_and_slope(bags: Bags, bias: float, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the labels with the weights' penalty, and its slope by weights and bias.

    A document's sentences together add up to -log P(not toxic): the sum of softplus of their scores.
    """
    z = bias + np.bincount(bags.sentence, weights[bags.word], len(bags.doc))
    total = np.maximum(np.bincount(bags.doc, softplus(z), len(bags.toxic)) + bags.plain * softplus(np.array(bias)), 1e-9)
    n = max(len(bags.toxic), 1)
    loss = float(np.where(bags.toxic == 1, -np.log(-np.expm1(-total)), total).sum()) / n + SHRINK / 2 * float(weights @ weights)
    by_total = np.where(bags.toxic == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)
    at = by_total[bags.doc] / (1 + np.exp(-z))
    slope = np.append(np.bincount(bags.word, at[bags.sentence], len(weights)), at.sum() + (by_total * bags.plain).sum() / (1 + np.exp(-bias))) / n
    slope[:-1] += SHRINK * weights
    return loss, slope


def fit_noisy_or(bags: Bags, n_words: int) -> tuple[float, np.ndarray]:
    """Bias and weights by gradient descent with moments."""
    weights, bias = np.zeros(n_words), -6.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, STEPS + 1):
        _, g = loss_and_slope(bags, bias, weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights -= step[:-1]
        bias = float(np.clip(bias - step[-1], -12, 0))
    return bias, weights


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[float, dict[str, float]]:
    """Bias and word weights from rows of `labels` (doc_id, toxic) whose text is in `docs`; of FIT_ROWS rows at most."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = scratch.keep(texts.select("doc_id", "toxic", "text"), "sample")
    totals = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not totals[1] or totals[1] >= totals[0]:
        return -12.0, {}
    rate = totals[1] / totals[0]
    counted = map_arrow(sample, _feature_counts, "feature string, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    lift = (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = counted.where((F.col("n") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy(lift.desc(), "feature").limit(FIT_FEATURES)
    number = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}
    held = docs.sparkSession.sparkContext.broadcast(number)  # of FIT_FEATURES features

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for batch in batches:
            plain, having = [], []
            for text in batch.column(2).to_pylist():
                found = [[of[f] for w in set(s) for f in features(w) if f in of] for s in sentences(text)]
                having.append([x for x in found if x])
                plain.append(len(found) - len(having[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(plain, pa.int32()), pa.array(having, pa.list_(pa.list_(pa.int32())))], ["toxic", "plain", "having"])

    rows = map_arrow(sample, weighted, "toxic int, plain int, having array<array<int>>").collect()
    scratch.drop("sample")
    doc = np.array([d for d, r in enumerate(rows) for _ in r["having"]], np.int64)
    found = [s for r in rows for s in r["having"]]
    sentence = np.repeat(np.arange(len(found)), [len(s) for s in found])
    word = np.array([w for s in found for w in s], np.int64)
    bias, weights = fit_noisy_or(Bags(np.array([r["toxic"] for r in rows]), np.array([r["plain"] for r in rows]), doc, sentence, word), len(number))
    return bias, {f: float(weights[i]) for f, i in number.items()}


def offending(text: bytes, bias: float, weights: Weights) -> list[dict]:
    """Sentences of at least THRESHOLD as code points [start, end) of the text, with their probability."""
    out, at = [], 0
    for piece in text.translate(FOLD).split(b"\n"):
        z = bias + sum(map(weights.__getitem__, set(piece.split())))
        p = 1 / (1 + np.exp(-z))
        if p >= THRESHOLD:
            start = len(text[:at].decode(errors="replace"))
            out.append({"start": start, "end": start + len(text[at : at + len(piece)].decode(errors="replace")), "p": float(p)})
        at += len(piece) + 1
    return out


SCORED = "doc_id long, score double, sentences array<struct<start: int, end: int, p: double>>"


def score(docs: DataFrame, bias: float, weights: dict[str, float]) -> DataFrame:
    """SCORED for each row; a text without a sentence, null included, scores 0."""
    held = docs.sparkSession.sparkContext.broadcast((bias, weights))  # of FIT_FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = held.value[0], Weights(held.value[1])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, where = [], []
            for text in batch.column(1):
                text = text.as_py()
                total, worst = 0.0, bias
                for words in sentences(text):
                    z = bias + sum(map(weights.__getitem__, set(words)))
                    total += math.log1p(math.exp(min(z, 700.0)))
                    worst = max(worst, z)
                scores.append(float(-np.expm1(-total)))
                where.append(offending(text, bias, weights) if worst >= np.log(THRESHOLD / (1 - THRESHOLD)) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(where, kinds)], ["doc_id", "score", "sentences"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """SCORED, held_out and predicted for each row of `docs`, by a classifier of labelled rows where `held_out` is false.

    The text alone makes the score. Rows with a null doc_id are scored but not learned from; of labels that repeat a
    doc_id the greatest holds; without labels of both kinds every score is near 0. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    bias, weights = fit(docs, labels.where(~held_out), scratch)
    out = score(docs, bias, weights)
    return out.withColumns({"held_out": held_out, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """`toxicity` for `documents`, a row for each of its rows, learned from three quarters of the labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, labels.select("doc_id", "toxic"), F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) == 2)
    return out.select("doc_id", "held_out", "score", "predicted", "sentences")
