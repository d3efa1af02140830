"""Importance resampling of documents: two hashed n-gram models weigh each text, Gumbel top-k draws by weight.

Words, runs of other marks and their pairs are hashed to BUCKETS buckets. The raw model counts all documents, the target
model those that a label calls good. A document's log weight is the sum over its n-grams of the log ratio of the two.
Adding standard Gumbel noise and taking the k greatest draws k documents without replacement in proportion to weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.kneser_ney import WordHashes, pair_hash
from accordant.llm.shared import Scratch, map_arrow

BUCKETS, SMOOTHING, SEED = 10_000, 1.0, 20
#: Labelled rows, by least hash of their id, that make the target model.
TARGET_ROWS = 20_000
#: Rows that may be sorted on the driver to place the cut among equal-sized bins of keys.
FINE = 5_000
PIECES = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")


def buckets_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    words = PIECES.findall((text or b"").lower())
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return (np.concatenate((one >> np.uint64(16), pair_hash(one[:-1], one[1:]))) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
            found = np.bincount(buckets_of(text.as_py(), hashes), minlength=BUCKETS)
            raw += found
            if good:
                target += found
    if raw.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def log_weights(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(doc_id, log_weight) of each row, and the share of good rows among labelled ones."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    chosen = known.where("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).select("doc_id", F.lit(True).alias("good"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = texts.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = map_arrow(marked, _counts, "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    model = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    ratio = model(target) - model(raw) if target.any() else np.zeros(BUCKETS)
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # of BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = WordHashes(), held.value
        for batch in batches:
            weights = [float(ratio[buckets_of(text.as_py(), hashes)].sum()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64())], ["doc_id", "log_weight"])

    return scratch.keep(map_arrow(texts, weigh, "doc_id long, log_weight double"), "weights"), 1.0 if share is None else share


def gumbel(key: str = "doc_id") -> F.Column:
    """Standard Gumbel noise that depends on the row's id and SEED alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(key)), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(2.0**53)))


def greatest(keyed: DataFrame, k: int) -> DataFrame:
    """The k rows of a stored table (key, doc_id, ...) with the greatest key, of equal ones those with the least doc_id.

    The cut is found by counting rows in ever finer bins of the key; only the last bin's rows, FINE at most unless
    their keys are equal, are put in order, by one window over that bin.
    """
    low, high, above = -math.inf, math.inf, 0
    while True:
        inside = keyed.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))
        least, most, n = inside.agg(F.min("key"), F.max("key"), F.count("*")).first()
        if above + n <= k or n <= FINE or least == most:
            break
        width = (most - least) / 1024
        bins = {r["bin"]: r["count"] for r in inside.groupBy(F.least(F.lit(1023), F.floor((F.col("key") - least) / width)).alias("bin")).count().collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        start, end = least + b * width, least + (b + 1) * width if b < 1023 else math.nextafter(most, math.inf)
        edge = keyed.where((F.col("key") >= F.lit(end))).count()
        if (max(start, low), end) == (low, high):
            break
        low, high, above = max(start, low), end, edge
    rest = inside.orderBy(F.col("key").desc(), F.col("doc_id").asc_nulls_last()).limit(max(0, k - above))
    return keyed.where(F.col("key") >= F.lit(high)).unionAll(rest)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, log_weight, key) of the rows drawn: `share` of all rows, by default the share of good ones among labels.

    Null and empty texts have weight 1. Repeated rows are drawn each, with one key if they have one id; a null doc_id
    is drawn like any other value. Without labels all weights are 1 and all rows are drawn; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    weights, good = log_weights(docs, labels, scratch)
    keyed = scratch.keep(weights.withColumn("key", F.col("log_weight") + gumbel()), "keyed")
    return greatest(keyed, math.ceil(keyed.count() * (good if share is None else share)))


def op2_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The rows of `documents` drawn, with their log weight and key."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels.select("doc_id", "quality")).select("doc_id", "log_weight", "key")
