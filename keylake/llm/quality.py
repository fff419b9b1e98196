"""Quality: importance resampling between target and raw text.

Texts are bags of hashed words and word pairs. Two generative models give a bucket's probability: one from target text
(documents labelled good, a bounded sample), one from all raw text. A document's log weight is the sum over its n-grams
of log(target / raw); Gumbel noise added to it and the k largest kept sample k documents without replacement in
proportion to their weights. The noise comes from a hash of id and text, so a rerun or a lost task draws the same. The
k-th largest value is found by counts over ranges that narrow, so nothing is ranked in one task.

Defined results: null and empty texts have no n-grams and log weight 0; they take part in the draw. Rows with null id
draw by their text alone. Repeated rows each give a row and share their noise; where some but not all of equal values
are kept, the smaller id counts first, null last, then the smaller hash of text, and of equal rows so many as are left.
With no target text all log weights are 0. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylake.llm import words as W
from keylake.session import materialize

BUCKETS = 10_000
#: Target documents that the target model is fitted on at most.
SAMPLE = 20_000
RANGES = 4096


def _features(w: W.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word pair."""
    pair, at = W.shingles(w, 2)
    return np.concatenate([w.row, w.row[at]]), np.concatenate([w.hash % W.U(buckets), pair % W.U(buckets)]).astype(np.int64)


def _count(docs: DataFrame, target: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all documents and of the target's; one pass, summed where it runs."""
    marked = docs.join(F.broadcast(target.withColumn("good", F.lit(1))), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets, np.int64)
        for b in W.slices(batches):
            row, bucket = _features(W.words(b.column(0)), buckets)
            good = b.column(1).to_numpy()[row].astype(bool)
            total[:buckets] += np.bincount(bucket, minlength=buckets)
            total[buckets:] += np.bincount(bucket[good], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = marked.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2 x buckets rows at most
    total = np.zeros(2 * buckets, np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total[:buckets], total[buckets:]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) by bucket, of smoothed shares; 0 without target text."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 7) -> DataFrame:
    """One row per document row: doc_id, n_ngrams, log_weight, gumbel, tie."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            w = W.words(b.column(1))
            row, bucket = _features(w, len(shared.value))
            weight = np.bincount(row, weights=shared.value[bucket], minlength=w.rows).astype(float)
            yield pa.record_batch([b.column(0), pa.array(np.bincount(row, minlength=w.rows)), pa.array(weight), b.column(2)], ["doc_id", "n_ngrams", "log_weight", "tie"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, n_ngrams long, log_weight double, tie long")
    draw = F.xxhash64(F.lit(seed), "doc_id", "tie")
    uniform = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return rows.withColumn("gumbel", -F.log(-F.log(uniform)))


def _cut(rows: DataFrame, k: int) -> tuple[float, int]:
    """(the k-th largest key, how many rows of that key are of the k largest)."""
    low, high, left = -math.inf, math.inf, k
    while low < high:
        inside = rows.where(F.col("key").between(low, high))
        found = inside.approxQuantile("key", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
        edges = sorted({e for x in found for e in (x, math.nextafter(x, math.inf))})  # so a frequent key is a range of its own
        ranges = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="key", outputCol="range").transform(inside)
        counts = ranges.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # 2 x RANGES rows at most
        for r in sorted(counts, key=lambda r: -r.range):
            low, high = r.low, r.high
            if r.n >= left:
                break
            left -= r.n
    return low, left


def _largest(rows: DataFrame, k: int) -> DataFrame:
    """rows with kept: is it of the k largest keys. Only equal rows at the cut are told apart, by their numbers."""
    cut, left = _cut(rows, k)
    own = [c for c in rows.columns]
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    equal = rows.where(F.col("key") == cut).groupBy(*own).agg(F.count("*").alias("n"))  # few: the noise differs by id and text
    equal = equal.withColumn("wanted", F.lit(left) - F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = equal.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RANGES)))).repartition("first")
    again = parts.withColumn("place", F.explode(F.sequence("first", F.least("n", F.col("first") + RANGES) - 1)))
    return rows.where(F.col("key") != cut).withColumn("kept", F.col("key") > cut).unionByName(again.select(*own, (F.col("place") < F.col("wanted")).alias("kept")))


def resample(docs: DataFrame, labels: DataFrame, keep: float = 0.5, sample: int = SAMPLE, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document row: doc_id, n_ngrams, log_weight, score (mean log ratio of its n-grams), kept.

    kept marks ceil(keep x rows) documents.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    target = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    raw, wanted = _count(docs, target, buckets)
    rows = materialize(weigh(docs, log_ratio(raw, wanted), seed), "weights").withColumn("key", F.col("log_weight") + F.col("gumbel"))
    n = rows.count()
    if not n:
        return rows.select("doc_id", "n_ngrams", "log_weight", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    return _largest(rows, math.ceil(keep * n)).select("doc_id", "n_ngrams", "log_weight", F.when(F.col("n_ngrams") > 0, F.col("log_weight") / F.col("n_ngrams")).otherwise(0.0).alias("score"), "kept")
