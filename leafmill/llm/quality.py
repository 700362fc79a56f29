"""Importance resampling towards target text.

Texts are bags of hashed words and pairs of words in ``BUCKETS`` buckets. A bucket's probability under the target model
comes from labelled target rows, under the raw model from all documents, both with add-one smoothing. A text's weight is
the sum of the log ratios of its n-grams; the sample is the k rows with the largest weight plus Gumbel noise, which draws without
replacement in proportion to the weights. k is a share of all rows, by default the share of label 1 among labelled rows.

The target model is fitted on at most ``max_docs`` labelled rows (lowest hash of doc_id first). The k-th key is found by
counting keys in ever narrower ranges, so no rows are gathered. Noise comes from the hash of doc_id and text; rows that
tie with the k-th (repeated rows) are all kept. Null and empty texts weigh 0. Without target rows all ratios are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import hashed, pairs

BUCKETS = 10_000


def _features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts, the buckets of all their n-grams, and the text of each."""
    for begin, stop in common.groups_of([len(t) for t in texts], 4_000_000):
        h, offsets = hashed(texts[begin:stop])
        own = np.repeat(np.arange(stop - begin), np.diff(offsets))
        inner = np.ones(len(h), bool)
        inner[offsets[:-1][offsets[:-1] < len(h)]] = False
        yield begin, stop, (np.concatenate([h, pairs(h)[inner]]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([own, own[inner]])


def counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """n-grams of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for *_, buckets, _ in _features(common.values(batch.column(0))):
                total += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], ["bucket", "n"])

    rows = docs.select(common.text_bytes(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 20_000) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of label 1."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = one.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    sample = one.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id")
    target = docs.join(F.broadcast(sample), "doc_id", "left_semi")  # at most max_docs ids
    t, r = counts(target) + 1, counts(docs) + 1
    if t.sum() == BUCKETS:
        return np.zeros(BUCKETS), share or 0.0
    return np.log(t / t.sum()) - np.log(r / r.sum()), share or 0.0


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight and the perturbed key of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    # a uniform number in (0, 1) of the row, then Gumbel
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select("doc_id", common.text_bytes().alias("text"), (-F.log(-F.log(uniform))).alias("gumbel"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = common.values(batch.column(1))
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for begin, stop, buckets, row in _features(texts):
                n[begin:stop] = np.bincount(row, minlength=stop - begin)
                weight[begin:stop] = np.bincount(row, own[buckets], minlength=stop - begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + batch.column(2).to_numpy())], ["doc_id", "n_grams", "log_weight", "key"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_grams long, log_weight double, key double")


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (from 1), by histograms of ever narrower ranges; None if there are fewer rows."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    while low < high:
        step = (high - low) / 4096
        if not step or low + step == low:
            break
        cell = F.least(F.floor((F.col(column) - low) / step), F.lit(4095))
        inside = rows.where(F.col(column).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("cell")).collect()
        for r in inside:
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The sample: doc_id, n_grams, log_weight, key of the rows drawn."""
    ratio, known = fit(docs, labels)
    weighed = common.stage(weigh(docs, ratio), "weights")
    least = kth_largest(weighed, "key", round((known if share is None else share) * weighed.count()))
    return weighed.where(F.lit(False) if least is None else F.col("key") >= least)
