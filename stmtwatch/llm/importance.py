"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and pairs of words) are counted: one over all
documents, one over those labelled good. A document's log weight is the log ratio of the two
likelihoods. The sample is the top k of log weight plus Gumbel noise, which draws without
replacement by weight. The noise is a hash of key and text, so reruns agree.

The counts of both models cover all documents; a model is one number per bucket. Which documents
are good is read from at most `max_labels` labels, chosen by hash, which are broadcast.
The k-th largest value is found by narrowing histograms, so nothing is sorted in one place.

Nulls: a null or empty text has log weight 0; a null label or key is no label. Rows that are equal
in key and text stay or go together, so the sample may exceed k by them. Without good labels all
weights are 0. An empty table gives an empty sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import checkpointed, whole_text

BUCKETS = 1 << 14
MAX_LABELS = 50_000
# Without a given k, the sample is as large as the number of documents above this log weight.
LEAST_LOG_WEIGHT = -10.0
# Strength with which a bucket's ratio is drawn to 1, in n-grams per bucket.
SMOOTHING = 200.0

_TOKENS = re.compile(r"\w+|[^\w\s]+")


def hashed_ngrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and pairs of words of a text."""
    words = _TOKENS.findall(text.lower())
    one = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) >> np.uint64(20)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _good_ids(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """Keys labelled 1, of at most `limit` labels taken by hash."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).alias("_label")
    )
    some = known.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key", "_label").limit(limit)
    return some.groupBy("_key").agg(F.min("_label").alias("_label")).filter("_label = 1")


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    buckets: int = BUCKETS, max_labels: int = MAX_LABELS,
) -> np.ndarray:
    """Log ratio of the good to the raw model for every bucket."""
    good = F.broadcast(_good_ids(labels, key, label, max_labels))
    marked = docs.select(F.col(key).alias("_id"), whole_text(text).alias("text")).join(
        good, F.col("_id") == F.col("_key"), "left"
    ).select("text", F.col("_key").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for value, is_good in zip(batch.column(0), batch.column(1)):
                grams = np.bincount(hashed_ngrams(value.as_py(), buckets), minlength=buckets)
                raw += grams
                if is_good.as_py():
                    target += grams
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"]
        )

    counted = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counted.collect():  # one row per bucket at most
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not target.sum():
        return np.zeros(buckets)
    share = (raw + 1) / (raw + 1).sum()
    prior = SMOOTHING * buckets
    return np.log((target + prior * share) / (target.sum() + prior) / share)


def with_log_weight(docs: DataFrame, ratio: np.ndarray, text: str = "text", name: str = "log_weight") -> DataFrame:
    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        return pd.Series([float(ratio[hashed_ngrams(t, len(ratio))].sum()) for t in texts], dtype="float64")

    return docs.withColumn(name, log_weight(whole_text(text)))


def gumbel(key: str, text: str, seed: int = 0) -> Column:
    """Standard Gumbel noise that depends on key and text."""
    bits = F.pmod(F.xxhash64(F.col(key).cast("string"), whole_text(text), F.lit(seed)), F.lit(1 << 52))
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 1000) -> float:
    """The k-th largest value. Each round counts `bins` bins of the range that still holds it."""
    value = F.col(column)
    low, high = values.agg(F.min(value), F.max(value)).first()
    while True:
        inside = values.filter((value >= low) & (value <= high))
        width = (high - low) / bins
        if not width or low + width == low:
            return low
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ).collect()
        for row in sorted(counts, key=lambda r: -r.bin):
            if k <= row.n:
                low, high = row.low, row.high
                if row.n <= few:
                    left = values.filter((value >= low) & (value <= high)).select(column).collect()
                    return sorted((r[0] for r in left), reverse=True)[k - 1]
                break
            k -= row.n


def sample_threshold(scored: DataFrame, k: int | None = None) -> float:
    """The least `noisy` value of the sample. `scored` has log_weight and noisy."""
    total, above = scored.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("log_weight") > LEAST_LOG_WEIGHT, 1))
    ).first()
    k = above if k is None else min(k, total)
    return kth_largest(scored, "noisy", k) if k else float("inf")


def importance_sample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, key: str = "doc_id", text: str = "text",
    label: str = "quality", seed: int = 0,
) -> DataFrame:
    """One row per row of `docs`: the key, log_weight, noisy (the value that is ranked) and kept."""
    ratio = fit(docs, labels, key, text, label)
    scored = with_log_weight(docs.select(key, text), ratio, text).withColumn(
        "noisy", F.col("log_weight") + gumbel(key, text, seed)
    )
    scored = checkpointed(scored.select(key, "log_weight", "noisy"))
    return scored.withColumn("kept", F.col("noisy") >= F.lit(sample_threshold(scored, k)))


def sampled_documents(
    docs: DataFrame, labels: DataFrame, k: int | None = None, key: str = "doc_id", text: str = "text",
    label: str = "quality", seed: int = 0,
) -> DataFrame:
    """The rows of `docs` that the sample keeps."""
    ratio = fit(docs, labels, key, text, label)
    narrow = with_log_weight(docs.select(key, text), ratio, text)
    noisy = F.col("log_weight") + gumbel(key, text, seed)
    scored = checkpointed(narrow.select("log_weight", noisy.alias("noisy")))
    least = sample_threshold(scored, k)
    packed = docs.select(F.struct("*").alias("row"), F.col(key).alias("_k"), whole_text(text).alias("_t"))
    weighed = with_log_weight(packed, ratio, "_t").filter(F.col("log_weight") + gumbel("_k", "_t", seed) >= F.lit(least))
    return weighed.select("row.*")
