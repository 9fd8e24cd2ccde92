"""Quality classifier: importance resampling with hashed n-gram models.

Words are parted into runs of word characters and runs of other marks, as in word-punctuation
tokenizers; unigrams and bigrams of these parts are hashed into BUCKETS buckets. Two bags of n-grams are
counted, one over all documents (raw) and one over labelled good ones (target), and a document's log weight is the sum of
log(target / raw) over its n-grams. Adding Gumbel noise and taking the k largest samples k documents without
replacement in proportion to their weights. The noise is a hash of doc_id, so a run can be repeated.

Target rows are at most `max_target` labelled documents, chosen by a hash of doc_id; both models' counts and the
sample cover all documents. k is found exactly: the keys are counted in ever narrower ranges, and only the last few are looked at.

Defined results: null and empty texts have log weight 0. Null doc_ids and repeated doc_ids share their noise; rows that tie with
the last in key and doc_id are all taken. Without target labels every log weight is 0. `fraction` of no rows is no rows.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, split_words, sums_by_row, text_slices, vocab_hashes

BUCKETS, MAX_TARGET, SEED = 10_000, 50_000, 20_230
PART = re.compile(r"\w+|[^\w\s]+")
BINS, LAST = 4096, 50_000


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of each text end to end, and offsets."""
    words = split_words(texts)
    found = [PART.findall(w) for w in words.vocab.to_pylist()]
    size = np.array([len(f) for f in found], np.int64)
    first = np.cumsum(size) - size
    part = vocab_hashes(pa.array([p for f in found for p in f], pa.string()))
    n = size[words.ids]
    flat = part[np.repeat(first[words.ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    rows = np.repeat(words.rows, n)
    same = rows[1:] == rows[:-1]
    two = mix64(mix64(flat[:-1][same]) + flat[1:][same])
    row = np.concatenate([rows, rows[1:][same]])
    order = np.argsort(row, kind="stable")
    bucket = (np.concatenate([flat, two]) % np.uint64(buckets)).astype(np.int64)[order]
    return bucket, np.searchsorted(row[order], np.arange(len(texts) + 1))


def target_ids(labels: DataFrame, max_target: int) -> DataFrame:
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id", F.lit(True).alias("is_target"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> np.ndarray:
    """log(target / raw) of each bucket, with one added to every count."""
    ids = target_ids(labels, max_target)  # bounded by max_target
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flag = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for start, texts in text_slices(batch.column("text")):
                bucket, offsets = ngram_buckets(texts, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[np.repeat(flag[start : start + len(texts)], np.diff(offsets))], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in sums.collect():  # one row a bucket
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_ngrams and log_weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                bucket, offsets = ngram_buckets(texts, len(ratios))
                doc_id = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(offsets)), pa.array(sums_by_row(ratios[bucket], offsets))], ["doc_id", "n_ngrams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ngrams long, log_weight double")


def gumbel(seed: int = SEED):
    """Standard Gumbel noise from a hash of doc_id."""
    uniform = (F.xxhash64("doc_id", F.lit(seed)).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(1 - 2.0**-50) + F.lit(2.0**-52)
    return -F.log(-F.log(uniform))


def kth_largest(keyed: DataFrame, k: int, bins: int = BINS, last: int = LAST) -> tuple[float, int | None]:
    """(key, doc_id) of the k-th row by falling key and rising doc_id, null ids last."""
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    rest = k
    while True:
        inside = keyed.where(F.col("key").between(low, high))
        width = (high - low) / bins
        if width == 0 or low + width == low or inside.count() <= last:
            break
        bin_of = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for r in counts:
            if r.n >= rest:
                break
            rest -= r.n
        if (r.lo, r.hi) == (low, high):
            break
        low, high = r.lo, r.hi
    order = [F.desc("key"), F.asc_nulls_last("doc_id")]
    if rest <= last:
        row = inside.orderBy(*order).limit(rest).orderBy(F.asc("key"), F.desc_nulls_first("doc_id")).first()
        return row.key, row.doc_id
    # many rows share one key: they differ in doc_id only
    ids = inside.select(F.col("doc_id").cast("double").alias("key"), "doc_id").where("doc_id IS NOT NULL")
    if ids.count() < rest:
        return low, None
    got = kth_largest(ids.select((-F.col("key")).alias("key"), "doc_id"), rest, bins, last)
    return low, got[1]


def label_share(labels: DataFrame) -> float:
    """Share of good documents among the labelled."""
    got = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return float(got or 0.0)


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, max_target: int = MAX_TARGET, seed: int = SEED) -> DataFrame:
    """The sampled documents: doc_id, n_ngrams, log_weight, key and kept (true). `fraction` defaults to the share of good labels."""
    ratios = log_ratios(docs, labels, buckets, max_target)
    keyed = materialize(log_weights(docs, ratios).withColumn("key", F.col("log_weight") + gumbel(seed)), "dsir")
    k = math.ceil(keyed.count() * (label_share(labels) if fraction is None else fraction))
    if k <= 0:
        return keyed.where("false").withColumn("kept", F.lit(True))
    key, doc_id = kth_largest(keyed, k)
    tie = F.lit(True) if doc_id is None else F.col("doc_id") <= F.lit(doc_id)
    return keyed.where((F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & tie)).withColumn("kept", F.lit(True))
