"""Quality by importance resampling.

Two generative models of hashed word and word-pair counts are compared: one of texts labelled good (the target), one
of all texts (raw). A document's weight is the product over its n-grams of how much likelier the target is to produce
them. Documents are drawn without replacement in proportion to their weights: Gumbel noise is added to the log
weights and the largest ``share`` of all rows is kept.

The raw counts cover every document: tasks count into ``BUCKETS`` buckets, Spark adds up. The target is fitted on
at most ``TARGET_ROWS`` labelled rows (those with the smallest hash of their id). The log weight is a mean over
the n-grams times ``TEMPERATURE``, so that long documents are not weighed by their length alone.

The threshold of the top ``k`` is found by narrowing counts of the keys, never by sorting all of them.

Defined results: a null or empty text has log weight 0; rows that share an id share their noise, so equal rows
are kept or left together, and ties at the threshold go to the smaller id; without target rows all log weights are 0;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import Hasher, mix, record_batch, scratch, text_chunks, whole_texts
from cohortline.llm.mixing import uniform

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
TEMPERATURE = 200.0
SMOOTHING = 1.0
BINS = 4096
FEW_KEYS = 10_000
_U64 = np.uint64


def hashed_grams(hasher: Hasher, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word and every pair of neighbouring words."""
    _, _, hashes, first = hasher.words(offsets, data)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = owner[1:] == owner[:-1]
    pairs = mix(hashes[:-1] * _U64(0xA0761D6478BD642F) + hashes[1:])[pair]
    buckets = np.concatenate([hashes, pairs]) % _U64(BUCKETS)
    return np.concatenate([owner, owner[:-1][pair] if len(owner) else owner]), buckets.astype(np.int64)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; ``BUCKETS`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(lower=True), np.zeros(BUCKETS, np.int64)
        for _, offsets, data in text_chunks(batches):
            total += np.bincount(hashed_grams(hasher, offsets, data)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield record_batch(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), [used, total[used]])

    counted = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    out = np.zeros(BUCKETS)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def target_texts(docs: DataFrame, good: DataFrame, id_col: str) -> DataFrame:
    """The texts of at most ``TARGET_ROWS`` ids of ``good``."""
    ids = good.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct()
    picked = scratch(ids.orderBy(F.xxhash64("_id"), "_id").limit(TARGET_ROWS))
    texts = whole_texts(docs, id_col)
    return texts.join(F.broadcast(picked), texts[id_col] == picked["_id"], "left_semi")


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = [(counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS) for counts in (target, raw)]
    return np.log(smooth[0]) - np.log(smooth[1])


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str) -> DataFrame:
    """``id_col`` and ``log_weight`` per document."""
    kept = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for rows, offsets, data in text_chunks(batches):
            owner, buckets = hashed_grams(hasher, offsets, data)
            total = np.bincount(owner, weights=ratios[buckets], minlength=rows.num_rows)
            weight = TEMPERATURE * total / np.maximum(np.bincount(owner, minlength=rows.num_rows), 1)
            yield record_batch(pa.schema([(id_col, rows.column(0).type), ("log_weight", pa.float64())]), [rows.column(0), weight])

    return whole_texts(docs, id_col).mapInArrow(run, f"`{id_col}` {kept}, log_weight double")


def threshold(keyed: DataFrame, k: int, key: str, id_col: str) -> tuple[float, object] | None:
    """Key and id of the ``k``-th row by key (descending) and id; counts per bin close in on it."""
    low, high = keyed.agg(F.min(key), F.max(key)).first()
    inside, need = keyed, k
    while True:
        n = inside.count()
        if n <= max(FEW_KEYS, 1) or low == high:
            break
        width = (high - low) / BINS
        number = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        counts = inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for row in counts.orderBy(F.col("bin").desc()).collect():  # at most BINS rows
            if need <= row["n"]:
                break
            need -= row["n"]
        low, high = row["low"], row["high"]
        inside = keyed.filter(F.col(key).between(low, high))
    order = Window.orderBy(F.col(key).desc(), F.col(id_col).asc_nulls_last())
    last = inside.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == need).select(key, id_col).first()
    return None if last is None else (last[0], last[1])


def resample(docs: DataFrame, good: DataFrame, share: float = 0.85, seed: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``log_weight``, ``key`` (with noise) and ``kept`` per document; ``good`` lists ids of target documents."""
    texts = whole_texts(docs, id_col)
    ratios = log_ratios(gram_counts(target_texts(docs, good, id_col)), gram_counts(texts))
    noise: Column = -F.log(-F.log(uniform(F.col(id_col), seed)))
    keyed = scratch(log_weights(docs, ratios, id_col).withColumn("key", F.col("log_weight") + noise))
    k = round(share * keyed.count())
    at = threshold(keyed, k, "key", id_col) if k else None
    if at is None:
        return keyed.withColumn("kept", F.lit(False))
    tie = F.lit(True) if at[1] is None else F.coalesce(F.col(id_col) <= F.lit(at[1]), F.lit(False))
    return keyed.withColumn("kept", (F.col("key") > F.lit(at[0])) | ((F.col("key") == F.lit(at[0])) & tie))
