"""Quality selection by importance resampling.

Two generative models count hashed byte n-grams (n = 4): the target model those of documents labelled as good, the raw model
those of all documents.  A document's log weight is the sum of log(target / raw) over its n-grams.  Weight plus
Gumbel noise (from a hash of the id) is its key, and the documents with the k largest keys are a sample
without replacement in proportion to the weights.

k is the number of documents whose log weight exceeds a cut that is fitted on labelled rows.  Model and cut are fitted on at most
``LABELLED`` labelled documents (smallest hashes of their ids); raw counts, weights, noise and selection cover all documents.

Counts leave a task as one vector of fixed length; the k-th key is found by counting in ever narrower bins.

Cases: null and empty texts and texts of less than 4 bytes have log weight 0; labels that are null or contradict each other are
not used; without usable labels of both kinds every document is kept; documents that tie at the k-th key are all kept; rows that
repeat an id and a text share a key; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .word_arrays import pieces

N = 4
BUCKETS = 1 << 16
LABELLED = 20_000
#: A lost good document weighs as much as so many kept bad ones when the cut is chosen.
GOOD_COSTS = 4
SMOOTH = 0.5
BINS = 1_000


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram at every byte; BUCKETS where it would leave its text."""
    padded = np.append(data, np.zeros(N - 1, np.uint8)).astype(np.uint32)
    value = padded[:len(data)].copy()
    for i in range(1, N):
        value |= padded[i:i + len(data)] << np.uint32(8 * i)
    out = ((value * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    for i in range(1, N):
        beyond = offsets[1:] - i
        out[beyond[beyond >= offsets[:-1]]] = BUCKETS
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    target, raw = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        good = batch.column("good").fill_null(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in pieces(batch.column("text")):
            grams = _grams(data, offsets)
            raw += np.bincount(grams, minlength=BUCKETS + 1)
            if good[a:b].any():
                target += np.bincount(grams[np.repeat(good[a:b] == 1, np.diff(offsets))], minlength=BUCKETS + 1)
    some = np.flatnonzero(raw[:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = np.append(ratio, 0.0)
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column("text")):
            total = np.concatenate([[0.0], np.cumsum(table[_grams(data, offsets)])])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("h").slice(a, b - a), batch.column("good").slice(a, b - a),
                                              pa.array(total[offsets[1:]] - total[offsets[:-1]])], ["id", "h", "good", "log_weight"])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int = LABELLED) -> DataFrame:
    """At most ``most`` ids with one agreed label each."""
    clear = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    clear = clear.agg(F.min(label_col).alias("good"), F.max(label_col).alias("_most")).where("good = _most").drop("_most")
    return clear.orderBy(F.xxhash64("id"), "id").limit(most)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least cost: good documents at or below it, bad ones above."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g == 1, GOOD_COSTS, 0))]) + np.concatenate([[0], np.cumsum(g != 1)])[-1] - np.concatenate([[0], np.cumsum(g != 1)])
    ends = np.concatenate([[w[0] - 2.0], w, [w[-1] + 2.0]])
    allowed = ends[1:] > ends[:-1]  # a cut can't part equal weights
    at = int(np.argmin(np.where(allowed, cost, np.iinfo(np.int64).max)))
    return float((ends[at] + ends[at + 1]) / 2)


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting in bins that narrow round it."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while high > low:
        width = (high - low) / BINS
        if low + width <= low:
            break
        within = values.where((F.col(column) >= low) & (F.col(column) <= high))
        found = within.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.col("bin").desc()).collect()  # BINS rows at most
        for row in found:
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
    return low


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 13) -> DataFrame:
    """Per row: id, log_weight, gumbel_key, kept; with the text's hash as text_hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = F.broadcast(stage(labelled_sample(labels, id_col, label_col), "labelled"))  # at most LABELLED rows
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).join(sample, "id", "left").select("id", "h", F.col("good").cast("int").alias("good"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_counts, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()  # BUCKETS rows at most
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, t, r in counted:
        target[bucket], raw[bucket] = t, r
    ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    weighed = rows.mapInArrow(lambda it: _weigh(it, shared.value), f"id {kind}, h long, good int, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("id", "h", F.lit(seed)), 11) + 0.5) / float(2**53)
    weighed = stage(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    known = weighed.where("good IS NOT NULL").select("log_weight", "good").limit(2 * LABELLED).toPandas()
    if known["good"].nunique() < 2:
        return weighed.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "log_weight", "gumbel_key", F.lit(True).alias("kept"))
    cut = best_cut(known["log_weight"].to_numpy(), known["good"].to_numpy())
    k = weighed.where(F.col("log_weight") > cut).count()
    least = kth_largest(weighed, "gumbel_key", k) if k else float("inf")
    return weighed.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "log_weight", "gumbel_key", (F.col("gumbel_key") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the sample keeps; columns as given."""
    gone = importance(docs, labels, id_col, text_col, label_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_h")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_h"))
    return docs.join(gone, same, "left_anti")
