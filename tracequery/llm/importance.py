"""Importance resampling with hashed n-gram models.

Words and word pairs are hashed into ``buckets`` features.  The raw model is
their distribution over all documents, the target model that over labelled
good documents; the latter are a bounded sample (``target_docs`` rows with the
smallest hashes of their ids, whole texts), the former are all documents.
A document's log importance is the sum over its n-grams of the log ratio of
the two models.  Adding Gumbel noise, made from the document's id and text by
hashing, and keeping the largest keys samples documents without replacement in
proportion to their importance.  The threshold is found exactly from counts of
key ranges, finer from step to step, so nothing is sorted or gathered.

Defined results: a null text has no n-grams and log importance 0; equal rows
have equal keys, and rows with the key at the threshold are all taken; a
missing target (no good labels) makes all importances 0; null ids and labels
are ignored as labels; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

BUCKETS, TARGET_DOCS = 1 << 16, 5000
_SMOOTH = 1.0


def _features(block: tk.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a block's words and word pairs, and each one's text."""
    words = tk.Words(block.folded())
    at = words.whole(2)
    pair = words.grams(2, 4001)[at]
    key = np.concatenate([words.hash, pair])
    return (key % tk.U64(buckets)).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def count_features(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each feature occurs; each task adds up its own counts first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in tk.blocks(batch.column(0)):
                total += np.bincount(_features(block, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["feature", "n"])

    found = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(found.column("feature"))] = np.asarray(found.column("n"))
    return out


def target_sample(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> DataFrame:
    """Texts of at most ``target_docs`` labelled good documents."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    return docs.join(F.broadcast(picked), "doc_id", "left_semi")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> np.ndarray:
    raw = count_features(docs, buckets)
    target = count_features(target_sample(docs, labels, target_docs), buckets)
    if not target.sum():
        return np.zeros(buckets)
    p = (target + _SMOOTH) / (target.sum() + _SMOOTH * buckets)
    q = (raw + _SMOOTH) / (raw.sum() + _SMOOTH * buckets)
    return np.log(p / q)


def score(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_importance and gumbel_key for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def scored(batches):
        ratio = shared.value
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                feature, doc = _features(block, len(ratio))
                n = np.bincount(doc, minlength=block.n)
                total = np.bincount(doc, ratio[feature], minlength=block.n)
                noise = np.asarray(batch.column("row_hash"))[block.lo : block.hi].view(tk.U64)
                uniform = (tk.mix(noise ^ tk.constants(seed + 17, 1)) >> tk.U64(11)).astype(np.float64) + 0.5
                gumbel = -np.log(-np.log(uniform / float(1 << 53)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.lo, block.n), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(total + gumbel, pa.float64())], ["doc_id", "n_features", "log_importance", "gumbel_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    return rows.mapInArrow(scored, "doc_id long, n_features long, log_importance double, gumbel_key double")


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: counts of ever finer ranges, 512 at a time."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while True:
        step = (hi - lo) / 512
        inside = values.where(F.col(column).between(lo, hi))
        if not step or lo + step == lo or hi - step == hi:
            break
        bins = inside.groupBy(F.least(F.floor((F.col(column) - lo) / step), F.lit(511)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        above = values.where(F.col(column) > hi).count()
        for row in sorted(bins.collect(), reverse=True):
            if above + row.n >= k:
                break
            above += row.n
        lo, hi = row.lo, row.hi
        if lo == hi:
            return lo
    found = inside.groupBy(column).count().orderBy(F.desc(column)).collect()
    above = values.where(F.col(column) > hi).count()
    for value, count in found:
        above += count
        if above >= k:
            return value
    return found[-1][0]


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, seed: int = 0) -> DataFrame:
    """Every document with its log importance, key and whether it is among the top k.

    k is ``fraction`` of all documents; without it, the share of good labels.
    """
    scored = scratch.cut(score(docs, log_ratios(docs, labels, buckets, target_docs), seed), "importance-scored")
    if fraction is None:
        good, all_ = labels.agg(F.sum(F.when(F.col("quality") == 1, 1)), F.count("quality")).first()
        fraction = (good or 0) / all_ if all_ else 1.0
    k = round(fraction * scored.count())
    least = kth_largest(scored, "gumbel_key", k)
    picked = F.lit(False) if least is None else F.col("gumbel_key") >= least
    return scored.withColumn("selected", picked)
