"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its words and the byte 3- and 4-grams inside its folded
words, with word marks, hashed into ``buckets`` rows of an embedding.  Their
mean goes through a linear softmax over the languages seen in training; both
are trained together by stochastic gradient descent.  Since prediction is
linear in the mean, the product of embedding and weights is what is shared.

Training uses a bounded sample: for each language the ``per_language``
documents with the smallest hash of their ids, and fewer where ``most`` divided
by the number of languages is less.  Whole texts become counts of features where
they are read, so a text of any length is at most ``buckets`` numbers, and texts
don't reach the driver.  A fifth of it is
set aside to fit one temperature, which calibrates the probabilities, and the
threshold below which predictions are marked as not accepted: the ``reject``
quantile of the probabilities of its right answers.

Defined results: ``und`` with score 0 for a null text and one without letters,
and for everything when there is nothing to learn from; repeated rows get
equal answers; null languages are not learned; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

BUCKETS, DIM, PER_LANGUAGE, MOST, REJECT = 1 << 15, 16, 600, 20_000, 0.005
UNKNOWN = "und"


def _features(block: tk.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block and each one's text."""
    data = tk.FOLD[block.data]
    words = tk.Words(tk.Block(block.lo, block.hi, data, block.offsets))
    # Each byte with its word's number; white space ends a gram, its neighbour marks the word's edge.
    inside = tk.SPACED[data]
    byte = np.where(inside, data, 0x20).astype(np.uint32)
    doc = np.repeat(np.arange(block.n), np.diff(block.offsets))
    keys, docs = [words.hash], [words.doc]
    packed = byte.copy()
    for k in range(2, 5):
        n = len(byte) - k + 1
        if n <= 0:
            break
        packed = packed[:n] << np.uint32(8) | byte[k - 1 :]
        if k < 3:
            continue
        good = doc[:n] == doc[k - 1 :]
        for j in range(1, k - 1):
            good &= inside[j : n + j]
        at = np.flatnonzero(good)
        x = packed[at].astype(tk.U64)
        keys.append((x + tk.U64(k)) * tk.U64(0x9E3779B97F4A7C15) >> tk.U64(20))
        docs.append(doc[at])
    return (np.concatenate(keys) % tk.U64(buckets)).astype(np.int32), np.concatenate(docs)


class Model:
    """Per-feature language scores, a bias, a temperature and the least accepted probability."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least

    def logits(self, block: tk.Block) -> np.ndarray:
        feature, doc = _features(block, len(self.table))
        n = np.maximum(np.bincount(doc, minlength=block.n), 1)
        sums = np.stack([np.bincount(doc, self.table[feature, c], minlength=block.n) for c in range(len(self.langs))], axis=1)
        return sums / n[:, None] + self.bias

    def predict(self, block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its calibrated probability."""
        z = self.logits(block) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 6, rate: float = 8.0, reject: float = REJECT, seed: int = 0) -> Model | None:
    """Trains on bags of (different features, how often each occurs)."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    y = np.array([names.index(v) for v in langs])[order]
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weights, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    held = len(bags) // 5
    # Features and their shares.
    kinds = [(u, c / max(1, c.sum())) for u, c in (bags[i] for i in order)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(np.arange(held, len(bags))):
            u, c = kinds[i]
            if not len(u):
                continue
            mean = c @ table[u]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            toward = weights @ p
            weights -= 0.1 * step * np.outer(mean, p)
            bias -= 0.01 * step * p
            table[u] -= step * np.outer(c, toward)
    model = Model(names, (table @ weights).astype(np.float32), bias)
    if held:
        z = np.array([c @ model.table[u] + bias if len(u) else bias for u, c in kinds[:held]])
        best = (np.inf, 1.0)
        for t in np.geomspace(0.25, 20, 60):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(held), y[:held]]).mean())
            best = min(best, (loss, float(t)))
        model.temperature = best[1]
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y[:held]
        model.least = float(np.quantile(p.max(axis=1)[right], reject)) if right.any() else 0.0
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> DataFrame:
    """text and lang of at most ``per_language`` documents for each language and about ``most`` altogether; ids order the draw and are not features."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    per_language = max(1, min(per_language, most // max(1, known.select("lang").distinct().count())))
    draw = F.xxhash64("doc_id", F.lit(5))
    # Only ids whose hash lies in the share that should give twice the sample meet in a language's window.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    near = known.select("doc_id", "lang", draw.alias("draw")).join(sizes, "lang")
    near = near.where((F.col("draw") / float(1 << 64) + 0.5) * F.col("size") <= 2.0 * per_language + 50)
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("place") <= per_language)
    # Written, so that its size is known when the join with the texts is planned.
    picked = scratch.cut(best.select(F.col("doc_id").alias("picked_id"), F.col("lang").alias("picked_lang")).coalesce(1), "language-sample")
    return known.join(picked, (F.col("doc_id") == F.col("picked_id")) & (F.col("lang") == F.col("picked_lang")), "left_semi").select("text", "lang")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST, buckets: int = BUCKETS, **settings) -> Model | None:
    def bagged(batches):
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                feature, doc = _features(block, buckets)
                by = np.argsort(doc, kind="stable")
                bags = [np.unique(b, return_counts=True) for b in np.split(feature[by], np.cumsum(np.bincount(doc, minlength=block.n))[:-1])]
                features, counts = ([x.astype(np.int32).tobytes() for x in column] for column in zip(*bags, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(block.lo, block.n), pa.array(features, pa.binary()), pa.array(counts, pa.binary())], ["lang", "features", "counts"])

    bags = sample(docs, per_language, most).mapInArrow(bagged, "lang string, features binary, counts binary")
    rows = sorted((r.lang, bytes(r.features), bytes(r.counts)) for r in bags.toLocalIterator())
    return fit([(np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for _, f, c in rows], [v for v, _, _ in rows], buckets, **settings)


def _lettered(block: tk.Block) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    found = np.concatenate([[0], np.cumsum(ascii_letter[block.data])])
    out = found[block.offsets[1:]] > found[block.offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in block.text(i).decode())
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each document; only text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches):
        m = shared.value
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                if m is None:
                    langs, p = [UNKNOWN] * block.n, np.zeros(block.n)
                else:
                    best, p = m.predict(block)
                    lettered = _lettered(block)
                    langs = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                    p = np.where(lettered, np.clip(p, 0, 1), 0.0)
                good = p >= m.least if m else np.zeros(block.n, bool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.lo, block.n), pa.array(langs, pa.string()), pa.array(p, pa.float64()), pa.array(good & (p > 0))], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(named, "doc_id long, lang_pred string, score double, accepted boolean")
