"""Benchmark decontamination by winnowing.

Texts are folded (A-Z to a-z) and cut into words of digits, letters and
characters beyond ASCII.  A window is ``window`` consecutive words of one
benchmark item; an item with fewer words, but not none, is one window.

Winnowing keeps, for each run of ``window`` words, the smallest hash of its
k-word grams.  Equal runs keep equal hashes, so joining document fingerprints
with benchmark fingerprints meets every shared run of ``window`` words; each
meeting is then extended to the whole window and looked up among the item
windows.  Items shorter than a window have their own exact table by length.

The index of one benchmark block has a fixed bound (``block_words``).  A
larger benchmark is cut into several blocks, by item; the driver holds one of
them at a time, each scans the documents, only hit places move and are written,
and they are merged by document.  An item longer than a block is a block of its
own.

Defined results: a null text, or one without words, has no hits; repeated rows
are judged one by one; a text of any length is judged whole; an empty benchmark
hits nothing; items without words are ignored; repeated items count once by id.
Item ids may be of any type and are told as strings; windows of items without
an id hit words as others do, and all these items count as one, without a name.
Document ids are whole numbers or null; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

WINDOW, GRAM = 13, 5
BLOCK_WORDS = 1_000_000
_SEED, _SEED_GRAM = 1009, 1013


def _minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each ``width`` consecutive ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, tk.U64)
    out = grams[:n].copy()
    for j in range(1, width):
        np.minimum(out, grams[j : n + j], out=out)
    return out


class Index:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        #: Item ids in the order of strings, none last; windows know their item's number.
        self.names = sorted({i for i, _ in items}, key=lambda i: (i is None, i))
        number = {name: n for n, name in enumerate(self.names)}
        by_length: dict[int, list[np.ndarray]] = {}
        fingerprints = [np.zeros(0, tk.U64)]
        for block in tk.blocks(pa.array([t for _, t in items], pa.large_string())):
            words = tk.Words(block.folded(), tk.FOLDED)
            owner = np.array([number[i] for i, _ in items[block.lo : block.hi]], np.int64)
            at = words.whole(window)
            if len(at):
                by_length.setdefault(window, []).append(np.stack([words.grams(window, _SEED)[at], owner[words.doc[at]].view(tk.U64)]))
                fingerprints.append(_minima(words.grams(gram, _SEED_GRAM), window - gram + 1)[at])
            for n in range(1, window):
                docs = np.flatnonzero(words.counts == n)
                if len(docs):
                    h = words.grams(n, _SEED)[words.first[docs]]
                    by_length.setdefault(n, []).append(np.stack([h, owner[docs].view(tk.U64)]))
        self.fingerprints = np.unique(np.concatenate(fingerprints))
        self.tables = {}
        for n, found in by_length.items():
            table = np.unique(np.concatenate(found, axis=1), axis=1)
            self.tables[n] = (table[0], table[1].view(np.int64))

    def _among(self, values: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        at = np.searchsorted(table, values)
        at[at == len(table)] = 0
        return table[at] == values

    def _candidates(self, words: tk.Words) -> np.ndarray:
        """Starts of windows whose kept fingerprint is a benchmark fingerprint."""
        minima = _minima(words.grams(self.gram, _SEED_GRAM), self.window - self.gram + 1)
        if not len(minima):
            return np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
        met = self._among(minima[new], self.fingerprints)
        at = np.flatnonzero(np.repeat(met, np.diff(np.append(new, len(minima)))))
        return at[words.doc[at] == words.doc[at + self.window - 1]]

    def matches(self, words: tk.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, starts of hit windows, text and item of each window's items), for each window length."""
        for n, (table, owner) in self.tables.items():
            if n == self.window:
                at = self._candidates(words)
                with np.errstate(over="ignore"):
                    h = np.zeros(len(at), tk.U64)
                    for j, m in enumerate(tk.constants(_SEED, n)):
                        h += words.hash[at + j] * m
                    h = tk.mix(h)
            else:
                at = words.whole(n)
                h = words.grams(n, _SEED)[at]
            lo = np.searchsorted(table, h, "left")
            size = np.searchsorted(table, h, "right") - lo
            hit = size > 0
            at, lo, size = at[hit], lo[hit], size[hit]
            yield n, at, np.repeat(words.doc[at], size), owner[np.repeat(lo, size) + tk.ragged(size)]


def _judged(block: tk.Block, index: Index) -> tuple[tk.Words, np.ndarray, list[list[str | None]]]:
    """Words of a block, which of them are hit, and the items met by each text."""
    words = tk.Words(block.folded(), tk.FOLDED)
    hit = np.zeros(len(words.hash), bool)
    pairs = []
    for n, at, doc, item in index.matches(words):
        hit |= tk.covered(len(hit), at, n)
        pairs.append(np.stack([doc, item]))
    items: list[list[str | None]] = [[] for _ in range(block.n)]
    if pairs:
        for d, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
            items[d].append(index.names[i])
    return words, hit, items


def _per_text(words: tk.Words, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.first[1:]] - total[words.first[:-1]]


def _items(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """(item_id, text, block) of items with text, and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and the gap after it take two bytes at least.
    n = max(1, -(-size // (2 * block_words)))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _index(items: DataFrame, block: int, window: int, gram: int) -> Index:
    return Index([tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").collect()], window, gram)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (ids of met items as strings, ascending, null last)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, n = _items(benchmark, block_words)
    if n > 1:
        return _scan_blocks(docs, items, n, window, gram)
    shared = spark.sparkContext.broadcast(_index(items, 0, window, gram))

    def judge(batches):
        index = shared.value
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                words, hit, met = _judged(block, index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, block.n), pa.array(words.counts, pa.int64()), pa.array(_per_text(words, hit), pa.int64()), pa.array(met, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return docs.mapInArrow(judge, "doc_id long, n_words long, n_hit long, items array<string>")


def _scan_blocks(docs: DataFrame, items: DataFrame, n: int, window: int, gram: int) -> DataFrame:
    """The same for a benchmark of several blocks: hit places of each block are written, and meet by row."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    parts = None
    for number in range(n):
        shared = spark.sparkContext.broadcast(_index(items, number, window, gram))

        def ranges(batches, shared=shared):
            for batch in batches:
                for block in tk.blocks(batch.column("text")):
                    words, hit, met = _judged(block, shared.value)
                    keys = np.asarray(batch.column("row_key"))[block.lo : block.hi]
                    rows = [i for i in range(block.n) if met[i]]
                    places = [np.flatnonzero(hit[words.first[i] : words.first[i + 1]]).tolist() for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows], pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array([met[i] for i in rows], pa.list_(pa.string()))], ["row_key", "places", "items"])

        part = scratch.cut(keyed.mapInArrow(ranges, "row_key long, places array<long>, items array<string>"), f"decontaminate-{number}")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("row_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def count(batches):
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                words = tk.Words(block.folded(), tk.FOLDED)
                keep = [batch.column(c).slice(block.lo, block.n) for c in ("doc_id", "row_key")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(words.counts, pa.int64())], ["doc_id", "row_key", "n_words"])

    counted = keyed.mapInArrow(count, "doc_id long, row_key long, n_words long")
    none = F.array().cast("array<string>")
    return counted.join(merged, "row_key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def contaminated(n_hit, n_words):
    """The contamination rule: one hit word in twenty at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the contaminated ones; columns and row contents stay as they are."""
    spark = docs.sparkSession
    items, n = _items(benchmark, block_words)
    if n > 1:
        # A row key, since ids may repeat; equal rows have equal verdicts.
        key = F.xxhash64("doc_id", "text")
        bad = scan(docs.withColumn("doc_id", key), benchmark, window, gram, block_words).where(contaminated(F.col("n_hit"), F.col("n_words")))
        name = "__tq_row_key"
        return docs.withColumn(name, key).join(bad.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").drop(name)
    shared = spark.sparkContext.broadcast(_index(items, 0, window, gram))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for block in tk.blocks(batch.column(at)):
                words, hit, _ = _judged(block, shared.value)
                good = ~contaminated(_per_text(words, hit), words.counts)
                yield batch.slice(block.lo, block.n).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
