"""Exact n-gram Jaccard join in metric space: pivots, Voronoi cells, triangle windows.

1 - Jaccard is a metric.  Documents with equal shingle sets are one class.  A
first exchange by shingle tells every class which of its shingles others have;
a class that shares less than the threshold of its shingles links with none.

Pivots: the shingles of a class, rarest first, are cut to the prefix that any
linked class must meet.  Each prefix shingle elects the least class that has
it as its pivot.  A class belongs to the cells of all pivots its prefix
elects: linked classes share a prefix shingle, so they share a cell, and
boundary classes are replicated to several.  Within a cell the exact
distances to the pivot are known; classes in its ball are linked with it, and
two classes can only be linked if their distances differ by no more than the
radius.  Cells are cut recursively by further pivots: each class goes to the
nearest one's Voronoi cell and is replicated to every cell whose pivot is no
more than two radii farther, until cells are small, and pairs are compared
exactly.  A pair that earlier links already connect isn't compared again.

A cell with more than ``block_bytes`` of shingles or ``block_size`` members is
cut into blocks, each a task that measures the distances to the pivot.  Its
members are then dealt by distance, in rings a quarter of the radius wide, and
rings into chunks.  By the triangle inequality only rings within a radius of
each other can hold linked classes; chunks of such rings meet, two in a task,
unless both lie in the pivot's ball, which is connected already.  So no task
holds more than two chunks.

What moves is packed.  A shingle that a task meets in many classes is sent
once, as a mark, and its classes are told by the task itself, so a shingle of
a third of all documents is a few entries for each task.

Defined results: words are separated by ASCII white space, with A-Z folded; a
text of fewer words than a shingle is one shingle; null and empty texts have
none and link with nothing; rows that share an id are judged each, and give
their common id to their components; a null id is not a component's name
unless it has no other; an empty table gives no rows; extra columns are kept
by ``keep_one`` and not read by ``join``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk
from .components import components

SHINGLE, PERCENT = 5, 80
BLOCK_SIZE, BLOCK_BYTES = 500, 4_000_000
_SEED, _SEED_BLOCK = 5003, 5009
#: Classes of one task that make a shingle frequent, and the rank of frequent ones.
_MANY, _FREQUENT = 8, 255
_HASH_BYTES = 7
_PACKED = "key int, kind int, classes binary, counts binary, hashes binary, ranks binary"


def _need(n, percent: int):
    """The least shared shingles a set of size n needs for a link."""
    return -(-n * percent // 100)


def shingles(block: tk.Block, k: int):
    """Distinct shingles of each text: text number, hash, block hash; sorted by text and hash."""
    words = tk.Words(block.folded())
    at = words.whole(k)
    h, other, doc = [words.grams(k, _SEED)[at]], [words.grams(k, _SEED_BLOCK)[at]], [words.doc[at]]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            first = words.first[short]
            h.append(words.grams(n, _SEED)[first])
            other.append(words.grams(n, _SEED_BLOCK)[first])
            doc.append(short)
    h, other, doc = np.concatenate(h), np.concatenate(other), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, other, doc = h[order], other[order], doc[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[once], h[once], other[once]


def set_classes(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of n texts' sets and a hash of each set, which is also made of its size; 0 for empty ones."""
    size = np.bincount(doc, minlength=n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, tk.U64)
        np.cumsum(tk.mix(h ^ tk.constants(5011, 1)), out=total[1:])
        bounds = np.concatenate([[0], np.cumsum(size)])
        cls = tk.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ tk.mix(size.astype(tk.U64)))
    cls[cls == 0] = 1
    return size, np.where(size > 0, cls, tk.U64(0))


def _pack(key, kind, cls, size, h, rank=None) -> pa.RecordBatch:
    """Entries sorted by key and class, one packed row for each key."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    classes, counts, hashes, ranks = [], [], [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        c = cls[lo:hi]
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        classes.append(c[heads].tobytes() + tk.planes(size[lo:hi][heads].astype(np.uint32)))
        counts.append(tk.planes(np.diff(np.append(heads, hi - lo)).astype(np.uint32)))
        hashes.append(np.ascontiguousarray(h[lo:hi].view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes())
        ranks.append(None if rank is None else rank[lo:hi].astype(np.uint8).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(key[cuts[:-1]], pa.int32()), pa.array([kind] * len(classes), pa.int32()), *(pa.array(x, pa.binary()) for x in (classes, counts, hashes, ranks))],
        ["key", "kind", "classes", "counts", "hashes", "ranks"],
    )


def _unpack(rows: list[dict]):
    cls, size, h, rank = [], [], [], []
    for r in rows:
        counts = tk.unplanes(r["counts"], np.uint32).astype(np.int64)
        n = len(counts)
        cls.append(np.repeat(np.frombuffer(r["classes"][: 8 * n], tk.U64), counts))
        size.append(np.repeat(tk.unplanes(r["classes"][8 * n :], np.uint32), counts).astype(np.int64))
        wide = np.zeros((int(counts.sum()), 8), np.uint8)
        wide[:, :_HASH_BYTES] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, _HASH_BYTES)
        h.append(wide.view(tk.U64).ravel())
        if r["ranks"] is not None:
            rank.append(np.frombuffer(r["ranks"], np.uint8))
    return np.concatenate(cls), np.concatenate(size), np.concatenate(h), np.concatenate(rank) if rank else None


def _target(cls: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(cls) % tk.U64(n)).astype(np.int64)


def send_block(block: tk.Block, k: int, n_blocks: int, n_targets: int):
    """Packed (class, shingle) entries of a text block; classes of shingles that many of them have are told at once."""
    doc, h, other = shingles(block, k)
    size, cls = set_classes(doc, h, block.n)
    # Equal sets are sent once.
    first = np.zeros(block.n, bool)
    first[np.unique(cls, return_index=True)[1]] = True
    keep = first[doc]
    doc, h, other = doc[keep], h[keep], other[keep]
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    hs = h[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(head) - 1
    many = np.zeros(len(h), bool)
    many[order] = (np.bincount(group) >= _MANY)[group]
    marks = np.unique(np.where(many, np.arange(len(h)), -1)[order][head])
    marks = marks[marks >= 0]
    sent = np.flatnonzero(~many)
    c = np.concatenate([np.zeros(len(marks), tk.U64), cls[doc[sent]]])
    n = np.concatenate([np.zeros(len(marks), np.int64), size[doc[sent]]])
    at = np.concatenate([marks, sent])
    key = (other[at] % tk.U64(n_blocks)).astype(np.int64)
    by = np.argsort(key, kind="stable")
    yield _pack(key[by], 0, c[by], n[by], h[at][by])
    told = np.flatnonzero(many)
    if len(told):
        c = cls[doc[told]]
        key = _target(c, n_targets)
        by = np.argsort(key, kind="stable")
        yield _pack(key[by], 1, c[by], size[doc[told]][by], h[told][by], np.full(len(told), _FREQUENT))


def share(rows: list[dict], n_targets: int) -> pa.RecordBatch:
    """Of one shingle block, the entries of shingles that two classes or more have, ranked by their number."""
    cls, size, h, _ = _unpack(rows)
    order = np.lexsort((cls, h))
    cls, size, h = cls[order], size[order], h[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
    cls, size, h = cls[once], size[once], h[once]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(head) - 1
    frequent = (cls[head] == 0)[group]
    rank = np.where(frequent, _FREQUENT, np.minimum(np.bincount(group)[group], _FREQUENT - 1))
    met = np.flatnonzero((rank > 1) & (cls != 0))
    key = _target(cls[met], n_targets)
    by = met[np.lexsort((cls[met], key))]
    return _pack(_target(cls[by], n_targets), 1, cls[by], size[by], h[by], rank[by])


def candidates_of(rows: list[dict], percent: int) -> pa.RecordBatch:
    """Classes of a target that share enough: class, size, shared shingles, prefix shingles."""
    cls, size, h, rank = _unpack(rows)
    order = np.lexsort((h, rank, cls))
    cls, size, h = cls[order], size[order], h[order]
    once = np.ones(len(h), bool)
    # A shingle has one rank only, so equal ones are neighbours.
    once[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
    cls, size, h = cls[once], size[once], h[once]
    heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    counts = np.diff(np.append(heads, len(cls)))
    n_prefix = counts - _need(size[heads], percent) + 1
    good = np.flatnonzero(n_prefix > 0)
    sets, prefixes = [], []
    for i in good.tolist():
        lo, n = heads[i], counts[i]
        prefixes.append(h[lo : lo + n_prefix[i]].view(np.int64))
        sets.append(np.sort(h[lo : lo + n]).tobytes())
    offsets = np.concatenate([[0], np.cumsum(n_prefix[good])]).astype(np.int32)
    flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(cls[heads[good]].view(np.int64)), pa.array(size[heads[good]]), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
        ["cls", "size", "shared", "prefix"],
    )


class Cell:
    """Sets of a cell as one ragged array of shingle numbers."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, shared: list[bytes], percent: int):
        self.names, self.sizes, self.percent = names, sizes, percent
        self.counts = np.array([len(s) // 8 for s in shared], np.int64)
        flat = np.frombuffer(b"".join(shared), tk.U64)
        kinds, self.flat = np.unique(flat, return_inverse=True)
        self.ends = np.cumsum(self.counts)
        self.marked = np.zeros(len(kinds), bool)
        self.group = np.arange(len(names))
        self.links: list[tuple[int, int]] = []

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shared shingles of i and each of others."""
        own = self.flat[self.ends[i] - self.counts[i] : self.ends[i]]
        self.marked[own] = True
        counts = self.counts[others]
        at = np.repeat(self.ends[others] - counts, counts) + tk.ragged(counts)
        total = np.concatenate([[0], np.cumsum(self.marked[self.flat[at]])])
        ends = np.cumsum(counts)
        self.marked[own] = False
        return total[ends] - total[ends - counts]

    def measure(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact links and distances of i to others."""
        both = self.common(i, others)
        either = self.sizes[i] + self.sizes[others] - both
        return 100 * both >= self.percent * either, 1 - both / either

    def connect(self, i: int, others: np.ndarray):
        for j in others.tolist():
            a, b = self.group[i], self.group[j]
            if a != b:
                self.group[self.group == b] = a
                self.links.append((i, j))

    def compare(self, left: np.ndarray, right: np.ndarray, d_left: np.ndarray, d_right: np.ndarray):
        """All pairs of left and right that windows and earlier links leave open; d_*: distances to common pivots."""
        radius = 1 - self.percent / 100 + 1e-9
        for i, d in zip(left.tolist(), d_left, strict=True):
            near = (np.abs(d_right - d) <= radius).all(axis=1)
            near &= (100 * self.sizes[right] >= self.percent * self.sizes[i]) & (100 * self.sizes[i] >= self.percent * self.sizes[right])
            others = right[near]
            others = others[(self.group[others] != self.group[i]) & (self.names[others] != self.names[i])]
            if len(others):
                linked, _ = self.measure(i, others)
                self.connect(i, others[linked])

    def join(self, members: np.ndarray, known: np.ndarray | None = None, least: int = 48, depth: int = 0):
        """Joins members exactly; known: their distances to the pivots so far."""
        known = np.zeros((len(members), 0)) if known is None else known
        if len(members) <= least or depth >= 6:
            self.compare(members, members, known, known)
            return
        n_pivots = min(8, int(len(members) ** 0.5))
        distances, far = [], np.full(len(members), np.inf)
        at = int(np.argmin(self.names[members]))
        for _ in range(n_pivots):
            linked, d = self.measure(members[at], members)
            self.connect(members[at], members[linked])
            distances.append(d)
            far = np.minimum(far, d)
            at = int(np.argmax(far))
            if far[at] == 0:
                break
        d = np.stack(distances, axis=1)
        home, reach = d.argmin(axis=1), d.min(axis=1) + 2 * (1 - self.percent / 100) + 1e-9
        for j in range(d.shape[1]):
            # The cell and its boundary: no linked pair has its ends in none of one cell's cores.
            inside = np.flatnonzero((home == j) | (d[:, j] <= reach))
            core = np.flatnonzero(home == j)
            if not len(core):
                continue
            if (self.group[members[inside]] == self.group[members[inside[0]]]).all():
                continue
            if len(inside) < 0.7 * len(members):
                self.join(members[inside], np.concatenate([known[inside], d[inside]], axis=1), least, depth + 1)
            else:
                open_ = core[d[core, j] > 1 - self.percent / 100]
                # Core classes in the pivot's ball are connected; they meet the others of the cell from their side.
                outside = np.setdiff1d(inside, core)
                full = np.concatenate([known, d], axis=1)
                self.compare(members[open_], members[inside], full[open_], full[inside])
                ball = np.setdiff1d(core, open_)
                self.compare(members[outside], members[ball], full[outside], full[ball])


_LINKS = "a long, b long, pivot long, cls long, d double"


def _row_batch(a, b, pivot, cls, d) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "pivot": pa.array(pivot, pa.int64()), "cls": pa.array(cls, pa.int64()), "d": pa.array(d, pa.float64())})


def _cell_of(table: pa.Table, percent: int) -> Cell:
    return Cell(np.asarray(table.column("cls")), np.asarray(table.column("size")), table.column("shared").to_pylist(), percent)


def _linked(cell: Cell) -> pa.Table:
    none = [None] * len(cell.links)
    return _row_batch([int(cell.names[i]) for i, _ in cell.links], [int(cell.names[j]) for _, j in cell.links], none, none, none)


def join_block(table: pa.Table, percent: int) -> pa.Table:
    """Links of a pivot's cell; of a block of a cell with more of them the pivot's links and every member's distance."""
    cell = _cell_of(table, percent)
    pivot, n_blocks = table.column("pivot")[0].as_py(), table.column("n_blocks")[0].as_py()
    members = np.arange(len(cell.names))
    at = int(np.flatnonzero(cell.names == pivot)[0])
    linked, d = cell.measure(at, members)
    cell.connect(at, members[linked & (members != at)])
    if n_blocks == 1:
        cell.join(members, d[:, None])
        return _linked(cell)
    others = members[members != at]
    none = [None] * len(others)
    return pa.concat_tables([_linked(cell), _row_batch(none, none, [pivot] * len(others), cell.names[others], d[others])])


def join_chunks(table: pa.Table, percent: int) -> pa.Table:
    """Links between two chunks of a cell (sides 0 and 1), or within one (side 0 only)."""
    cell = _cell_of(table, percent)
    side, d = np.asarray(table.column("side")), np.asarray(table.column("d"))[:, None]
    inner = np.flatnonzero(d[:, 0] <= 1 - percent / 100)
    if len(inner):
        # The ball is connected through the pivot, which isn't here.
        cell.group[inner] = inner[0]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(right):
        cell.compare(left, right, d[left], d[right])
    else:
        cell.join(left, d)
    return _linked(cell)


def _by_key(packed: DataFrame, n: int, work, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(packed.sparkSession.createDataFrame([], schema).schema).empty_table()

    def grouped(table: pa.Table) -> pa.Table:
        out = [b for b in work(table.to_pylist()) if b.num_rows]
        return pa.Table.from_batches(out) if out else empty

    return packed.repartition(n, "key").groupBy("key").applyInArrow(grouped, schema)


def text_key():
    """Tells rows of one id apart; equal texts are equal rows."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles and cls (null where there are no shingles) of each row."""

    def told(batches):
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                doc, h, _ = shingles(block, k)
                size, cls = set_classes(doc, h, block.n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.lo, block.n) for c in ("doc_id", "text_key")), pa.array(size, pa.int64()), pa.array(cls.view(np.int64), mask=size == 0)], ["doc_id", "text_key", "n_shingles", "cls"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(told, "doc_id long, text_key long, n_shingles long, cls long")


def candidates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Classes that share enough of their shingles to be linked, written once."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = scratch.parts(spark, size, 10_000_000)

    def send(batches):
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                yield from send_block(block, k, n, n)

    def shared(rows):
        for r in rows:
            if r["kind"]:
                yield pa.RecordBatch.from_pylist([r], schema=passed)
        own = [r for r in rows if not r["kind"]]
        if own:
            yield share(own, n)

    passed = pa.schema([("key", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("classes", "counts", "hashes", "ranks"))])
    sent = docs.select("text").mapInArrow(send, _PACKED)
    met = _by_key(sent, n, shared, _PACKED)
    return scratch.cut(_by_key(met, n, lambda rows: [candidates_of(rows, percent)], "cls long, size long, shared binary, prefix array<long>"), "join-candidates")


def links(found: DataFrame, percent: int = PERCENT, block_size: int = BLOCK_SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): verified links between classes that connect all linked classes."""
    tokens = found.select("cls", F.explode("prefix").alias("token"))
    elected = tokens.groupBy("token").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "pivot")
    member = scratch.cut(tokens.join(elected, "token").where("cls != pivot").select("pivot", "cls").distinct(), "join-members")
    width = found.select("cls", F.octet_length("shared").alias("bytes"))
    sizes = member.join(width, "cls").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_size), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    cells = scratch.cut(sizes.select("pivot", n_blocks.alias("n_blocks")), "join-cells")
    placed = member.join(cells, "pivot").select("pivot", "cls", "n_blocks", F.pmod(F.xxhash64("cls", "pivot"), "n_blocks").cast("int").alias("block"))
    pivots = cells.select("pivot", F.col("pivot").alias("cls"), "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    sets = found.select("cls", "size", "shared")
    rows = placed.union(pivots).join(sets, "cls").select("pivot", "block", "n_blocks", "cls", "size", "shared")
    inside = scratch.cut(rows.groupBy("pivot", "block").applyInArrow(lambda t: join_block(t, percent), _LINKS), "join-links")
    own = inside.where("a is not null").select("a", "b")
    away = inside.where("cls is not null").select("pivot", "cls", "d")
    if away.isEmpty():
        return own
    # Rings by distance, a quarter of the radius wide, in chunks of at most a block.
    radius = 1 - percent / 100
    ringed = away.join(width, "cls").withColumn("ring", F.floor(F.col("d") / (radius / 4)).cast("int"))
    rings = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("d").alias("far"))
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_size), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    rings = scratch.cut(rings.select("pivot", "ring", "far", n_chunks.alias("n_chunks")), "join-rings")
    dealt = ringed.join(rings.drop("far"), ["pivot", "ring"]).select("pivot", "ring", F.pmod(F.xxhash64("cls", "pivot"), "n_chunks").cast("int").alias("chunk"), "cls", "d")
    dealt = scratch.cut(dealt, "join-dealt")
    chunks = rings.select("pivot", "ring", "far", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    # A chunk meets those of its ring and of rings nearer to the pivot by a radius at most, if it has classes outside the ball.
    other = chunks.select("pivot", F.col("ring").alias("ring2"), F.col("chunk").alias("chunk2"))
    meet = chunks.where(F.col("far") > radius).join(other, "pivot").where("ring2 between ring - 5 and ring and (ring2 < ring or chunk2 <= chunk)")
    meet = scratch.cut(meet.select("pivot", "ring", "chunk", "ring2", "chunk2"), "join-meet")
    same = (F.col("ring") == F.col("ring2")) & (F.col("chunk") == F.col("chunk2"))
    left = dealt.join(meet, ["pivot", "ring", "chunk"]).select(*meet.columns, "cls", "d", F.lit(0).alias("side"))
    right = dealt.toDF("pivot", "ring2", "chunk2", "cls", "d").join(meet.where(~same), ["pivot", "ring2", "chunk2"]).select(*meet.columns, "cls", "d", F.lit(1).alias("side"))
    across = left.union(right).join(sets, "cls").select(*meet.columns, "side", "cls", "d", "size", "shared")
    met = across.groupBy(*meet.columns).applyInArrow(lambda t: join_chunks(t, percent), _LINKS)
    return own.union(scratch.cut(met.select("a", "b"), "join-across"))


def _joined(docs: DataFrame, k: int, percent: int, block_size: int, block_bytes: int) -> DataFrame:
    """One row for each document: doc_id, text_key, n_shingles, root (null without shingles), component_id, class_size."""
    rows = scratch.cut(classes(docs, k), "join-classes")
    found = candidates(docs, k, percent)
    roots = components(links(found, percent, block_size, block_bytes), "a", "b")
    kinds = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("class_size"))
    named = kinds.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # Written, so that the join below can split a component with a large share of all classes.
    least = scratch.cut(named.groupBy("root").agg(F.min("first").alias("component_id")), "join-least")
    names = scratch.cut(named.join(least, "root").select("cls", "root", "component_id", "class_size"), "join-names")
    return rows.join(names, "cls", "left")


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block_size: int = BLOCK_SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, class_size (rows with its shingle set)."""
    joined = _joined(docs, k, percent, block_size, block_bytes)
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: of those with the smallest id the one with the smallest text hash.

    Rows that share an id are judged each.  Rows without shingles or without an
    id stay; rows of equal id and text stay once.
    """
    joined = scratch.cut(_joined(docs, k, percent, BLOCK_SIZE, BLOCK_BYTES).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__tq_id"), F.col("text_key").alias("__tq_key"), "root"), "join-rows")
    me = F.struct("__tq_id", "__tq_key")
    stays = scratch.cut(joined.where("root is not null").groupBy("root").agg(F.min(me).alias("stays")), "join-stays")
    goes = scratch.cut(joined.join(stays, "root").where(me != F.col("stays")).select("__tq_id", "__tq_key").distinct(), "join-goes")
    # Rows of an id: how many there are, in how many texts, and how many of these go.
    ids = joined.groupBy("__tq_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__tq_key").alias("texts"))
    ids = ids.join(goes.groupBy("__tq_id").agg(F.count(F.lit(1)).alias("going")), "__tq_id", "left")
    # The documents that go are fewer than those that stay, and known before the texts are read; most are told by their id alone.
    gone = scratch.cut(ids.where("going = texts").select("__tq_id"), "join-gone")
    some = scratch.cut(ids.where("going is null and n > 1 or going < texts").select("__tq_id"), "join-some")
    same_id = F.col("doc_id").cast("long") == F.col("__tq_id")
    rows = docs.join(gone, same_id, "left_anti")
    if some.isEmpty():
        return rows
    # Ids with rows that stay beside others.
    same = same_id & (text_key() == F.col("__tq_key"))
    rows = rows.join(goes.join(some, "__tq_id", "left_semi"), same, "left_anti")
    again = joined.join(some, "__tq_id", "left_semi").groupBy("__tq_id", "__tq_key").count().where("count > 1").select("__tq_id", "__tq_key")
    again = scratch.cut(again, "join-again")
    if again.isEmpty():
        return rows
    return rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
