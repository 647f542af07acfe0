"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are tokenized whole and closed by an end id.  Each source is a queue
of tokens; every sequence is filled from all queues in their target token
proportions.  A queue's share of a sequence is rarely a whole number, so it is
given the whole part and its deficit is carried to the next sequence.  In
closed form: a queue of a share s below two tokens a sequence has been given
floor(m * s) before sequence m of a phase; of the R(m) tokens that all these
leave, the other queues 1..k have together been given floor(R(m) * Q_k), with
Q_k their joint proportion.  So every partition computes where its own
documents' tokens lie, with the deficits that all earlier sequences and
partitions left, and no token is shuffled.  A phase ends when a queue runs
short; the sequence between two phases takes what that queue has left and
fills up from the others, in proportion.  Every phase but the last ends a
queue, so there are at most two for each queue; without targets all queues end
together, after a few.

The queues' places come from prefix sums in two steps: within each written
part, and over the (source, part) totals.  A source without a target that
would get less than two tokens a sequence shares a queue with others like it,
so there are at most ``width`` / 2 queues and one for each target, and only
their totals reach the driver.  Places are broadcast to groups of parts whose
totals are at most ``GROUP_ROWS`` rows, or one chunk of ``CHUNK`` parts.

Within the shared queue whole documents are dealt by their sources' deficits:
a document's turn is the share of its source's tokens before a point within
it, a point fixed by the source so that sources of one document spread out.
Up to any turn each source has given its share to within one document.  Spark
sorts the turns in slices of about equal token counts; only documents of the
shared queue are joined with their places, which moves their token ids once.

Sequences are full but at the very end, where the rest of fewer than ``width``
tokens becomes sequences whose lengths are powers of two, so nothing is padded.

Defined results: a null text is empty and holds the end id alone; a null
source is a queue of its own; repeated rows are packed each; an empty table
gives no pieces; a text of any length is one document in as many pieces as it
needs; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

WIDTH, END = 2048, 1
SCALE = 28
#: Tokens of the shared queue whose documents are sorted together, and slices whose sums are added up together.
SLICE_TOKENS, SLICES = 1 << 24, 1 << 12
#: Written parts in a folder of their own, and rows of places that are broadcast together.
CHUNK, GROUP_ROWS = 64, 400_000


#: Kinds of bytes in words: letters, digits, signs, and those that only the tokenizer itself should cut up.
_LETTER, _DIGIT, _SIGN, _WHOLE = 1, 2, 3, 4
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, 0x3C]] = _WHOLE
#: Units that need no normalizing but lower case; and the character that stands for each byte in byte-level vocabularies.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = dict(zip(sorted({*range(256)} - {*_SHOWN}), range(256, 512), strict=False))


class UnitEncoder:
    """Token ids of whole texts for the lower-casing tokenizer with word ends.

    That tokenizer never joins what white space parts, nor letters, single
    digits and signs.  Words of ASCII and accented Latin-1 letters are cut into
    such units; words with anything else, apostrophes and ``<`` are one unit.
    Each different unit is encoded once; the memory for known units is bounded.
    """

    def __init__(self, path: str, most_units: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint32 if self.tokenizer.get_vocab_size() > 1 << 16 else np.uint16
        self.most = most_units
        self._clear()

    def _clear(self):
        self.known = np.zeros(0, tk.U64)
        self.slot = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, units: list[bytes], hashes: np.ndarray):
        sizes, flat = np.zeros(len(units), np.int64), []
        model, whole = self.tokenizer.model, self.tokenizer
        for i, unit in enumerate(units):
            text = unit.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                # A unit as the tokenizer itself hands it to its model.
                seen = text if text.isascii() else text.lower().encode().decode("latin-1").translate(_VISIBLE)
                found = [t.id for t in model.tokenize(seen)]
            else:
                found = whole.encode(text, add_special_tokens=False).ids
            sizes[i] = len(found)
            flat += found
        at = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, at, np.arange(len(hashes), dtype=np.int32) + len(self.known))
        self.known = np.insert(self.known, at, hashes)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.array(flat, self.dtype)])

    @staticmethod
    def units(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes; starts and ends of units; the count of units before each text."""
        data = block.data
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        lead = lead[(after != 0x97) & (after != 0xB7) & (after >= 0x80) & (after < 0xC0)]
        kind[lead] = kind[lead + 1] = _LETTER
        starts, ends, _ = tk.spans(block, tk.SPACED)
        hard = np.concatenate([[0], np.cumsum(kind == _WHOLE, dtype=np.int32)])
        for a, b in zip(starts[w := hard[ends] > hard[starts]].tolist(), ends[w].tolist(), strict=True):
            kind[a:b] = _WHOLE
        data = np.where(kind == _WHOLE, data, tk.FOLD[data])
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edges = block.offsets[:-1]
        new[edges[edges < len(new)]] = True
        cuts = np.flatnonzero(new)
        stops = np.append(cuts[1:], len(kind))
        inside = kind[cuts] > 0
        cuts, stops = cuts[inside], stops[inside]
        return data, cuts, stops, np.searchsorted(cuts, block.offsets)

    def encode(self, block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and the count of ids before each text."""
        data, starts, ends, first = self.units(block)
        kinds, one, of = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(kinds) > self.most:
            self._clear()
        at = np.searchsorted(self.known, kinds)
        old = np.zeros(len(kinds), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == kinds
        if not old.all():
            raw = data.tobytes()
            picked = one[~old]
            self._learn([raw[a:b] for a, b in zip(starts[picked].tolist(), ends[picked].tolist(), strict=True)], kinds[~old])
            at = np.searchsorted(self.known, kinds)
        slot = self.slot[at][of]
        bounds = np.append(self.starts, len(self.flat))
        lo, sizes = bounds[slot], bounds[slot + 1] - bounds[slot]
        ids = self.flat[np.repeat(lo, sizes) + tk.ragged(sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file; it outlives a task, as what it knows does."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """One row for each document, written once by chunk: doc_id, source, part, before (tokens of its source earlier in its part), n_tokens, ids, chunk."""

    def encode(batches):
        from pyspark import TaskContext

        coder, part = encoder(path), TaskContext.get().partitionId()
        filled: dict[str, int] = {}
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                ids, first = coder.encode(block)
                sizes = np.diff(first) + 1
                sources = batch.column("source").slice(block.lo, block.n).to_pylist()
                rows, before = [], []
                for i, s in enumerate(sources):
                    rows.append(np.append(ids[first[i] : first[i + 1]], coder.dtype(end)).tobytes())
                    before.append(filled.get(s, 0))
                    filled[s] = before[-1] + int(sizes[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, block.n), pa.array(sources, pa.string()), pa.array([part] * block.n, pa.int64()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()), pa.array([part // CHUNK] * block.n, pa.int64())],
                    ["doc_id", "source", "part", "before", "n_tokens", "ids", "chunk"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    written = rows.mapInArrow(encode, "doc_id long, source string, part long, before long, n_tokens long, ids binary, chunk long")
    return scratch.cut(written, "pack-tokens", by=["chunk"])


def _scaled(x, f):
    """floor(x * f / 2**SCALE) for whole x, f >= 0 without overflow, as long as the result fits."""
    return (x >> SCALE) * f + ((x & ((1 << SCALE) - 1)) * (f & ((1 << SCALE) - 1)) >> SCALE) + (x & ((1 << SCALE) - 1)) * (f >> SCALE)


class Schedule:
    """How many tokens each queue has given before each sequence.

    A phase is its first sequence, the number and width of its sequences, the
    tokens that each queue has given before, and either rates (``small``: tokens
    a sequence, of queues below two; ``joint``: the others' joint proportions;
    both scaled by 2**SCALE) or the numbers that each queue gives to its one
    sequence.
    """

    def __init__(self, totals: list[int], weights: list[float], width: int = WIDTH):
        k = len(totals)
        left, given = np.array(totals, np.int64), np.zeros(k, np.int64)
        weights = np.array(weights, float)
        self.width = width
        first, before, small, joint, took, sizes = [0], [], [], [], [], []

        def add(n, size, own_small, own_joint, gave):
            before.append(given.copy())
            small.append(own_small)
            joint.append(own_joint)
            took.append(gave)
            sizes.append((n, size))
            first.append(first[-1] + n)

        none = np.zeros(k, np.int64)
        while int(left.sum()) >= width:
            w = self._shares(left, weights)
            rate = np.where(w * width < 2, np.floor(w * width * (1 << SCALE)), 0).astype(np.int64)
            large = np.where(w * width < 2, 0.0, w)
            if large.sum() * width * 2 < width:
                raise ValueError("too many targets below two tokens a sequence")
            proportion = np.floor(large / large.sum() * (1 << SCALE)).astype(np.int64)
            proportion[int(np.argmax(large))] += (1 << SCALE) - int(proportion.sum())
            own_joint = np.cumsum(proportion)
            gave = lambda n: self._rated(n, rate, own_joint, width)  # noqa: E731, B023
            lo, hi = 0, int(left.sum()) // width
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if (gave(mid) <= left).all() else (lo, mid - 1)
            if lo:
                add(lo, width, rate, own_joint, none)
                now = gave(lo)
            else:
                # What queues that would run short have left, then the others in proportion.
                last = gave(1) > left
                now = np.where(last, left, 0)
                now += self._share(left - now, weights, width - int(now.sum()))
                add(1, width, none, none, now)
            given, left = given + now, left - now
        rest = int(left.sum())
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                now = self._share(left, weights, 1 << bit)
                add(1, 1 << bit, none, none, now)
                given, left = given + now, left - now
        grid = lambda rows: np.array(rows, np.int64).reshape(len(rows), k)
        self.first = np.array(first, np.int64)
        self.sizes = np.array(sizes, np.int64).reshape(-1, 2)
        self.given = grid([*before, given])
        self.small, self.joint = grid(small), grid(joint)
        self.took = np.cumsum(grid(took), axis=1)
        #: Queues that have a rate below two in some phase.
        self.rated = np.flatnonzero(self.small.any(axis=0)) if k else np.zeros(0, np.int64)

    @staticmethod
    def _shares(left: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Proportions of queues that have tokens left; of what they have left where none has a weight."""
        w = np.where(left > 0, weights, 0.0)
        if not w.sum():
            w = left.astype(float)
        return w / w.sum()

    @staticmethod
    def _rated(n: int, rate: np.ndarray, joint: np.ndarray, width: int) -> np.ndarray:
        """What each queue gives to the first n sequences of a phase with rates."""
        low = _scaled(n, rate)
        others = _scaled(n * width - int(low.sum()), joint)
        return low + np.diff(others, prepend=0)

    @classmethod
    def _share(cls, left: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """``size`` tokens from queues in proportion to their weights, from what they have left; queues before others where a part is over."""
        gave = np.zeros_like(left)
        while (lack := size - int(gave.sum())) > 0:
            more = np.minimum((cls._shares(left - gave, weights) * lack).astype(np.int64), left - gave)
            if not more.sum():
                more[np.flatnonzero(left > gave)[:lack]] = 1
            gave += more
        return gave

    def place(self, queue: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens a queue has given before sequence n, and its first offset in that sequence."""
        phase = np.minimum(np.searchsorted(self.first, n, "right") - 1, len(self.sizes) - 1)
        m = n - self.first[phase]
        width = self.sizes[phase, 1]
        before = np.maximum(queue - 1, 0)
        below = np.where(queue > 0, self.joint[phase, before], 0)
        own = self.joint[phase, queue]
        # What the others leave before this sequence and the next one; queues below two lie behind the others.
        leave, after, earlier = m * width, (m + 1) * width, np.zeros_like(m)
        for j in self.rated.tolist():
            rate = self.small[phase, j]
            a, b = _scaled(m, rate), _scaled(m + 1, rate)
            leave, after = leave - a, after - b
            earlier += np.where(queue > j, b - a, 0)
        rate = self.small[phase, queue]
        rated = self.joint[phase, -1] > 0
        lo = _scaled(leave, below)
        large = _scaled(leave, own) - lo
        took = np.where(queue > 0, self.took[phase, before], 0)
        given = np.where(rated, np.where(rate > 0, _scaled(m, rate), large), np.where(m > 0, self.took[phase, queue] - took, 0))
        offset = np.where(rated, np.where(rate > 0, after - leave + earlier, _scaled(after, below) - lo), took)
        return self.given[phase, queue] + given, offset

    @property
    def n_sequences(self) -> int:
        return int(self.first[-1])

    def find(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The sequence that holds a queue's token at a position: the last that starts at or before it."""
        lo, hi = np.zeros_like(position), np.full_like(position, self.n_sequences)
        for _ in range(max(1, self.n_sequences.bit_length())):
            mid = (lo + hi + 1) // 2
            at, _ = self.place(queue, np.minimum(mid, self.n_sequences))
            ahead = (at > position) | (mid >= self.n_sequences)
            hi, lo = np.where(ahead, mid - 1, hi), np.where(ahead, lo, mid)
            hi = np.maximum(hi, lo)
        return lo

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Cuts token ranges of queues at sequence bounds: owner, start within the range, length, sequence, offset.

        A queue below one token a sequence skips sequences, which hold none of a range's tokens.
        """
        owners, seqs = [], []
        upto, end = start.copy(), start + size
        last = self.find(queue, end - 1)
        first = self.find(queue, start)
        skips = last - first + 1 > size
        near = np.flatnonzero(~skips)
        count = (last - first + 1)[near]
        owners.append(np.repeat(near, count))
        seqs.append(first[owners[0]] + tk.ragged(count))
        # Sparse ranges: from one sequence that holds tokens to the next such one.
        open_ = np.flatnonzero(skips)
        while len(open_):
            seq = self.find(queue[open_], upto[open_])
            owners.append(open_)
            seqs.append(seq)
            upto[open_] = self.place(queue[open_], seq + 1)[0]
            open_ = open_[upto[open_] < end[open_]]
        owner, seq = np.concatenate(owners), np.concatenate(seqs)
        at, offset = self.place(queue[owner], seq)
        after, _ = self.place(queue[owner], seq + 1)
        lo = np.maximum(at, start[owner])
        hi = np.minimum(after, end[owner])
        real = np.flatnonzero(hi > lo)
        real = real[np.lexsort((lo[real], owner[real]))]
        owner, seq, at, offset, lo, hi = (x[real] for x in (owner, seq, at, offset, lo, hi))
        return owner, lo - start[owner], hi - lo, seq, offset + lo - at


def _turns(tokens: DataFrame, bases: DataFrame, size: int) -> DataFrame:
    """(source, part, before, base) of the shared queue's documents; base + before is a document's place in the queue."""
    slices = max(1, size // SLICE_TOKENS)
    # A point in each document, the same for all documents of a source.
    point = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    docs = tokens.select("source", "part", "before", "n_tokens").join(bases, ["source", "part"])
    docs = docs.withColumn("turn", (F.col("own") + F.col("before") + point * F.col("n_tokens")) / F.col("all"))
    docs = docs.withColumn("slice", F.least(F.floor(F.col("turn") * slices), F.lit(slices - 1)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("slice").agg(F.sum("n_tokens").alias("n")).withColumn("heap", F.floor(F.col("slice") / SLICES))
    heaps = sums.groupBy("heap").agg(F.sum("n").alias("n"))
    heaps = heaps.select("heap", F.coalesce(F.sum("n").over(earlier(Window.orderBy("heap"))), F.lit(0)).alias("heaps_before"))
    sums = sums.withColumn("within", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("heap").orderBy("slice"))), F.lit(0)))
    sums = sums.join(heaps, "heap").select("slice", (F.col("heaps_before") + F.col("within")).alias("first"))
    order = earlier(Window.partitionBy("slice").orderBy("turn", "source", "part", "before"))
    placed = docs.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(sums, "slice")
    return placed.select("source", "part", "before", (F.col("first") + F.col("ahead") - F.col("before")).alias("base"))


def _weights(by_source: DataFrame, targets: dict[str, float], width: int) -> tuple[list[tuple[str, int, float]], int, float]:
    """(source, tokens, share) of sources with a queue of their own; tokens and share of the others together.

    Named sources have their targets; the others share what these leave in proportion to their tokens.
    """
    if min(targets.values(), default=0) < 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are proportions that add up to 1 at most")
    named = {r.source: r.n for r in by_source.where(F.col("source").isin(list(targets))).collect()} if targets else {}
    others = by_source.where(~F.col("source").isin(list(targets))) if targets else by_source
    other_tokens = others.agg(F.sum("n")).first()[0] or 0
    rest = max(0.0, 1 - sum(targets.values())) if targets else 1.0
    own = [(s, n, targets[s]) for s, n in sorted(named.items())]
    # Without a share they come last, by what they have.
    least = 2 * other_tokens / (width * (rest if rest > 1e-9 else 1.0))
    share = lambda n: rest * n / other_tokens if rest > 1e-9 else 0.0
    own += [(r.source, r.n, share(r.n)) for r in others.where(F.col("n") >= least).orderBy("source").collect()]
    small = other_tokens - sum(n for s, n, _ in own if s not in named)
    return own, small, share(small) if small else 0.0


def _groups(rows_of_chunk: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of chunks whose places are at most GROUP_ROWS rows together, or one chunk."""
    out, held = [], 0
    for chunk, n in sorted(rows_of_chunk):
        if out and held + n <= GROUP_ROWS:
            out[-1] = (out[-1][0], chunk)
            held += n
        else:
            out.append((chunk, chunk))
            held = n
    return out


def pack(docs: DataFrame, path: str, width: int = WIDTH, end: int = END, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` gives sources their target proportions, 1 together at most.
    Sources it doesn't name share the rest in proportion to their tokens, and
    come last where there is no rest.  When a source runs out, its share goes to
    those left, in proportion.  Targets of the empty string mean a null source.
    More than a quarter of ``width`` targets below two tokens a sequence can
    raise ValueError, as do negative ones and those beyond 1.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, path, end)
    totals = scratch.cut(tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")), "pack-totals")
    own, small, small_share = _weights(totals.groupBy("source").agg(F.sum("n").alias("n")), targets or {}, width)
    shared_queue = len(own)
    sums, weights = [n for _, n, _ in own], [w for _, _, w in own]
    if small:
        sums.append(small)
        weights.append(small_share)
    schedule = spark.sparkContext.broadcast(Schedule(sums, weights, width))
    known = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(own)], "source string, queue long")
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most width / 2 sources and those with targets are known.
    bases = totals.join(F.broadcast(known), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(shared_queue)).cast("long"))
    bases = bases.withColumns({"own": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(of_source)})
    bases = scratch.cut(bases.select("source", "part", "queue", "own", "all"), "pack-bases")
    shared = F.col("queue") == shared_queue
    columns = ["doc_id", "source", "queue", "base", "before", "n_tokens", "ids"]
    apart = bases.where(~shared).select("source", "part", "queue", F.col("own").alias("base"))
    chunk = F.floor(F.col("part") / CHUNK)
    placed = None
    for lo, hi in _groups([tuple(r) for r in apart.groupBy(chunk.alias("chunk")).count().collect()]):
        mine = tokens.where(F.col("chunk").between(lo, hi)).join(F.broadcast(apart.where(chunk.between(lo, hi))), ["source", "part"]).select(*columns)
        placed = mine if placed is None else placed.unionByName(mine)
    if small:
        turns = scratch.cut(_turns(tokens, bases.where(shared), small), "pack-turns")
        mine = tokens.join(turns, ["source", "part", "before"]).withColumn("queue", F.lit(shared_queue).cast("long")).select(*columns)
        placed = mine if placed is None else placed.unionByName(mine)
    if placed is None:
        placed = tokens.select("doc_id", "source", F.lit(0).cast("long").alias("queue"), F.lit(0).cast("long").alias("base"), "before", "n_tokens", "ids")

    def cut_up(batches):
        plan = schedule.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c, b=batch: np.asarray(b.column(c))
            owner, start, length, seq, offset = plan.pieces(get("queue"), get("base") + get("before"), get("n_tokens"))
            wide = 4 if len(batch.column("ids")[0].as_py()) == 4 * batch.column("n_tokens")[0].as_py() else 2
            crc, held, at = np.zeros(len(owner), np.int64), b"", -1
            rows = batch.column("ids")
            for i, (d, a, n) in enumerate(zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)):
                if d != at:
                    held, at = np.frombuffer(rows[d].as_py(), f"<u{wide}").astype("<u4").tobytes(), d
                crc[i] = zlib.crc32(held[4 * a : 4 * (a + n)])
            pick = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), pa.array(start), pa.array(length), pa.array(crc), batch.column("n_tokens").take(pick), pa.array(seq), pa.array(offset), batch.column("source").take(pick)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return placed.mapInArrow(
        cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )
