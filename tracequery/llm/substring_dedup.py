"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the novel text of all documents: of every phrase of
``window`` consecutive words the first place in the document with the least
id.  It is indexed in blocks by the phrases' hashes, cut by a second,
independent hash.  A document is parsed greedily, from left to right, against
the novel text of documents with smaller ids: at a place whose phrase the
index knows, the factor is the longest match with the reference that starts
there, found by extending word by word along the reference; other words are
literals.  Since a phrase stands in the reference once, that match is unique,
and it ends where the next phrase's reference place doesn't follow.

Factors of ``window`` words or more are duplicate spans.  A phrase that lies
across the end of a factor isn't in any factor; those phrases are looked up at
each factor boundary, and the ones that the index knows are duplicate spans
too.  A word is removed if it lies in a duplicate span.  So exactly the words
of known phrases are removed: a phrase that starts outside factors would start
one.  Spans are judged on the input, not on what is left.

What moves is packed: each task sends a phrase that it meets in many documents
once, for the smallest id of the text block, and keeps for the other documents
that they repeat that one; their reference places follow from its own, in one
more exchange.  So a passage that a third of all documents hold reaches its
index block once per text block.  A phrase is 56 bits of its hash within its
block.  Blocks and the groups of documents that collect places grow in number
with the input.

Defined results: a null text has no words; a null id counts as the largest;
rows that share an id are judged by themselves and are no reference for each
other; equal rows get equal results; a text of any length is parsed whole; an
empty table gives no rows; extra columns are kept by ``remove`` and not read
by ``scan``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk

WINDOW = 13
LAST_ID = (1 << 63) - 1
_SEED, _SEED_BLOCK = 3001, 3011
_PARTS = ["docs", "counts", "places", "hashes", "ref_docs", "ref_tags", "shifts"]
#: Kinds of packed rows: phrases for the index; places told by the place of their text block's least document; places with their reference.
_PHRASE, _TOLD, _FOUND = 0, 1, 2
_PACKED = "key int, kind int, " + ", ".join(f"{p} binary" for p in _PARTS)
_RUNS = "array<struct<start:int,count:int,ref_doc:bigint,ref_start:int>>"
_HASH_BYTES = 7


def _gaps(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending places of each document as differences; the first stays."""
    out = places.astype(np.int64)
    out[1:] -= places[:-1]
    heads = np.cumsum(counts) - counts
    out[heads] = places[heads]
    return out.astype(np.uint32)


def _ungaps(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps.astype(np.int64))
    heads = np.cumsum(counts) - counts
    return total - np.repeat(total[heads] - gaps[heads], counts)


def _pack(key: np.ndarray, kind: int, doc: np.ndarray, tag: np.ndarray, place: np.ndarray, hashes=None, ref=None):
    """Entries, sorted by key, row and place, as one packed row for each key; ``ref``: document, tag and place."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    rows = {p: [] for p in _PARTS}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        d, t = doc[lo:hi], tag[lo:hi]
        heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        counts = np.diff(np.append(heads, hi - lo))
        rows["docs"].append(tk.planes(d[heads]) + tk.planes(t[heads]))
        rows["counts"].append(tk.planes(counts.astype(np.uint32)))
        rows["places"].append(tk.planes(_gaps(place[lo:hi], counts)))
        if hashes is not None:
            rows["hashes"].append(np.ascontiguousarray(hashes[lo:hi].view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes())
        else:
            rows["ref_docs"].append(tk.planes(ref[0][lo:hi]))
            # Only told places are looked up by the row they repeat.
            rows["ref_tags"].append(tk.planes(ref[1][lo:hi]) if kind == _TOLD else b"")
            rows["shifts"].append(tk.planes((place[lo:hi] - ref[2][lo:hi]).astype(np.int32)))
    n = len(cuts) - 1
    none = [None] * n
    return pa.RecordBatch.from_arrays(
        [pa.array(key[cuts[:-1]], pa.int32()), pa.array([kind] * n, pa.int32()), *(pa.array(rows[p] or none, pa.binary()) for p in _PARTS)], ["key", "kind", *_PARTS]
    )


def _unpack(rows: list[dict]):
    """doc, tag, place; hashes or None; (document, tag, place) of references or None, of all entries of packed rows of one kind."""
    doc, tag, place, hashes, ref = [], [], [], [], ([], [], [])
    for r in rows:
        counts = tk.unplanes(r["counts"], np.uint32).astype(np.int64)
        n = len(counts)
        doc.append(np.repeat(tk.unplanes(r["docs"][: 8 * n], np.int64), counts))
        tag.append(np.repeat(tk.unplanes(r["docs"][8 * n :], np.uint32), counts))
        place.append(_ungaps(tk.unplanes(r["places"], np.uint32), counts))
        if r["hashes"] is not None:
            wide = np.zeros((int(counts.sum()), 8), np.uint8)
            wide[:, :_HASH_BYTES] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, _HASH_BYTES)
            hashes.append(wide.view(tk.U64).ravel())
        else:
            ref[0].append(tk.unplanes(r["ref_docs"], np.int64))
            if r["kind"] == _TOLD:
                ref[1].append(tk.unplanes(r["ref_tags"], np.uint32))
            ref[2].append(place[-1] - tk.unplanes(r["shifts"], np.int32))
    join = np.concatenate
    return join(doc), join(tag), join(place), join(hashes) if hashes else None, tuple(join(x) if x else None for x in ref) if ref[0] else None


def _target(doc: np.ndarray, n: int) -> np.ndarray:
    return (tk.mix(doc.view(tk.U64)) % tk.U64(n)).astype(np.int64)


def phrases(block: tk.Block, doc_id: np.ndarray, tag: np.ndarray, window: int, n_blocks: int, n_targets: int):
    """Packed index entries of a text block, and packed places that the block itself settles."""
    words = tk.Words(block)
    at = words.whole(window)
    if not len(at):
        return
    h = words.grams(window, _SEED)[at]
    order = np.argsort(h, kind="stable")
    hs, at = h[order], at[order]
    row = words.doc[at]
    doc, place = doc_id[row], at - words.first[row]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    group = np.cumsum(head) - 1
    least = np.minimum.reduceat(doc, np.flatnonzero(head))[group]
    # The first place of each phrase in each text; texts follow one another within a phrase.
    once = head.copy()
    once[1:] |= row[1:] != row[:-1]
    lead = once & (doc == least)
    sent = np.flatnonzero(lead)
    ref = sent[np.unique(group[sent], return_index=True)[1]][group]
    key = (words.grams(window, _SEED_BLOCK)[at[sent]] % tk.U64(n_blocks)).astype(np.int64)
    by = np.lexsort((at[sent], key))
    sent = sent[by]
    yield _pack(key[by], _PHRASE, doc[sent], tag[row[sent]], place[sent], hashes=hs[sent])
    met = np.flatnonzero(once & ~lead & (doc > least))
    if len(met):
        key = _target(doc[ref[met]], n_targets)
        by = np.lexsort((at[met], key))
        met = met[by]
        yield _pack(key[by], _TOLD, doc[met], tag[row[met]], place[met], ref=(doc[ref[met]], tag[row[ref[met]]], place[ref[met]]))


def look_up(rows: list[dict], n_targets: int):
    """Places of one index block whose phrase starts in a document with a smaller id, packed by their document's target."""
    doc, tag, place, h, _ = _unpack(rows)
    order = np.lexsort((place, tag, doc, h))
    hs, doc, tag, place = h[order], doc[order], tag[order], place[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    met = np.flatnonzero(doc > doc[first])
    return _by_target(doc[met], tag[met], place[met], doc[first[met]], place[first[met]], n_targets)


def _by_target(doc, tag, place, ref_doc, ref_place, n_targets: int) -> pa.RecordBatch:
    key = _target(doc, n_targets)
    by = np.lexsort((place, tag, doc, key))
    return _pack(key[by], _FOUND, doc[by], tag[by], place[by], ref=(ref_doc[by], None, ref_place[by]))


def _place_key(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(tk.mix(doc.view(tk.U64)) + tag.astype(tk.U64) * tk.constants(3019, 1) + place.astype(tk.U64) * tk.constants(3023, 1))


def settle_told(told: list[dict], found: list[dict], n_targets: int) -> pa.RecordBatch:
    """Reference places of told ones: that of the place they repeat, or this place itself where it is the reference."""
    doc, tag, place, _, (ref_doc, ref_tag, ref_place) = _unpack(told)
    if found:
        d, t, p, _, (to_doc, _, to_place) = _unpack(found)
        key = _place_key(d, t, p)
        order = np.argsort(key)
        wanted = _place_key(ref_doc, ref_tag, ref_place)
        at = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
        hit = key[order][at] == wanted
        ref_doc, ref_place = np.where(hit, to_doc[order][at], ref_doc), np.where(hit, to_place[order][at], ref_place)
    return _by_target(doc, tag, place, ref_doc, ref_place, n_targets)


def _runs_of(text: np.ndarray, place: np.ndarray, ref_doc: np.ndarray, ref_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and lengths of maximal runs of places whose reference places follow one another."""
    new = np.ones(len(place), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1]) | (ref_place[1:] != ref_place[:-1] + 1)
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, len(new)))


def runs(rows: list[dict]) -> pa.RecordBatch:
    """For each document of a target, its known places in runs whose reference places follow one another."""
    doc, tag, place, _, (ref_doc, _, ref_place) = _unpack(rows)
    order = np.lexsort((place, tag, doc))
    doc, tag, place, ref_doc, ref_place = (x[order] for x in (doc, tag, place, ref_doc, ref_place))
    row = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    heads, count = _runs_of(np.cumsum(row), place, ref_doc, ref_place)
    row_heads = np.flatnonzero(row)
    offsets = np.append(np.searchsorted(heads, row_heads), len(heads))
    found = pa.StructArray.from_arrays([pa.array(place[heads], pa.int32()), pa.array(count, pa.int32()), pa.array(ref_doc[heads]), pa.array(ref_place[heads], pa.int32())], ["start", "count", "ref_doc", "ref_start"])
    return pa.RecordBatch.from_arrays([pa.array(doc[row_heads]), pa.array(tag[row_heads].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)], ["__tq_doc", "__tq_tag", "__tq_runs"])


def _tagged(docs: DataFrame) -> DataFrame:
    """Adds the row key: the id, and 32 bits of the text's hash for rows that share one."""
    return docs.withColumns({
        "__tq_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
        "__tq_tag": F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFFFF),
    })


def find_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__tq_doc, __tq_tag, __tq_runs) of every document that repeats others."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = scratch.parts(spark, size, 10_000_000)
    n_targets = scratch.parts(spark, size, 10_000_000)

    def send(batches):
        for batch in batches:
            doc, tag = np.asarray(batch.column("__tq_doc")), np.asarray(batch.column("__tq_tag")).astype(np.uint32)
            for block in tk.blocks(batch.column("text")):
                yield from phrases(block, doc[block.lo : block.hi], tag[block.lo : block.hi], window, n_blocks, n_targets)

    def settle(batches):
        gathered = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == _PHRASE:
                    gathered.append(r)
                else:
                    yield _rebatch(r)
        if gathered:
            yield look_up(gathered, n_targets)

    def tell(batches):
        told, found = [], []
        for batch in batches:
            for r in batch.to_pylist():
                (told if r["kind"] == _TOLD else found).append(r)
                if r["kind"] != _TOLD:
                    yield _rebatch(r)
        if told:
            yield settle_told(told, found, n_targets)

    def join_up(batches):
        gathered = [r for batch in batches for r in batch.to_pylist()]
        if gathered:
            yield runs(gathered)

    sent = _tagged(docs.select("doc_id", "text")).select("__tq_doc", "__tq_tag", "text").mapInArrow(send, _PACKED)
    met = _by_key(sent, n_blocks, settle, _PACKED)
    told = _by_key(met, n_targets, tell, _PACKED)
    return _by_key(told, n_targets, join_up, f"__tq_doc long, __tq_tag long, __tq_runs {_RUNS}")


def _rebatch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row["key"]], pa.int32()), pa.array([row["kind"]], pa.int32()), *(pa.array([row[p]], pa.binary()) for p in _PARTS)], ["key", "kind", *_PARTS])


def _by_key(packed: DataFrame, n: int, work, schema: str) -> DataFrame:
    """Runs ``work`` on the packed rows of each key."""

    def grouped(table: pa.Table) -> pa.Table:
        out = [b for b in work(table.drop(["key"]).append_column("key", table.column("key")).to_batches()) if b.num_rows]
        return pa.Table.from_batches(out) if out else empty

    fields = packed.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(fields).empty_table()
    return packed.repartition(n, "key").groupBy("key").applyInArrow(grouped, schema)


class Parse:
    """The parse of a block's texts; ``found`` has each text's runs or None.

    ``text``, ``start``, ``length``, ``ref_doc`` and ``ref_start`` describe the
    factors, in words and in order; ``removed`` says which words lie in one or
    in a known phrase across a factor's end.
    """

    def __init__(self, words: tk.Words, found, window: int):
        at, ref_doc, ref_place = self._known(words, found, window)
        seed = np.zeros(len(words.hash) + 1, bool)
        seed[at] = True
        heads, counts = _runs_of(words.doc[at], at, ref_doc, ref_place)
        text, upto, rows = -1, 0, []
        for i, start, count in zip(words.doc[at[heads]].tolist(), at[heads].tolist(), counts.tolist(), strict=True):
            if i != text:
                text, upto = i, 0
            skipped = max(0, upto - start)
            if skipped < count:
                # The phrase at this place is known: the longest match runs to the end of the run's last phrase.
                upto = start + count + window - 1
                rows.append((start + skipped, upto))
        spans = np.array(rows, np.int64).reshape(-1, 2)
        begin, end = spans[:, 0], spans[:, 1]
        here = np.searchsorted(at, begin)
        self.text = words.doc[begin]
        self.start, self.length = begin - words.first[self.text], end - begin
        self.ref_doc, self.ref_start = ref_doc[here], ref_place[here]
        # Known phrases across a factor's end.
        across = (end[:, None] - np.arange(1, window)[None, :]).ravel()
        across = across[seed[across]]
        self.removed = tk.covered(len(words.hash), np.concatenate([begin, across]), np.concatenate([self.length, np.full(len(across), window)]))

    @staticmethod
    def _known(words: tk.Words, found, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of known phrases, ascending, and their reference places; ``found`` has a phrase's first place in a text only."""
        none = np.zeros(0, np.int64)
        rows = [(r["start"] + words.first[i], r["count"], r["ref_doc"], r["ref_start"]) for i, rs in enumerate(found) for r in rs or ()]
        if not rows:
            return none, none, none
        start, count, ref_doc, ref_start = np.array(rows, np.int64).T
        step = tk.ragged(count)
        at, ref_doc, ref_place = np.repeat(start, count) + step, np.repeat(ref_doc, count), np.repeat(ref_start, count) + step
        with np.errstate(over="ignore"):
            key = words.grams(window, _SEED) ^ tk.mix(words.doc[: len(words.doc) - window + 1].astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15))
        whole = words.whole(window)
        order = np.argsort(key[at])
        known = key[at][order]
        place = np.minimum(np.searchsorted(known, key[whole]), len(known) - 1)
        hit = known[place] == key[whole]
        of = order[place[hit]]
        return whole[hit], ref_doc[of], ref_place[of]


def _with_runs(docs: DataFrame, window: int) -> DataFrame:
    return _tagged(docs).join(find_runs(docs, window), ["__tq_doc", "__tq_tag"], "left")


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, factors (array of start, length, ref_doc, ref_start in words)."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])

    def told(batches):
        for batch in batches:
            found = batch.column("__tq_runs").to_pylist()
            for block in tk.blocks(batch.column("text")):
                words = tk.Words(block)
                parse = Parse(words, found[block.lo : block.hi], window)
                data, kept = block.data.tobytes(), np.flatnonzero(~parse.removed)
                bounds = np.searchsorted(kept, words.first)
                starts, ends = words.starts[kept].tolist(), words.ends[kept].tolist()
                digests = [hashlib.sha256(b" ".join([data[a:b] for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)])).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                n_kept = np.diff(bounds)
                flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (parse.start, parse.length, parse.ref_doc, parse.ref_start)], fields=list(kind))
                factors = pa.ListArray.from_arrays(pa.array(np.searchsorted(parse.text, np.arange(block.n + 1)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, block.n), pa.array(words.counts, pa.int64()), pa.array(words.counts - n_kept, pa.int64()), pa.array(digests, pa.string()), factors],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
                )

    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window).select("doc_id", "text", "__tq_runs")
    return rows.mapInArrow(told, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:bigint,length:bigint,ref_doc:bigint,ref_start:bigint>>")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their duplicate spans, other columns as they are.

    White space stays before each kept word; n_chars, where present, follows
    the text; a document of which no word is left goes, one without any word
    in the first place stays.
    """
    columns = docs.columns

    def trimmed(batches):
        at_text = columns.index("text")
        at_chars = columns.index("n_chars") if "n_chars" in columns else -1
        for batch in batches:
            found = batch.column("__tq_runs").to_pylist()
            for block in tk.blocks(batch.column(at_text)):
                words = tk.Words(block)
                removed = Parse(words, found[block.lo : block.hi], window).removed
                gone = np.concatenate([[0], np.cumsum(removed)])
                n_gone = gone[words.first[1:]] - gone[words.first[:-1]]
                texts = batch.column(at_text).slice(block.lo, block.n).to_pylist()
                for i in np.flatnonzero(n_gone):
                    lo, hi = words.first[i], words.first[i + 1]
                    base, raw = block.offsets[i], block.text(i)
                    # A removed word goes with the white space before it.
                    edges = np.concatenate([[base], words.ends[lo:hi]]) - base
                    pieces = [raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(~removed[lo:hi])]
                    texts[i] = (b"".join(pieces).lstrip(b" \t\n\v\f\r") + raw[edges[-1] :]).decode()
                rows = [batch.column(j).slice(block.lo, block.n) for j in range(len(columns))]
                rows[at_text] = pa.array(texts, rows[at_text].type)
                if at_chars >= 0:
                    counts = rows[at_chars].to_pylist()
                    rows[at_chars] = pa.array([len(texts[i]) if n_gone[i] else c for i, c in enumerate(counts)], rows[at_chars].type)
                keep = pa.array((n_gone == 0) | (n_gone < words.counts))
                yield pa.RecordBatch.from_arrays(rows, columns).filter(keep)

    return _with_runs(docs, window).select(*columns, "__tq_runs").mapInArrow(trimmed, docs.schema)
