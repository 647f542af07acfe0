"""Token counts of fields and sections from one encoding of each whole document.

Each document is encoded once, whole.  The byte lengths of its tokens add up
to token spans; an interval join with the sections' spans attributes every
token to the section in which it starts.  A token that reaches past its
section's end crosses a boundary: ``rule="start"`` counts it for the section
where it starts, ``rule="end"`` for the section where its last byte lies, and
``rule="most"`` for the section with most of its bytes, the earlier one on a
tie.  Every token counts once under each rule, so the sections' counts add up
to the document's.

A document's sections are its blocks of lines: a section ends after a line
break, and lines that are white space only belong to the section before them.

Defined results: a null or empty text is one empty section without tokens;
repeated rows are counted each; an empty table gives no rows; extra columns
are not read.  Spans are counted in code points, from 0, ends exclusive.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteEncoder:
    """A byte-level encoder and the byte length of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte offset after each token of a text."""
        return np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])


def sections(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all sections, and the count of sections before each text."""
    starts, ends, first = tk.spans(block, _NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(tk.SPACED[block.data])])
    worded = filled[ends] > filled[starts]
    doc = np.repeat(np.arange(block.n), np.diff(first))[worded]
    starts = starts[worded]
    # The first section of a text starts with it.
    opens = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    starts[opens] = block.offsets[doc[opens]]
    bare = np.setdiff1d(np.arange(block.n), doc)
    starts, doc = np.concatenate([starts, block.offsets[bare]]), np.concatenate([doc, bare])
    order = np.lexsort((starts, doc))
    return starts[order], np.searchsorted(doc[order], np.arange(block.n + 1))


def attribute(starts: np.ndarray, token_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary; all as offsets in one text."""
    token_starts = token_ends - np.diff(token_ends, prepend=0)
    a = np.searchsorted(starts, token_starts, "right") - 1
    b = np.searchsorted(starts, token_ends - 1, "right") - 1
    if rule == "start":
        return a, b > a
    if rule == "end":
        return b, b > a
    best = a.copy()
    for i in np.flatnonzero(b > a):
        cuts = np.concatenate([[token_starts[i]], starts[a[i] + 1 : b[i] + 1], [token_ends[i]]])
        best[i] = a[i] + int(np.argmax(np.diff(cuts)))
    return best, b > a


def count(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """One row for each section: doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens."""
    if rule not in ("start", "end", "most"):
        raise ValueError(f"unknown rule {rule}")

    def counted(batches):
        encoder = ByteEncoder(path, pattern)
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                starts, first = sections(block)
                chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                stops = np.append(starts[1:], block.offsets[-1])
                n_sections = np.diff(first)
                doc = np.repeat(np.arange(block.n), n_sections)
                stops[first[1:] - 1] = block.offsets[1:]
                n, crossing, all_tokens = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(block.n, np.int64)
                for i in range(block.n):
                    ends = encoder.ends(block.text(i).decode())
                    lo, hi = first[i], first[i + 1]
                    at, over = attribute(starts[lo:hi] - block.offsets[i], ends, rule)
                    n[lo:hi] = np.bincount(at, minlength=hi - lo)
                    crossing[lo:hi] = np.bincount(at[over], minlength=hi - lo)
                    all_tokens[i] = len(ends)
                base = chars[block.offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, block.n).take(pa.array(doc)), *map(pa.array, (tk.ragged(n_sections), chars[starts] - base, chars[stops] - base, n, crossing, all_tokens[doc]))],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(counted, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")
