"""Vectorised text primitives shared by the operators that run on Arrow batches.

Everything works on the UTF-8 bytes of many texts at once: a block is one
``uint8`` array holding the texts back to back plus their offsets.  Blocks are
cut so that temporary arrays stay a small multiple of ``limit`` bytes; one text
larger than the limit forms a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _return_freed_memory() -> None:
    """Lets large arrays go back to the system when they are freed: workers live on between tasks of different shapes."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows up to 32 MB
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


_return_freed_memory()

U64 = np.uint64
BLOCK_BYTES = 3_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed by a fixed rule."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return mix(base + U64(seed)) | U64(1)


#: One random 64-bit value for each byte value.
BYTE_CODE = constants(11, 256)
_ROOT = int(constants(12, 1)[0]) & ~7 | 5
_INVERSE = pow(_ROOT, -1, 1 << 64)
_powers = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for root in (_ROOT, _INVERSE):
            steps = np.full(size, root, U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tuple(tables)
    return _powers


#: Bytes of words between ASCII white space (\x20, \x09-\x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters a-z and everything beyond ASCII; A-Z count once folded.
FOLDED = np.zeros(256, bool)
FOLDED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


class Block:
    """Texts lo..hi-1 of an Arrow batch as bytes; ``offsets`` has one entry more than there are texts."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.n = hi - lo

    def folded(self) -> Block:
        return Block(self.lo, self.hi, FOLD[self.data], self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts an Arrow string array into blocks of about ``limit`` bytes; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def spans(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``member`` that don't cross texts: starts, ends, and the count of runs before each text."""
    inside = member[block.data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = block.offsets[:-1]
    before[edges[edges < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = block.offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one prefix sum over all bytes."""
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * power[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * inverse[starts]
        return mix(value + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


class Words:
    """Words of a block: byte ranges, hashes, and for each text the index of its first word."""

    def __init__(self, block: Block, member: np.ndarray = SPACED):
        self.block = block
        self.starts, self.ends, self.first = spans(block, member)
        self.hash = span_hashes(block.data, self.starts, self.ends)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(block.n), self.counts)

    def grams(self, k: int, seed: int) -> np.ndarray:
        """A hash for each start of k consecutive words, whether or not they lie in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            out = np.zeros(n, U64)
            for j, m in enumerate(constants(seed, k)):
                out += self.hash[j : n + j] * m
            return mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Starts of k consecutive words that lie in one text."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a range of ``length`` from one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, which general compressors shrink when high bytes are zero."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def ids(column: pa.Array, absent: int) -> np.ndarray:
    """An integer Arrow column as int64; nulls become ``absent``."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), absent))
