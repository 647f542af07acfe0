"""VCD files as a Spark data source.

The header is read once.  The body is cut into byte ranges that start at a line
with a time, so every range knows its time and is parsed by a task of its own,
vectorised over all its lines, into Arrow batches.  ``seq`` is a line's byte
offset, which orders changes of one tick.

Values before the first time belong to time 0; a line's first byte says what
it is, whatever bytes its id code has; lines are trimmed, and a carriage
return at their end is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import SIGNALS, WAVE, LoadError

CHUNK = 8 << 20
LAST_TICK = (1 << 63) - 1
SCALAR, VECTOR, REAL, TEXT = 0, 1, 2, 3
_UNITS = {"s": 0, "ms": -3, "us": -6, "ns": -9, "ps": -12, "fs": -15}


def open_path(path: str):
    """A file system and the path in it, for plain paths and URIs."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def timescale_exponent(raw: str | None) -> int | None:
    """The power of ten of a timescale's unit; its number counts extra."""
    m = re.fullmatch(r"(\d+)\s*(s|ms|us|ns|ps|fs)", (raw or "").strip())
    return _UNITS[m[2]] if m else None


def timescale_seconds(raw: str | None) -> float | None:
    exponent = timescale_exponent(raw)
    return None if exponent is None else int(re.match(r"\s*(\d+)", raw)[1]) * 10.0**exponent


@dataclass
class Header:
    date: str | None = None
    version: str | None = None
    timescale: str | None = None
    #: Rows of the signal dictionary.
    names: list[dict] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    body: int = 0


def parse_header(data: bytes) -> Header | None:
    """The header of a file that starts with these bytes; None if they end before it does."""
    # Comments may hold anything; blanks keep the places of what follows.
    plain = re.sub(rb"\$comment\b.*?\$end\b", lambda m: b" " * len(m[0]), data, flags=re.DOTALL)
    end = re.search(rb"\$enddefinitions\s+\$end", plain)
    if not end or b"$comment" in plain[: end.start()]:
        return None
    head, scopes = Header(), []
    for word, rest in re.findall(r"\$(\w+)\s(.*?)\$end", plain[: end.start()].decode("utf-8", "replace") + "\n", re.DOTALL):
        parts = rest.split()
        text = " ".join(parts) or None
        if word in ("date", "version", "timescale"):
            setattr(head, word, text)
        elif word == "scope" and parts:
            scopes.append(parts[-1])
        elif word == "upscope" and scopes:
            scopes.pop()
        elif word == "var" and len(parts) >= 4:
            kind, size, code, reference = parts[:4]
            bits = "".join(parts[4:]) or None
            alias = code in head.ids
            known = head.ids.setdefault(code, len(head.ids))
            head.names.append({
                "signal_id": known, "signal_name": ".".join([*scopes, reference]) + (bits or ""), "var_type": kind, "size": int(size) if size.isdigit() else None, "id_code": code,
                "range": bits, "scope": ".".join(scopes) or None, "reference": reference, "handle": None, "direction": None, "is_alias": alias,
            })
    newline = data.find(b"\n", end.end())
    head.body = len(data) if newline < 0 else newline + 1
    if newline < 0 and data[end.end() :].strip():
        head.body = end.end()
    return head


def read_header(path: str) -> Header:
    system, inner = open_path(path)
    try:
        with system.open_input_file(inner) as f:
            data, seen = bytearray(), 0
            while more := f.read(1 << 20):
                data += more
                # Only parsed where the end may have come.
                if data.find(b"$enddefinitions", seen) >= 0 and (head := parse_header(bytes(data))) is not None and (head.body < len(data) or not f.read(1)):
                    return head
                seen = max(0, len(data) - 64) if data.find(b"$enddefinitions", seen) < 0 else seen
                f.seek(len(data))
            data = bytes(data)
    except (FileNotFoundError, OSError) as e:
        raise LoadError(f"can't read {path}: {e}") from e
    if (head := parse_header(data)) is not None:
        return head
    raise LoadError(f"{path} has no complete VCD header")


def cuts(path: str, body: int, n: int) -> list[tuple[int, int]]:
    """At most n byte ranges; all but the first start at a line with a time."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        starts = [body]
        for i in range(1, n):
            at, tail = max(body + (size - body) * i // n - 1, starts[-1]), b""
            f.seek(at)
            while more := f.read(1 << 16):
                m = re.search(rb"\n[ \t]*#", tail + more)
                if m:
                    starts.append(at - len(tail) + m.start() + 1)
                    break
                at, tail = at + len(more), more[-64:]
            else:
                break
        starts = sorted(set(starts))
        return list(zip(starts, [*starts[1:], size], strict=True))


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as strings."""
    sizes = np.maximum(ends - starts, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes()))


def _floats(texts: pa.Array) -> np.ndarray:
    """Texts as numbers; nan where they are none."""
    try:
        return np.asarray(pc.cast(texts, pa.float64()))
    except pa.ArrowInvalid:
        number = pc.match_substring_regex(texts, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?(inf|infinity|nan)$")
        return np.asarray(pc.cast(pc.if_else(number, texts, pa.scalar("nan", texts.type)), pa.float64()))


class Body:
    """Parses pieces of a body in order, carrying the time on."""

    def __init__(self, ids: dict[str, int]):
        codes = list(ids)
        self.codes = pa.array(codes, pa.large_string())
        self.numbers = np.array([ids[c] for c in codes] or [0], np.int64)
        self.by_code = {c.encode(): n for c, n in ids.items()}
        self.lengths = sorted({len(c) for c in self.by_code}, reverse=True)
        self.time = 0

    def _suffix(self, line: bytes) -> tuple[int, bytes] | None:
        """The longest declared code that ends a line after something else."""
        for n in self.lengths:
            if n < len(line) and (number := self.by_code.get(line[-n:])) is not None:
                return number, line[:-n]
        return None

    def parse(self, raw: bytes, offset: int) -> pa.Table:
        raw = re.sub(rb"\$comment\b.*?\$end", lambda m: re.sub(rb"[^\n]", b" ", m[0]), raw, flags=re.DOTALL) if b"$comment" in raw else raw
        data = np.frombuffer(raw + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        blank = np.zeros(256, bool)
        blank[[9, 11, 12, 13, 32]] = True
        while (m := (starts < ends) & blank[data[starts]]).any():
            starts = starts + m
        while (m := (starts < ends) & blank[data[ends - 1]]).any():
            ends = ends - m
        full = starts < ends
        starts, ends = starts[full], ends[full]
        first = data[starts]
        is_time = first == ord("#")
        times = np.zeros(0, np.int64)
        if is_time.any():
            try:
                times = np.asarray(pc.cast(_slices(data, starts[is_time] + 1, ends[is_time]), pa.uint64()))
            except pa.ArrowInvalid as e:
                raise LoadError(f"bad time near byte {offset}: {e}") from e
            if (times > LAST_TICK).any():
                raise LoadError("a time is beyond 2**63 - 1")
            times = times.astype(np.int64)
        clock = np.concatenate([[self.time], times])[np.cumsum(is_time)]
        self.time = int(clock[-1]) if len(clock) else self.time
        keep = ~is_time & (first != ord("$"))
        starts, ends, first, clock = starts[keep], ends[keep], first[keep], clock[keep]

        kind = np.full(len(starts), SCALAR, np.int8)
        kind[np.isin(first, list(b"bB"))] = VECTOR
        kind[np.isin(first, list(b"rR"))] = REAL
        kind[np.isin(first, list(b"sS"))] = TEXT
        # The code is what follows the last blank, or the first byte of a scalar.
        blanks = np.flatnonzero(data == 32)
        if (data == 9).any():
            blanks = np.flatnonzero((data == 32) | (data == 9))
        last = blanks[np.searchsorted(blanks, ends) - 1] if len(blanks) else np.full(len(ends), -1)
        spaced = (last > starts) & (last < ends)
        code_at = np.where(kind == SCALAR, starts + 1, np.where(spaced, last + 1, ends))
        value_at = np.where(kind == SCALAR, starts, starts + 1)
        value_end = np.where(kind == SCALAR, starts + 1, np.where(spaced, last, ends))
        found = np.asarray(pc.fill_null(pc.index_in(_slices(data, code_at, ends), self.codes), -1)) if len(self.codes) else np.full(len(starts), -1)
        signal = np.where(found >= 0, self.numbers[np.maximum(found, 0)], -1)
        values = pc.utf8_trim_whitespace(_slices(data, value_at, value_end))
        odd = np.flatnonzero(signal < 0)
        if len(odd):
            texts = values.to_pylist()
            for i in odd.tolist():
                hit = self._suffix(raw[starts[i] : ends[i]])
                if hit:
                    signal[i] = hit[0]
                    text = hit[1].decode("utf-8", "replace").strip()
                    if kind[i] == SCALAR and len(text) > 1:
                        kind[i] = VECTOR
                    texts[i] = text if kind[i] in (SCALAR, VECTOR) and first[i] not in b"bB" else text[1:]
            values = pa.array(texts, pa.large_string())
        good = np.flatnonzero(signal >= 0)
        pick = pa.array(good)
        values, kind = values.take(pick), kind[good]
        low = pc.utf8_lower(values)
        scalar = np.full(len(good), 255, np.int16)
        for text, number in (("0", 0), ("1", 1), ("x", 2), ("z", 3)):
            scalar[np.asarray(pc.equal(low, text)).astype(bool)] = number
        real = kind == REAL
        reals = np.full(len(good), np.nan)
        if real.any():
            reals[real] = _floats(values.filter(pa.array(real)))
        return pa.table(
            [
                pa.array(clock[good]), pa.array(offset + starts[good], pa.int64()), pa.array(signal[good], pa.int64()), values.cast(pa.string()), pa.array(kind, pa.int8()),
                pa.array(scalar, mask=kind != SCALAR), pa.array(reals, mask=~real | np.isnan(reals)),
            ],
            schema=to_arrow_schema(WAVE),
        )


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _WaveReader(DataSourceReader):
    def __init__(self, path: str, shards: int | None, shard_bytes: int, by_signal: bool = False):
        self.path, self.by_signal = path, by_signal
        head = read_header(path)
        self.ids, self.body = head.ids, head.body
        system, inner = open_path(path)
        size = system.get_file_info(inner).size or 0
        self.shards = shards or max(1, -(-(size - head.body) // shard_bytes))

    def partitions(self):
        return [Range(a, b) for a, b in cuts(self.path, self.body, self.shards)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not self.by_signal:
            for piece in self._pieces(partition):
                yield from piece.to_batches(64 << 10)
            return
        # The pieces come in order, so a stable sort by signal leaves each signal's changes in theirs.
        pieces = list(self._pieces(partition))
        if pieces:
            signal = np.concatenate([np.asarray(p.column("signal_id")) for p in pieces])
            order = np.argsort(signal, kind="stable")
            whole = pa.concat_tables(pieces).combine_chunks()
            del pieces
            for lo in range(0, len(order), 64 << 10):
                yield from whole.take(pa.array(order[lo : lo + (64 << 10)])).to_batches()

    def _pieces(self, partition: Range) -> Iterator[pa.Table]:
        body, at, tail = Body(self.ids), partition.start, b""
        system, inner = open_path(self.path)
        with system.open_input_file(inner) as f:
            f.seek(at)
            left = partition.end - at
            while left > 0:
                more = f.read(min(CHUNK, left))
                if not more:
                    break
                left -= len(more)
                piece = tail + more
                stop = len(piece) if left <= 0 else piece.rfind(b"\n") + 1
                piece, tail = piece[:stop], piece[stop:]
                if piece:
                    yield body.parse(piece, at)
                at += stop


class _NameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(read_header(self.path).names, schema=to_arrow_schema(SIGNALS))


class VcdSource(DataSource):
    """``spark.read.format("vcd").load(path)``; options: table (wave or signals), shards, shard_bytes, by_signal.

    With ``by_signal`` each range's changes come by signal, and by time for each
    signal; a range is then held by its task, so cut ranges small.
    """

    @classmethod
    def name(cls) -> str:
        return "vcd"

    def _table(self) -> str:
        return self.options.get("table", "wave")

    def schema(self):
        return SIGNALS if self._table() == "signals" else WAVE

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        if self._table() == "signals":
            return _NameReader(path)
        shards = self.options.get("shards")
        return _WaveReader(path, int(shards) if shards else None, int(self.options.get("shard_bytes", 64 << 20)), self.options.get("by_signal", "false").lower() == "true")


def register(spark) -> None:
    spark.dataSource.register(VcdSource)
