"""FST recordings as a Spark data source.

An FST file is a row of blocks.  The header, the geometry (bit lengths) and the
hierarchy are read once; every value-change block is a partition of its own,
since each has its own time table and chains.  Chains packed with zlib or LZ4
are read, and those that aren't packed; FastLZ ones are an error.  The value
frame of the first block gives the values at its start.

``seq`` grows along each signal's changes; the format keeps no order between
signals within a tick.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import SIGNALS, WAVE, LoadError
from .vcd import LAST_TICK, REAL, SCALAR, TEXT, VECTOR, open_path

HEADER, CHANGES, GEOMETRY, HIERARCHY, CHANGES_ALIAS, HIERARCHY_LZ4, HIERARCHY_LZ4_TWICE, CHANGES_ALIAS_2, WRAPPER = 0, 1, 3, 4, 5, 6, 7, 8, 254
SCOPE, UPSCOPE, ATTRIBUTE, ATTRIBUTE_END = 254, 255, 252, 253
#: Names by number in the format.  Fixed values.
VAR_TYPES = (
    "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor port sparray realtime "
    "string bit logic int shortint longint byte enum shortreal"
).split()
DIRECTIONS = "implicit input output inout buffer linkage".split()
UNKNOWN = "xzhuwl-?"
BATCH = 1 << 16


@dataclass
class Recording:
    version: str = ""
    date: str = ""
    exponent: int = 0
    start: int = 0
    end: int = 0
    max_handle: int = 0
    big_endian: bool = False
    #: Bit length of each handle; 0 for strings, -1 for reals.
    lengths: list[int] = field(default_factory=list)
    names: list[dict] = field(default_factory=list)
    #: Kind, offset after the kind and length of each value-change block.
    blocks: list[tuple[int, int, int]] = field(default_factory=list)


class Cursor:
    """Reads numbers and strings from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def signed(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value - (1 << shift) if b & 0x40 else value

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]


def _lz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def _inflate(data: bytes, size: int) -> bytes:
    return data if len(data) == size else zlib.decompress(data)


def parse_hierarchy(data: bytes) -> list[dict]:
    c, scopes, names, handle = Cursor(data), [], [], 0
    while c.at < len(data):
        tag = c.byte()
        if tag == SCOPE:
            c.byte()
            scopes.append(c.text())
            c.text()
        elif tag == UPSCOPE:
            scopes = scopes[:-1]
        elif tag == ATTRIBUTE:
            c.take(2)
            c.text()
            c.varint()
        elif tag < len(VAR_TYPES):
            direction, name, length, alias = c.byte(), c.text(), c.varint(), c.varint()
            if not alias:
                handle += 1
            own = alias or handle
            names.append({
                "signal_id": own - 1, "signal_name": ".".join([*scopes, name]), "var_type": VAR_TYPES[tag], "size": length, "id_code": None, "range": None, "scope": ".".join(scopes) or None,
                "reference": name, "handle": own, "direction": DIRECTIONS[direction] if direction < len(DIRECTIONS) else None, "is_alias": bool(alias),
            })
        elif tag != ATTRIBUTE_END:
            raise LoadError(f"unknown hierarchy tag {tag}")
    return names


def _wrapped(f) -> bytes | None:
    """The whole content of a file that is one compressed block."""
    f.seek(0)
    if f.read(1) != bytes([WRAPPER]):
        return None
    f.read(16)
    return gzip.decompress(f.read())


def open_fst(path: str):
    """A readable, seekable file of plain blocks."""
    import io

    system, inner = open_path(path)
    try:
        f = system.open_input_file(inner)
        inside = _wrapped(f)
    except (FileNotFoundError, OSError) as e:
        raise LoadError(f"can't read {path}: {e}") from e
    if inside is not None:
        return io.BytesIO(inside)
    f.seek(0)
    return f


def read_recording(path: str) -> Recording:
    out = Recording()
    with open_fst(path) as f:
        at = 0
        while kind := f.read(1):
            kind, (length,) = kind[0], struct.unpack(">Q", f.read(8))
            body = at + 9
            if at == 0 and kind != HEADER:
                raise LoadError(f"{path} doesn't start with an FST header")
            if kind in (HEADER, GEOMETRY, HIERARCHY, HIERARCHY_LZ4, HIERARCHY_LZ4_TWICE):
                data = f.read(length - 8)
                if kind == HEADER:
                    out.start, out.end = struct.unpack_from(">QQ", data)
                    out.big_endian = struct.unpack_from(">d", data, 16)[0] == 2.7182818284590452354
                    out.max_handle = struct.unpack_from(">Q", data, 48)[0]
                    out.exponent = struct.unpack_from("b", data, 64)[0]
                    out.version, out.date = (data[a:b].split(b"\0")[0].decode("utf-8", "replace").strip() for a, b in ((65, 193), (193, 312)))
                elif kind == GEOMETRY:
                    size, count = struct.unpack_from(">QQ", data)
                    c = Cursor(_inflate(data[16:], size))
                    out.lengths = [{0: -1, 0xFFFFFFFF: 0}.get(n, n) for n in (c.varint() for _ in range(count))]
                else:
                    (size,) = struct.unpack_from(">Q", data)
                    if kind == HIERARCHY:
                        plain = gzip.decompress(data[8:])
                    elif kind == HIERARCHY_LZ4:
                        plain = _lz4(data[8:], size)
                    else:
                        c = Cursor(data, 8)
                        once = c.varint()
                        plain = _lz4(_lz4(data[c.at :], once), size)
                    out.names = parse_hierarchy(plain)
            elif kind in (CHANGES, CHANGES_ALIAS, CHANGES_ALIAS_2):
                out.blocks.append((kind, body, length - 8))
            at += 1 + length
            f.seek(at)
    return out


def _chains(kind: int, table: bytes, end: int) -> list[tuple[int, int]]:
    """Offset and length of each handle's chain; (0, 0) where it has none."""
    c, offsets, alias, last, at = Cursor(table), [], [], None, 0
    sizes: list[int] = []

    def opened(delta: int):
        nonlocal at, last
        at += delta
        if last is not None:
            sizes[last] = at - offsets[last]
        last = len(offsets)
        offsets.append(at)
        sizes.append(0)
        alias.append(None)

    def other(handle: int | None):
        offsets.append(0)
        sizes.append(0)
        alias.append(handle)

    before = None
    while c.at < len(table):
        if kind == CHANGES_ALIAS_2 and table[c.at] & 1:
            value = c.signed() >> 1
            if value > 0:
                opened(value)
            else:
                before = -value - 1 if value < 0 else before
                other(before)
            continue
        value = c.varint()
        if kind != CHANGES_ALIAS_2 and not value:
            other(c.varint() - 1)
        elif kind != CHANGES_ALIAS_2 and value & 1:
            opened(value >> 1)
        else:
            for _ in range(value >> 1):
                other(None)
    if last is not None:
        sizes[last] = end - offsets[last]
    out = list(zip(offsets, sizes, strict=True))
    for i, a in enumerate(alias):
        if a is not None and a < i:
            out[i] = out[a]
    return out


def _unpack(data: bytes, pack: str) -> bytes:
    c = Cursor(data)
    size = c.varint()
    rest = data[c.at :]
    if not size:
        return rest
    if pack == "4":
        return _lz4(rest, size)
    if pack == "F":
        raise LoadError("FastLZ-packed FST chains can't be read")
    return zlib.decompress(rest)


def _changes(chain: bytes, length: int, big_endian: bool) -> Iterator[tuple[int, str]]:
    """(time index, value) of one handle's chain."""
    c, at = Cursor(chain), 0
    double = ">d" if big_endian else "<d"
    while c.at < len(chain):
        v = c.varint()
        if length == 1:
            at += v >> (4 if v & 1 else 2)
            yield at, UNKNOWN[v >> 1 & 7] if v & 1 else "01"[v >> 1 & 1]
            continue
        at += v >> 1
        if length == 0:
            yield at, c.take(c.varint()).decode("utf-8", "replace")
        elif length < 0:
            yield at, repr(struct.unpack(double, c.take(8))[0])
        elif v & 1:
            yield at, c.take(length).decode("ascii", "replace")
        else:
            n = (length + 7) // 8
            yield at, f"{int.from_bytes(c.take(n), 'big') >> (8 * n - length):0{length}b}"


class Block(InputPartition):
    def __init__(self, number: int, kind: int, at: int, size: int):
        self.number, self.kind, self.at, self.size = number, kind, at, size


def read_block(data: bytes, block: Block, info: Recording) -> Iterator[tuple[int, int, int, str]]:
    """(timestamp, seq, signal_id, value) of one value-change block."""
    c = Cursor(data, 24)
    size, packed, n = c.varint(), c.varint(), c.varint()
    frame = _inflate(c.take(packed), size)
    c.varint()
    waves = c.at
    pack = chr(c.byte())
    t_size, t_packed, t_count = struct.unpack_from(">QQQ", data, len(data) - 24)
    t_at = len(data) - 24 - t_packed
    t = Cursor(_inflate(data[t_at : t_at + t_packed], t_size))
    times, now = [], 0
    for _ in range(t_count):
        now += t.varint()
        times.append(now)
    if times and times[-1] > LAST_TICK:
        raise LoadError("a time is beyond 2**63 - 1")
    (table_size,) = struct.unpack_from(">Q", data, t_at - 8)
    table = data[t_at - 8 - table_size : t_at - 8]
    base = block.number << 40
    double = ">d" if info.big_endian else "<d"
    if block.number == 0:
        (start,) = struct.unpack_from(">Q", data)
        f = Cursor(frame)
        for h, length in enumerate(info.lengths[:n]):
            if length:
                raw = f.take(8 if length < 0 else length)
                yield start, base, h, repr(struct.unpack(double, raw)[0]) if length < 0 else raw.decode("ascii", "replace")
    for h, (at, length) in enumerate(_chains(block.kind, table, t_at - 8 - table_size - waves)):
        if length:
            chain = _unpack(data[waves + at : waves + at + length], pack)
            for i, (k, value) in enumerate(_changes(chain, info.lengths[h], info.big_endian)):
                yield times[k], base + 1 + i, h, value


def _batch(rows: list[tuple[int, int, int, str]], lengths: list[int]) -> pa.RecordBatch:
    codes = {"0": 0, "1": 1, "x": 2, "z": 3}
    kinds = [{1: SCALAR, -1: REAL, 0: TEXT}.get(lengths[h], VECTOR) for _, _, h, _ in rows]
    data = {
        "timestamp": [r[0] for r in rows], "seq": [r[1] for r in rows], "signal_id": [r[2] for r in rows], "value_raw": [r[3] for r in rows], "value_kind": kinds,
        "value_scalar": [codes.get(r[3].lower(), 255) if k == SCALAR else None for r, k in zip(rows, kinds, strict=True)],
        "value_real": [float(r[3]) if k == REAL else None for r, k in zip(rows, kinds, strict=True)],
    }
    return pa.RecordBatch.from_pydict(data, schema=to_arrow_schema(WAVE))


class _WaveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.info = path, read_recording(path)

    def partitions(self):
        return [Block(i, *b) for i, b in enumerate(self.info.blocks)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with open_fst(self.path) as f:
            f.seek(partition.at)
            data = f.read(partition.size)
        rows = []
        for row in read_block(data, partition, self.info):
            rows.append(row)
            if len(rows) >= BATCH:
                yield _batch(rows, self.info.lengths)
                rows = []
        if rows:
            yield _batch(rows, self.info.lengths)


class _NameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(read_recording(self.path).names, schema=to_arrow_schema(SIGNALS))


class FstSource(DataSource):
    """``spark.read.format("fst").load(path)``; option table: wave or signals."""

    @classmethod
    def name(cls) -> str:
        return "fst"

    def schema(self):
        return SIGNALS if self.options.get("table") == "signals" else WAVE

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        return _NameReader(path) if self.options.get("table") == "signals" else _WaveReader(path)


def register(spark) -> None:
    spark.dataSource.register(FstSource)
