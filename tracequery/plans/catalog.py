"""Loaded traces: ingestion to sorted Parquet, its cache, views, status."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SIGNALS, TRACE_INFO, WAVE, LoadError, NotLoadedError
from ..sources import fst, vcd

VERSION = "1"
SHARD_BYTES = 32 << 20


def shard_count(size: int, cores: int) -> int:
    """How many ranges a file of ``size`` bytes is parsed in: one for each SHARD_BYTES, a core's worth at least for files of that size.

    TRACEQUERY_SHARDS sets the number; TRACEQUERY_MIN_SHARDS and
    TRACEQUERY_MAX_SHARDS bound it.
    """
    if (fixed := os.environ.get("TRACEQUERY_SHARDS", "")).isdigit():
        return max(1, int(fixed))
    n = max(-(-size // SHARD_BYTES), min(cores, -(-size // (1 << 20))), 1)
    least, most = os.environ.get("TRACEQUERY_MIN_SHARDS", ""), os.environ.get("TRACEQUERY_MAX_SHARDS", "")
    n = max(n, int(least)) if least.isdigit() else n
    return min(n, max(1, int(most))) if most.isdigit() else n


class Trace:
    """The three tables of a loaded trace."""

    def __init__(self, path: str, cache: str, wave: DataFrame, signals: DataFrame, info: DataFrame):
        self.path, self.cache, self.wave, self.signals, self.info = path, cache, wave, signals, info
        self._bounds: tuple[int, int] | None = None

    @property
    def bounds(self) -> tuple[int, int]:
        if self._bounds is None:
            row = self.info.select("start_time", "end_time").first()
            self._bounds = (row[0] or 0, row[1] or 0)
        return self._bounds


class TraceCatalog:
    """Loads files into a cache folder and keeps them by path; the last one loaded is current.

    The cache of a file is used as long as the file's size and time and the
    version of the layout stay.  Without a cache folder, it lies in a folder
    beside the recording.  Every written file has the changes of a time range,
    sorted by signal and time, so a query of a few signals or of a short time
    reads few pages; the recording is parsed once and nothing is shuffled.
    """

    def __init__(self, spark: SparkSession, cache_dir: str | None = None):
        self.spark, self.cache_dir = spark, cache_dir and cache_dir.rstrip("/")
        self.traces: dict[str, Trace] = {}
        self.current: str | None = None
        vcd.register(spark)
        fst.register(spark)

    def _fingerprint(self, path: str) -> str:
        system, inner = vcd.open_path(path)
        info = system.get_file_info(inner)
        if not info.is_file:
            raise LoadError(f"no file {path}")
        tag = os.environ.get("TRACEQUERY_CACHE_TAG", "")
        return hashlib.sha256(f"{path}\0{info.size}\0{info.mtime_ns}\0{VERSION}\0{tag}".encode()).hexdigest()[:24]

    def _read(self, path: str, cache: str) -> Trace:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{cache}/{name}")
        return Trace(path, cache, read("wave", WAVE), read("signals", SIGNALS), read("trace_info", TRACE_INFO))

    def _ingest(self, path: str, cache: str, fingerprint: str, shards: int | None) -> None:
        if path.lower().endswith(".fst"):
            wave = self.spark.read.format("fst").option("path", path).load().sortWithinPartitions("signal_id", "timestamp", "seq")
            r = fst.read_recording(path)
            names, about = r.names, ("fst", r.version or None, r.date or None, None, 10.0**r.exponent, r.exponent, r.start, r.end, len(r.names), r.max_handle)
        else:
            system, inner = vcd.open_path(path)
            shards = shards or shard_count(system.get_file_info(inner).size, self.spark.sparkContext.defaultParallelism)
            wave = self.spark.read.format("vcd").option("path", path).option("shards", shards).option("by_signal", True).load()
            head = vcd.read_header(path)
            names, about = head.names, ("vcd", head.version, head.date, head.timescale, vcd.timescale_seconds(head.timescale), vcd.timescale_exponent(head.timescale), None, None, len(head.names), None)
        wave.write.mode("overwrite").parquet(f"{cache}/wave")
        self.spark.createDataFrame([tuple(n[c] for c in SIGNALS.names) for n in names], SIGNALS).coalesce(1).write.mode("overwrite").parquet(f"{cache}/signals")
        lo, hi = self.spark.read.schema(WAVE).parquet(f"{cache}/wave").agg(F.min("timestamp"), F.max("timestamp")).first()
        row = (*about[:6], lo if about[6] is None else about[6], hi if about[7] is None else about[7], *about[8:], path, fingerprint)
        # Written last: a cache without it isn't complete.
        self.spark.createDataFrame([row], TRACE_INFO).coalesce(1).write.mode("overwrite").parquet(f"{cache}/trace_info")

    def load(self, path: str, shards: int | None = None, force: bool = False) -> Trace:
        fingerprint = self._fingerprint(path)
        folder = self.cache_dir or f"{path.rsplit('/', 1)[0] if '/' in path else '.'}/.tracequery"
        cache = f"{folder}/{re.sub(r'[^A-Za-z0-9_.-]', '_', path.rsplit('/', 1)[-1])}-{fingerprint}"
        fresh = False
        if not force:
            try:
                fresh = self._read(path, cache).info.where(F.col("fingerprint") == fingerprint).count() == 1
            except Exception:  # noqa: BLE001  no cache yet
                fresh = False
        if not fresh:
            self._ingest(path, cache, fingerprint, shards)
        trace = self._read(path, cache)
        self.traces[path], self.current = trace, path
        for name, df in (("wave", trace.wave), ("signals", trace.signals), ("trace_info", trace.info)):
            df.createOrReplaceTempView(name)
        return trace

    def unload(self, path: str | None = None) -> str | None:
        """Forgets a trace, the current one by default; returns its path."""
        path = path or self.current
        if path not in self.traces:
            return None
        del self.traces[path]
        if path == self.current:
            self.current = None
            for name in ("wave", "signals", "trace_info"):
                self.spark.catalog.dropTempView(name)
        return path

    def get(self, path: str | None = None) -> Trace:
        path = path or self.current
        if path is None or path not in self.traces:
            raise NotLoadedError("no trace is loaded")
        return self.traces[path]

    def status(self) -> dict:
        if self.current is None:
            return {"status": "no_file_loaded", "loaded_file": None}
        trace = self.get()
        lo, hi = trace.bounds
        return {"status": "ok", "loaded_file": trace.path, "signal_count": trace.signals.select("signal_id").distinct().count(), "start_time": lo, "end_time": hi}
