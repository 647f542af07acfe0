"""Side-by-side metrics of traces: busy time, handshakes, windows and gaps."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import first_bit
from .semantics import interval_summary
from .steps import neighbours, sweep

def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _intervals(traces: dict[str, tuple[DataFrame, DataFrame]], busy: str, handshakes: dict[str, tuple[str, str]], slice_ticks: int | None) -> DataFrame:
    """(trace, metric, t_start, t_end) where the busy signal, or both signals of a handshake, are 1; all traces in one pass."""
    wanted = sorted({busy, *(n for names in handshakes.values() for n in names)})
    key = lambda label: F.concat(F.lit(f"{label}/"), F.col("signal_id").cast("string")).alias("signal_id")
    waves = _union([wave.select(F.lit(t).alias("trace"), "timestamp", "seq", key(t), "value_raw") for t, (wave, _) in traces.items()])
    names = _union([signals.where(F.col("signal_name").isin(wanted)).select(F.lit(t).alias("trace"), key(t), "signal_name") for t, (_, signals) in traces.items()]).distinct()
    spark = waves.sparkSession
    ends = waves.groupBy("trace").agg((F.max("timestamp") + 1).alias("trace_end"))
    ids = lambda c: names.select("trace", F.col("signal_name").alias(c), F.col("signal_id").alias(f"{c}_id"))
    asked = spark.createDataFrame([(m, *vr) for m, vr in handshakes.items()], "metric string, a string, b string")
    pairs = asked.join(ids("a"), "a").join(ids("b"), ["trace", "b"]).select("trace", "metric", F.concat_ws("/", "trace", "metric").alias("pair"), "a_id", "b_id")
    # Names asked for, in each trace.
    own = waves.join(F.broadcast(names.select("signal_id", "signal_name")), "signal_id")
    alone = neighbours(own.where(F.col("signal_name") == busy)).where(first_bit(F.col("value_raw")) == 1)
    alone = alone.select("trace", F.lit("busy").alias("metric"), F.col("timestamp").alias("t_start"), F.col("next_time").alias("t_end"))
    both = sweep(own.drop("trace", "signal_name"), pairs, None, None, first_bit, slice_ticks).where("a_bit = 1 and b_bit = 1")
    both = both.join(F.broadcast(pairs.select("pair", "trace", "metric")), "pair").select("trace", "metric", "t_start", "t_end")
    held = alone.unionByName(both).join(F.broadcast(ends), "trace")
    return held.select("trace", "metric", "t_start", F.coalesce("t_end", "trace_end").alias("t_end")).where("t_end > t_start")


def metrics(traces: dict[str, tuple[DataFrame, DataFrame]], busy: str, handshakes: dict[str, tuple[str, str]], command: str, response: str, slice_ticks: int | None = None) -> DataFrame:
    """(trace, metric, n, total, first, last, longest, average): interval summaries of each trace.

    ``traces`` maps a label to (wave, signals).  Metrics are the busy signal,
    each handshake over the whole trace and inside the busy window, the busy
    time inside the command window, and the gaps (in ``total``) from the first
    command to busy, from busy to the last response, and the busy span.  The
    metrics over whole traces are found at once, as the windows need them.
    """
    intervals = _intervals(traces, busy, handshakes, slice_ticks)
    spark = intervals.sparkSession
    named = lambda df: df.withColumn("key", F.concat_ws("/", "trace", "metric"))

    def summed(found: DataFrame, wanted: list[str]) -> DataFrame:
        keys = named(spark.createDataFrame([(t, m) for t in traces for m in wanted], "trace string, metric string"))
        return interval_summary(keys, named(found), "key").join(F.broadcast(keys), "key").drop("key")

    # A row for each trace and metric: what the windows and gaps are made of.
    columns = ["trace", "metric", "n", "total", "first", "last", "longest", "average"]
    whole = [r.asDict() for r in summed(intervals, ["busy", *handshakes]).select(*columns).collect()]
    at = {(r["trace"], r["metric"]): r for r in whole}
    rows, bounds = [tuple(r[c] for c in columns) for r in whole], []
    for t in traces:
        b0, b1, c0, c1, r1 = (at.get((t, m), {}).get(c) for m, c in (("busy", "first"), ("busy", "last"), (command, "first"), (command, "last"), (response, "last")))
        bounds += [(t, m, c0 if m == "busy" else b0, c1 if m == "busy" else b1) for m in ["busy", *handshakes]]
        gap = lambda x, y, more=0: None if x is None or y is None else y - x + more
        for m, total in (("command to busy", gap(c0, b0)), ("busy to response", gap(b1, r1)), ("busy span", gap(b0, b1, 1))):
            rows.append((t, m, 0, total, None, None, None, None))
    # Handshakes are cut to the busy window and busy times to the command window, ends inclusive.
    windows = spark.createDataFrame(bounds, "trace string, metric string, w0 long, w1 long")
    inside = intervals.join(F.broadcast(windows), ["trace", "metric"]).where("t_start <= w1 and t_end > w0")
    name = F.when(F.col("metric") == "busy", F.lit("busy in command window")).otherwise(F.concat("metric", F.lit(" in busy window")))
    inside = inside.select("trace", name.alias("metric"), F.greatest("t_start", "w0").alias("t_start"), F.least("t_end", F.col("w1") + 1).alias("t_end"))
    cut = summed(inside, [*(f"{m} in busy window" for m in handshakes), "busy in command window"]).select(*columns)
    known = spark.createDataFrame(rows, "trace string, metric string, n long, total long, first long, last long, longest long, average double")
    return known.unionByName(cut)
