"""Clock cycles: numbered edges, and time ranges and values by cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidRangeError
from .steps import at_times, by_signal, neighbours


def cycle_table(wave: DataFrame, edge: str = "rising", slice_ticks: int | None = None) -> DataFrame:
    """(signal_id, cycle, timestamp): edges on raw text, numbered from 0; a first 1 (or 0) is an edge.

    With ``slice_ticks`` edges are numbered slice by slice and the slices'
    counts add up, so a long clock isn't numbered by one task.
    """
    if edge not in ("rising", "falling"):
        raise ValueError(f"unknown edge {edge}")
    value = "1" if edge == "rising" else "0"
    edges = neighbours(wave, slice_ticks).where((F.col("value_raw") == value) & ~F.col("prev_value").eqNullSafe(F.lit(value)))
    if slice_ticks is None:
        return edges.select("signal_id", (F.row_number().over(by_signal()) - 1).cast("long").alias("cycle"), "timestamp")
    part = edges.withColumn("__slice", F.floor(F.col("timestamp") / slice_ticks))
    sums = part.groupBy("signal_id", "__slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("signal_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("signal_id", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("signal_id", "__slice").orderBy("timestamp", "seq")
    numbered = part.withColumn("n", F.row_number().over(inner) - 1)
    return numbered.join(sums, ["signal_id", "__slice"]).select("signal_id", (F.col("base") + F.col("n")).cast("long").alias("cycle"), "timestamp")


def cycle_ranges(cycles: DataFrame, first: int, last: int, end_time: DataFrame) -> DataFrame:
    """(signal_id, start_time, end_time) of cycles first..last of each clock that has the first one.

    The range ends before the next edge, or with the trace.  ``end_time`` is a
    one-row frame with that column.
    """
    if first < 0 or last < first:
        raise InvalidRangeError(f"not a cycle range: {first} to {last}")
    at = lambda c: F.max(F.when(F.col("cycle") == c, F.col("timestamp")))
    edges = cycles.where(F.col("cycle").isin(first, last + 1)).groupBy("signal_id").agg(at(first).alias("start_time"), at(last + 1).alias("after"))
    stop = F.when(F.col("after").isNotNull(), F.greatest("start_time", F.col("after") - 1)).otherwise(F.col("trace_end"))
    return edges.where("start_time is not null").join(F.broadcast(end_time.select(F.col("end_time").alias("trace_end")))).select("signal_id", "start_time", stop.alias("end_time"))


def samples(wave: DataFrame, cycles: DataFrame, edges_per_slice: int = 1000) -> DataFrame:
    """(clock_id, cycle, signal_id, value_raw) of every signal of ``wave`` at every edge of every clock of ``cycles``, null before the first change."""
    edges = cycles.select(F.col("signal_id").alias("clock_id"), "cycle", F.col("timestamp").alias("time"))
    return at_times(wave, wave, edges, edges_per_slice).drop("time")


def sample(wave: DataFrame, cycles: DataFrame) -> DataFrame:
    """(signal_id, cycle, value_raw) of every signal of ``wave`` at the edges of one clock's cycles."""
    return samples(wave, cycles).select("signal_id", "cycle", "value_raw")
