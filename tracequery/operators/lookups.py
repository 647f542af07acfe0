"""Point, range and summary queries, for all signals of a frame at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import by_signal, check_range, moment, neighbours, since


def _inside(start: int, end: int) -> Column:
    return F.col("timestamp").between(start, end)


def bounds(wave: DataFrame) -> DataFrame:
    """One row: start_time, end_time over all signals."""
    return wave.agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))


def status(wave: DataFrame) -> DataFrame:
    """One row: signal_count, start_time, end_time."""
    return wave.agg(F.countDistinct("signal_id").alias("signal_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))


def query_range(wave: DataFrame, start: int, end: int) -> DataFrame:
    """Each signal's value before ``start`` (kind initial) and its changes in the range, in order."""
    check_range(start, end)
    changes = wave.where(_inside(start, end)).select("signal_id", F.lit("change").alias("kind"), "timestamp", "seq", "value_raw")
    before = wave.where(F.col("timestamp") < start).groupBy("signal_id").agg(F.max_by(F.struct("timestamp", "seq", "value_raw"), moment()).alias("last"))
    return before.select("signal_id", F.lit("initial").alias("kind"), "last.*").unionByName(changes)


def probe(wave: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """One row for each signal: initial and final value, change_count, transition_count, first and last change.

    ``change_count`` counts records, ``transition_count`` those that differ
    from the value before them.
    """
    here = _inside(start, end)
    known = neighbours(since(wave, start, end), slice_ticks)
    return known.groupBy("signal_id").agg(
        F.max_by("value_raw", F.when(F.col("timestamp") < start, moment())).alias("initial_value"),
        F.max_by("value_raw", moment()).alias("final_value"),
        F.count_if(here).alias("change_count"),
        F.count_if(here & ~F.col("value_raw").eqNullSafe(F.col("prev_value"))).alias("transition_count"),
        F.min(F.when(here, F.col("timestamp"))).alias("first_change"),
        F.max(F.when(here, F.col("timestamp"))).alias("last_change"),
    )


def probe_unique(wave: DataFrame, start: int, end: int, most: int = 32) -> DataFrame:
    """(signal_id, place, value_raw): the first ``most`` different values of each signal by first occurrence."""
    first = wave.where(_inside(start, end)).groupBy("signal_id", "value_raw").agg(F.min(moment()).alias("first"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("signal_id").orderBy("first")))
    return ranked.where(F.col("place") <= most).select("signal_id", F.col("place").cast("long").alias("place"), "value_raw")


def probe_changes(wave: DataFrame, start: int, end: int, most: int = 200) -> DataFrame:
    """(signal_id, place, timestamp, value_raw): the first ``most`` changes of each signal."""
    ranked = wave.where(_inside(start, end)).withColumn("place", F.row_number().over(by_signal()))
    return ranked.where(F.col("place") <= most).select("signal_id", F.col("place").cast("long").alias("place"), "timestamp", "value_raw")


def last_activity(wave: DataFrame) -> DataFrame:
    """(signal_id, last_change_time, final_value)."""
    return wave.groupBy("signal_id").agg(F.max("timestamp").alias("last_change_time"), F.max_by("value_raw", moment()).alias("final_value"))


def compare_points(wave: DataFrame, time_a: int, time_b: int) -> DataFrame:
    """Each signal's values at two times and whether they differ; none and none do not."""
    at = lambda t: F.max_by("value_raw", F.when(F.col("timestamp") <= t, moment()))
    both = wave.where(F.col("timestamp") <= max(time_a, time_b)).groupBy("signal_id").agg(at(time_a).alias("value_a"), at(time_b).alias("value_b"))
    return both.withColumn("changed", ~F.col("value_a").eqNullSafe(F.col("value_b")))


def find_event(wave: DataFrame, value: str, start: int, end: int, edge: str = "any", most: int | None = 20, parity: bool = False, slice_ticks: int | None = None) -> DataFrame:
    """Changes to a value (any), changes into it (rising) or out of it (falling); the first ``most`` of each signal.

    With ``parity`` the first record of the range has no record before it, so a
    value that was already held counts as entered there.
    """
    check_range(start, end)
    here = wave.where(_inside(start, end))
    if edge == "any":
        found = here.where(F.col("value_raw") == value).withColumn("prev_value", F.lit(None).cast("string"))
    elif edge in ("rising", "falling"):
        known = neighbours(here if parity else since(wave, start, end), slice_ticks).where(_inside(start, end))
        if edge == "rising":
            found = known.where((F.col("value_raw") == value) & ~F.col("prev_value").eqNullSafe(F.lit(value)))
        else:
            found = known.where((F.col("prev_value") == value) & (F.col("value_raw") != value))
    else:
        raise ValueError(f"unknown edge {edge}")
    found = found.select("signal_id", "timestamp", "seq", "value_raw", "prev_value")
    if most is None:
        return found
    return found.withColumn("place", F.row_number().over(by_signal())).where(F.col("place") <= most).drop("place")


def find_stall(wave: DataFrame, start: int, end: int, min_duration: int = 1000, include_lead: bool = False, slice_ticks: int | None = None) -> DataFrame:
    """(signal_id, start_time, end_time, duration, value_held, potential_hang): gaps of ``min_duration`` at least between changes.

    The gap from the last change to ``end`` may be a hang.  ``include_lead``
    adds the time from ``start`` to the first change, where a value is held.
    """
    check_range(start, end)
    held = neighbours(since(wave, start, end) if include_lead else wave.where(_inside(start, end)), slice_ticks)
    gaps = held.select(
        "signal_id",
        F.greatest("timestamp", F.lit(start)).alias("start_time"),
        F.coalesce("next_time", F.lit(end)).alias("end_time"),
        F.col("value_raw").alias("value_held"),
        F.col("next_time").isNull().alias("potential_hang"),
    )
    gaps = gaps.withColumn("duration", F.col("end_time") - F.col("start_time"))
    return gaps.where(F.col("duration") >= min_duration).select("signal_id", "start_time", "end_time", "duration", "value_held", "potential_hang")
