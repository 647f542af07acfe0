"""Edges, hold times, handshakes, co-activity and interval summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import bit, handshake_kind, handshake_prefix, ratio
from .steps import joint_times, moment, neighbours, segments, since, sweep


def summary(wave: DataFrame, signals: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """One row for each signal id of ``signals``: edges, hold times, rate, values and whether it is stable.

    Edges need a bit on both sides, the value before ``start`` being the first
    one's.  Holds are the times from ``start`` to the first change, between
    changes, and from the last change to the end of the range.
    """
    total = end - start + 1
    here = F.col("timestamp") >= start
    known = neighbours(since(wave, start, end), slice_ticks)
    now, before = bit(F.col("value_raw")), bit(F.col("prev_value"))
    gap = F.when(here, F.col("timestamp") - F.greatest(F.coalesce("prev_time", F.lit(start)), F.lit(start)))
    sums = known.groupBy("signal_id").agg(
        F.count_if(here).alias("change_count"),
        F.count_if(here & (before == 0) & (now == 1)).alias("rising"),
        F.count_if(here & (before == 1) & (now == 0)).alias("falling"),
        F.min(gap).alias("__least"),
        F.max(gap).alias("__most"),
        F.max(F.when(here, F.col("timestamp"))).alias("__last"),
        F.max_by("value_raw", F.when(~here, moment())).alias("initial_value"),
        F.max_by("value_raw", moment()).alias("final_value"),
    )
    tail = F.lit(end + 1) - F.coalesce("__last", F.lit(start))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = signals.select("signal_id").distinct().join(sums, "signal_id", "left")
    return out.select(
        "signal_id",
        "initial_value",
        "final_value",
        *map(zero, ("change_count", "rising", "falling")),
        F.least(F.coalesce("__least", tail), tail).alias("hold_min"),
        F.greatest(F.coalesce("__most", tail), tail).alias("hold_max"),
        F.round(F.lit(float(total)) / (F.coalesce("change_count", F.lit(0)) + 1), 2).alias("hold_avg"),
        ratio(F.coalesce("change_count", F.lit(0)), F.lit(total), 12).alias("change_rate"),
        (F.coalesce("change_count", F.lit(0)) == 0).alias("is_stable"),
    )


def partial(summaries: DataFrame, most: int) -> DataFrame:
    """Summaries as of the first ``most`` changes only: where there are more, edges and holds are null and ``analysis_partial`` is true."""
    whole = F.col("change_count") <= most
    cut = {c: F.when(whole, F.col(c)) for c in ("rising", "falling", "hold_min", "hold_max", "hold_avg")}
    return summaries.withColumns({**cut, "analysis_partial": ~whole})


def describe(summaries: DataFrame, names: DataFrame) -> DataFrame:
    """(signal_id, signal_name, description) in words; of partial summaries it says so."""
    n, name = F.col("change_count"), F.col("signal_name")
    text = (
        F.when(n == 0, F.concat(F.lit("Signal "), name, F.lit(" remained constant at "), F.coalesce("initial_value", F.lit("None")), F.lit(".")))
        .when(n > 50, F.concat(F.lit("Signal "), name, F.lit(" toggled heavily ("), n.cast("string"), F.lit(" changes).")))
        .otherwise(F.concat(F.lit("Signal "), name, F.lit(" changed "), n.cast("string"), F.lit(" times.")))
    )
    if "analysis_partial" in summaries.columns:
        text = F.concat(text, F.when(F.col("analysis_partial"), F.lit(" Sample truncated.")).otherwise(F.lit("")))
    return summaries.join(names.select("signal_id", "signal_name"), "signal_id").select("signal_id", "signal_name", text.alias("description"))


def handshake_pairs(names: DataFrame) -> DataFrame:
    """(pair, a_id, b_id): a valid and a ready signal of one prefix; the pair is the prefix, the first name wins."""
    parts = names.select("signal_id", "signal_name", handshake_kind(F.col("signal_name")).alias("kind"), handshake_prefix(F.col("signal_name")).alias("pair")).where("kind is not null")
    side = lambda k: F.min_by("signal_id", F.when(F.col("kind") == k, F.struct("signal_name", "signal_id")))
    both = parts.groupBy("pair").agg(side("valid").alias("a_id"), side("ready").alias("b_id"))
    return both.where("a_id is not null and b_id is not null")


def handshake(wave: DataFrame, names: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """Joint times of every valid/ready pair and their shares of the range."""
    t = joint_times(wave, handshake_pairs(names), start, end, slice_ticks)
    part = lambda c, name: ratio(F.col(c), F.col("total_time")).alias(name)
    return t.select(
        F.col("pair").alias("prefix"), "both_high", F.col("a_only").alias("valid_only"), F.col("b_only").alias("ready_only"), "both_low", "unknown", "total_time",
        part("both_high", "throughput_ratio"), part("a_only", "stall_ratio"), part("b_only", "ready_wait_ratio"),
    )


def coactivity(wave: DataFrame, chosen: DataFrame, start: int, end: int, slice_ticks: int | None = None, most: int = 64) -> DataFrame:
    """Joint times of every two of the chosen signals (pos, signal_id), which are ``most`` at most."""
    if chosen.limit(most + 1).count() > most:
        raise ValueError(f"co-activity is of {most} signals at most")
    a, b = chosen.select(F.col("pos").alias("a_pos"), F.col("signal_id").alias("a_id")), chosen.select(F.col("pos").alias("b_pos"), F.col("signal_id").alias("b_id"))
    pairs = a.join(F.broadcast(b), F.col("a_pos") < F.col("b_pos")).select(F.concat_ws("/", "a_pos", "b_pos").alias("pair"), "a_id", "b_id")
    t = joint_times(wave, pairs, start, end, slice_ticks)
    same = ratio(F.col("both_high") + F.col("both_low"), F.col("total_time")).alias("same_state_ratio")
    return t.select("a_id", "b_id", "both_high", "both_low", "a_only", "b_only", "unknown", same)


def classify(wave: DataFrame) -> DataFrame:
    """(signal_id, signal_type): bus if the first value is longer than one character, else logic."""
    first = F.min_by("value_raw", moment())
    return wave.groupBy("signal_id").agg(F.when(F.length(first) > 1, "bus").otherwise("logic").alias("signal_type"))


def duty(wave: DataFrame, signals: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """(signal_id, high_time, low_time, unknown_time, activity_ratio): shares of the range by bit."""
    total = end - start + 1
    length = F.col("t_end") - F.col("t_start")
    b = bit(F.col("value_raw"))
    sums = segments(wave, start, end, slice_ticks).groupBy("signal_id").agg(F.sum(F.when(b == 1, length)).alias("high"), F.sum(F.when(b == 0, length)).alias("low"))
    out = signals.select("signal_id").distinct().join(sums, "signal_id", "left")
    high, low = F.coalesce("high", F.lit(0)).cast("long"), F.coalesce("low", F.lit(0)).cast("long")
    return out.select("signal_id", high.alias("high_time"), low.alias("low_time"), (F.lit(total) - high - low).alias("unknown_time"), ratio(high, F.lit(total)).alias("activity_ratio"))


def high_intervals(wave: DataFrame, start: int, end: int, to_bit=bit, slice_ticks: int | None = None) -> DataFrame:
    """(signal_id, t_start, t_end) where the bit is 1; records of the same value stay apart."""
    return segments(wave, start, end, slice_ticks).where(to_bit(F.col("value_raw")) == 1).select("signal_id", "t_start", "t_end")


def low_intervals(wave: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """The same where the bit is 0: idle gaps of a busy signal."""
    return segments(wave, start, end, slice_ticks).where(bit(F.col("value_raw")) == 0).select("signal_id", "t_start", "t_end")


def both_high_intervals(wave: DataFrame, pairs: DataFrame, start: int, end: int, to_bit=bit, slice_ticks: int | None = None) -> DataFrame:
    """(pair, t_start, t_end) where both signals of a pair are 1."""
    return sweep(wave, pairs, start, end, to_bit, slice_ticks).where("a_bit = 1 and b_bit = 1").select("pair", "t_start", "t_end")


def interval_summary(keys: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """For each key: n, total, first, last (inclusive), longest, average; zeros and nulls where it has no interval."""
    length = F.col("t_end") - F.col("t_start")
    sums = intervals.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total"), F.min("t_start").alias("first"), (F.max("t_end") - 1).alias("last"), F.max(length).alias("longest"))
    out = keys.select(key).distinct().join(sums, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(key, zero("n"), zero("total"), "first", "last", zero("longest"), F.coalesce(F.round(F.col("total") / F.col("n"), 2), F.lit(0.0)).alias("average"))


def longest(intervals: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The ``most`` longest intervals of each key, the earlier first on ties."""
    length = F.col("t_end") - F.col("t_start")
    place = F.row_number().over(Window.partitionBy(key).orderBy(length.desc(), "t_start"))
    return intervals.withColumn("place", place).where(F.col("place") <= most).select(key, F.col("place").cast("long").alias("place"), "t_start", "t_end", length.alias("duration"))


def health_check(wave: DataFrame, names: DataFrame, start: int, end: int, least_toggles: int = 100) -> DataFrame:
    """One row: whether a clock toggles, a reset is low at the end, and any busy signal was high."""
    s = summary(wave, names, start, end).join(names.select("signal_id", "signal_name"), "signal_id")
    d = s.join(duty(wave, names, start, end).select("signal_id", "high_time"), "signal_id")
    low = F.lower("signal_name")
    clock, reset, busy = low.rlike("(clock|clk)$"), low.rlike("(reset|rst)$"), low.contains("busy")
    return d.agg(
        F.count_if(clock & (F.col("change_count") >= least_toggles)).alias("live_clocks"),
        F.count_if(clock).alias("clocks"),
        F.count_if(reset & (F.coalesce(bit(F.col("final_value")), F.lit(1)) != 0)).alias("active_resets"),
        F.count_if(busy & (F.col("high_time") > 0)).alias("active_busy"),
    )
