"""Step functions: as-of values, segments, neighbours and joint states.

A signal holds its value from one change to the next.  All operators take a
``wave`` frame (timestamp, seq, signal_id, value_raw) and work for all its
signals at once, in one scan and one exchange by signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import bit
from ..schema import InvalidRangeError


def by_signal() -> WindowSpec:
    """Orders the changes of a signal."""
    return Window.partitionBy("signal_id").orderBy("timestamp", "seq")


def check_range(start: int, end: int) -> None:
    if start is None or end is None or end < start:
        raise InvalidRangeError(f"not a time range: {start} to {end}")


def moment() -> Column:
    return F.struct("timestamp", "seq")


def asof(wave: DataFrame, at: int, strict: bool = False) -> DataFrame:
    """(signal_id, value_raw, timestamp): each signal's last change at or before a time, or before it only."""
    t = F.col("timestamp")
    return wave.where(t < at if strict else t <= at).groupBy("signal_id").agg(F.max_by("value_raw", moment()).alias("value_raw"), F.max("timestamp").alias("timestamp"))


def at_times(wave: DataFrame, signals: DataFrame, times: DataFrame, times_per_slice: int = 1000) -> DataFrame:
    """The rows of ``times`` (a column ``time`` and others) with signal_id and value_raw, for each of ``signals``; null before the first change.

    Pieces over which values hold meet the times by time slice, so every
    result row is made once and a long trace is worked on by many tasks.
    """
    lim = times.agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.ceil(F.count(F.lit(1)) / times_per_slice).alias("n")).where("n > 0")
    lim = lim.select("lo", "hi", (F.floor((F.col("hi") - F.col("lo")) / F.col("n")) + 1).alias("step"))
    ids = signals.select("signal_id").distinct()
    known = wave.where(F.col("value_raw").isNotNull()).join(ids, "signal_id", "left_semi")
    held = neighbours(known).select("signal_id", F.col("timestamp").alias("t_start"), F.col("next_time").alias("t_end"), "value_raw")
    before = ids.join(known.groupBy("signal_id").agg(F.min("timestamp").alias("t_end")), "signal_id", "left")
    before = before.select("signal_id", F.lit(None).cast("long").alias("t_start"), "t_end", F.lit(None).cast("string").alias("value_raw"))
    first, last = F.greatest("t_start", "lo"), F.least(F.col("t_end") - 1, F.col("hi"))
    slot = lambda t: F.floor((t - F.col("lo")) / F.col("step"))
    pieces = held.unionByName(before).join(F.broadcast(lim)).withColumns({"t_first": first, "t_last": last}).where("t_first <= t_last")
    pieces = pieces.select("signal_id", "value_raw", "t_first", "t_last", F.explode(F.sequence(slot(F.col("t_first")), slot(F.col("t_last")))).alias("slot"))
    marks = times.join(F.broadcast(lim)).select(*times.columns, slot(F.col("time")).alias("slot"))
    return marks.join(pieces, "slot").where("time between t_first and t_last").select(*times.columns, "signal_id", "value_raw")


def asof_times(wave: DataFrame, times: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal_id, time, value_raw) for each signal and each row of ``times`` (a column ``time``), null before the first change."""
    return at_times(wave, signals, times.select("time").distinct()).select("signal_id", "time", "value_raw")


def since(wave: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """The changes in a range, and each signal's last one before it, which map-side maxima find; all changes without a range."""
    if start is None and end is None:
        return wave
    check_range(start, end)
    last = wave.where(F.col("timestamp") < start).groupBy("signal_id").agg(F.max_by(F.struct(*wave.columns), moment()).alias("last"))
    return last.select("last.*").unionByName(wave.where(F.col("timestamp").between(start, end)))


def neighbours(wave: DataFrame, slice_ticks: int | None = None) -> DataFrame:
    """Adds prev_time, prev_value and next_time of each change.

    With ``slice_ticks`` a signal's changes are dealt out by time slices, so
    that a clock with a large share of all changes is worked on by many tasks;
    only the changes at slice bounds meet across slices.
    """
    if slice_ticks is None:
        return wave.withColumns({"prev_time": F.lag("timestamp").over(by_signal()), "prev_value": F.lag("value_raw").over(by_signal()), "next_time": F.lead("timestamp").over(by_signal())})
    part = wave.withColumn("__slice", F.floor(F.col("timestamp") / slice_ticks))
    inner = Window.partitionBy("signal_id", "__slice").orderBy("timestamp", "seq")
    near = part.withColumns({"prev_time": F.lag("timestamp").over(inner), "prev_value": F.lag("value_raw").over(inner), "next_time": F.lead("timestamp").over(inner)})
    ends = part.groupBy("signal_id", "__slice").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max_by("value_raw", moment()).alias("last_value"))
    outer = Window.partitionBy("signal_id").orderBy("__slice")
    ends = ends.select("signal_id", "__slice", F.lag("last").over(outer).alias("__pt"), F.lag("last_value").over(outer).alias("__pv"), F.lead("first").over(outer).alias("__nt"))
    out = near.join(ends, ["signal_id", "__slice"])
    first = F.col("prev_time").isNull()
    return out.withColumns({"prev_value": F.when(first, F.col("__pv")).otherwise(F.col("prev_value")), "prev_time": F.coalesce("prev_time", "__pt"), "next_time": F.coalesce("next_time", "__nt")}).select(
        *wave.columns, "prev_time", "prev_value", "next_time"
    )


def segments(wave: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """(signal_id, t_start, t_end, seq, value_raw): half-open pieces of [start, end + 1) over which values hold.

    The value at ``start`` comes from the last change before it; time before a
    signal's first change is in no piece, and changes overtaken within their
    tick have none.
    """
    held = neighbours(since(wave, start, end), slice_ticks)
    t_start, t_end = F.greatest("timestamp", F.lit(start)), F.coalesce("next_time", F.lit(end + 1))
    return held.select("signal_id", t_start.alias("t_start"), t_end.alias("t_end"), "seq", "value_raw").where("t_end > t_start")


def sweep(wave: DataFrame, pairs: DataFrame, start: int | None, end: int | None, to_bit=bit, slice_ticks: int | None = None) -> DataFrame:
    """Pieces of joint state: pair, t_start, t_end, a_bit, b_bit for rows (pair, a_id, b_id) of ``pairs``.

    Both sides' changes are put in one order and each side's last value is
    carried on; values become bits only then, so an x ends a 0 or 1.  With
    ``slice_ticks`` a pair's changes are dealt out by time slices; only the
    last values and the first time of each slice meet across slices.  Without
    a range, all changes are meant and the last piece of a pair has no end.
    """
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("a_id").alias("signal_id"), F.lit(0).alias("side")), F.struct(F.col("b_id").alias("signal_id"), F.lit(1).alias("side")))).alias("s")).select("pair", "s.*")
    points = since(wave, start, end).join(sides, "signal_id")
    place = F.struct("timestamp", "seq", "side")
    of = lambda side: F.when(F.col("side") == side, F.col("value_raw"))
    key = ["pair"] if slice_ticks is None else ["pair", "slice"]
    if slice_ticks is not None:
        points = points.withColumn("slice", F.floor(F.col("timestamp") / slice_ticks))
    order = Window.partitionBy(*key).orderBy("timestamp", "seq", "side")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = lambda side: F.last(of(side), ignorenulls=True).over(upto)
    both = points.select(*key, "timestamp", F.lead("timestamp").over(order).alias("next_time"), held(0).alias("a"), held(1).alias("b"))
    if slice_ticks is not None:
        last = lambda side: F.max_by("value_raw", F.when(of(side).isNotNull(), place))
        ends = points.groupBy(*key).agg(F.min("timestamp").alias("first"), last(0).alias("a"), last(1).alias("b"))
        outer = Window.partitionBy("pair").orderBy("slice")
        earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
        carried = lambda c: F.last(c, ignorenulls=True).over(earlier)
        ends = ends.select(*key, F.lead("first").over(outer).alias("after"), carried("a").alias("a_before"), carried("b").alias("b_before"))
        both = both.join(ends, key).withColumns({"next_time": F.coalesce("next_time", "after"), "a": F.coalesce("a", "a_before"), "b": F.coalesce("b", "b_before")})
    t_start, t_end = F.col("timestamp"), F.col("next_time")
    if start is not None:
        t_start, t_end = F.greatest(t_start, F.lit(start)), F.coalesce(t_end, F.lit(end + 1))
    return both.select("pair", t_start.alias("t_start"), t_end.alias("t_end"), to_bit(F.col("a")).alias("a_bit"), to_bit(F.col("b")).alias("b_bit")).where("t_end is null or t_end > t_start")


def joint_times(wave: DataFrame, pairs: DataFrame, start: int, end: int, slice_ticks: int | None = None) -> DataFrame:
    """pair, both_high, both_low, a_only, b_only, unknown, total_time; the five add up to the last."""
    total = end - start + 1
    state = lambda a, b: F.coalesce(F.sum(F.when((F.col("a_bit") == a) & (F.col("b_bit") == b), F.col("t_end") - F.col("t_start"))), F.lit(0))
    sums = sweep(wave, pairs, start, end, bit, slice_ticks).groupBy("pair").agg(state(1, 1).alias("both_high"), state(0, 0).alias("both_low"), state(1, 0).alias("a_only"), state(0, 1).alias("b_only"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = pairs.join(sums, "pair", "left").select(*pairs.columns, *map(zero, ("both_high", "both_low", "a_only", "b_only")))
    return out.withColumn("unknown", F.lit(total) - F.col("both_high") - F.col("both_low") - F.col("a_only") - F.col("b_only")).withColumn("total_time", F.lit(total).cast("long"))
