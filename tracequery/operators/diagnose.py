"""Snapshots at one time: busy trees, deadlock candidates, dependency traces."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import depth, leaf, module
from .steps import asof

BUSY = ["io_busy", "busy"]
WATCHED = [".*valid.*", ".*ready.*", ".*busy.*"]
#: Name parts of control signals, and those that block when 1.  Fixed values.
CONTROL = ["ready", "valid", "busy", "stall", "wait", "pending", "full", "empty", "grant", "req"]
BLOCKS = ["busy", "stall", "wait", "pending", "full"]


def _any(tests) -> F.Column:
    return functools.reduce(operator.or_, tests)


def snapshot(wave: DataFrame, signals: DataFrame, time: int, wanted=None) -> DataFrame:
    """(signal_id, signal_name, value) of signals that have a value at a time; names share an id's value."""
    names = signals.select("signal_id", "signal_name").distinct()
    names = names if wanted is None else names.where(wanted)
    near = wave.join(names.select("signal_id").distinct(), "signal_id", "left_semi")
    return asof(near, time).select("signal_id", F.col("value_raw").alias("value")).join(names, "signal_id")


def busy_tree(wave: DataFrame, signals: DataFrame, root: str, time: int, patterns: list[str] | None = None) -> DataFrame:
    """(signal_name, value, is_busy, depth) of busy-like signals under a root, in depth and name order when sorted by these."""
    name = F.col("signal_name")
    ends = [rf".*{root}.*\.{p}$" for p in patterns or BUSY] + [rf".*{root}.*{p}[^a-zA-Z_].*" for p in patterns or BUSY]
    found = snapshot(wave, signals, time, _any(name.rlike(e) for e in ends))
    return found.select("signal_name", "value", (F.col("value") == "1").alias("is_busy"), depth(name).cast("long").alias("depth"))


def watched_state(wave: DataFrame, signals: DataFrame, time: int, patterns: list[str] | None = None, within: str | None = None) -> DataFrame:
    """(module, leaf, value) of the signals that a deadlock search looks at."""
    name = F.col("signal_name")
    tests = [f".*{within}.*{p}" if within else p for p in patterns or WATCHED]
    return snapshot(wave, signals, time, _any(name.rlike(t) for t in tests)).select(module(name).alias("module"), leaf(name).alias("leaf"), "value")


def find_deadlock(wave: DataFrame, signals: DataFrame, time: int, patterns: list[str] | None = None, within: str | None = None) -> DataFrame:
    """(module, issue_count, issues): modules with valid = 1 against ready = 0, or busy = 1, at a time."""
    state = watched_state(wave, signals, time, patterns, within)
    ready = state.where("value = '0'").select("module", F.col("leaf").alias("partner"))
    partner = F.replace(F.replace(F.col("leaf"), F.lit("valid"), F.lit("ready")), F.lit("Valid"), F.lit("Ready"))
    valid = state.where(F.lower("leaf").contains("valid") & (F.col("value") == "1")).withColumn("partner", partner)
    blocked = valid.join(ready, ["module", "partner"]).select("module", F.concat("leaf", F.lit("=1 but "), "partner", F.lit("=0")).alias("issue"))
    busy = state.where(F.lower("leaf").contains("busy") & (F.col("value") == "1")).select("module", F.concat("leaf", F.lit("=1 (busy)")).alias("issue"))
    issues = blocked.unionByName(busy).groupBy("module").agg(F.count(F.lit(1)).alias("issue_count"), F.array_join(F.array_sort(F.collect_list("issue")), "; ").alias("issues"))
    return issues


def trace_dependency(wave: DataFrame, signals: DataFrame, start: str, time: int, direction: str = "backward", max_depth: int = 5, per_level: int = 10) -> DataFrame:
    """(depth, signal_name, value, note): control signals around a signal's module and, backward, its parents.

    Each signal shows at the innermost level that holds it; a level shows its
    first ``per_level`` signals by control word and name.  Beyond the second
    level only blocking ones are shown.
    """
    parts = start.split(".")[:-1]
    levels = [".".join(parts[: len(parts) - i]) for i in range(max(1, len(parts)))] if direction == "backward" else [".".join(parts)]
    levels = levels[:max_depth]
    name = F.col("signal_name")
    level = F.coalesce(*[F.when(name.contains(m), F.lit(i)) for i, m in enumerate(levels)])
    word = F.coalesce(*[F.when(name.contains(w), F.lit(i)) for i, w in enumerate(CONTROL)])
    wanted = (name == start) | (_any(name.contains(w) for w in CONTROL) & level.isNotNull())
    found = snapshot(wave, signals, time, wanted)
    blocking = ((F.col("value") == "1") & _any(F.lower("signal_name").contains(b) for b in BLOCKS)) | ((F.col("value") == "0") & F.lower("signal_name").contains("ready"))
    first = found.where(name == start).select(F.lit(0).cast("long").alias("depth"), "signal_name", "value", F.lit("Starting point").alias("note"))
    near = found.where(name != start).withColumns({"level": level, "word": word, "blocking": blocking})
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("word", "signal_name"))).where(F.col("place") <= per_level)
    near = near.where(F.col("blocking") | (F.col("level") < 2))
    return first.unionByName(near.select((F.col("level") + 1).cast("long").alias("depth"), "signal_name", "value", F.when(F.col("blocking"), "BLOCKING").otherwise("").alias("note")))
