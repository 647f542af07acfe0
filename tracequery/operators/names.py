"""Signal discovery: lists, globs, expansion, resolution, trees and hierarchy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import depth as name_depth
from ..schema import SignalNotFoundError


def list_signals(signals: DataFrame, pattern: str | None = None) -> DataFrame:
    """(signal_name), distinct; ``pattern`` is a regular expression found anywhere in the name."""
    names = signals.select("signal_name").distinct()
    return names.where(F.col("signal_name").rlike(pattern)) if pattern else names


def page(signals: DataFrame, limit: int, pattern: str | None = None) -> DataFrame:
    """The first ``limit`` names, with total_signals and truncated."""
    names = list_signals(signals, pattern)
    total = names.agg(F.count(F.lit(1)).alias("total_signals"))
    return names.orderBy("signal_name").limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total_signals") > limit)


def glob_pattern(glob: str) -> str:
    """A regular expression for * and ?; everything else stands for itself."""
    return "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob)


def split_list(text: str) -> list[str]:
    return [s for s in (p.strip() for p in text.split(",")) if s]


def expand(signals: DataFrame, requested: list[str], most: int | None = None) -> DataFrame:
    """(place, signal_name): names for a list with wildcards, in its order and then by name, each once.

    Names without wildcards stay as they are, known or not.
    """
    spark = signals.sparkSession
    rows = [(i, r, glob_pattern(r) if re.search(r"[*?]", r) else None) for i, r in enumerate(requested)]
    asked = spark.createDataFrame(rows, "pos int, requested string, pattern string")
    names = list_signals(signals)
    met = names.join(F.broadcast(asked.where("pattern is not null")), F.expr("signal_name rlike pattern")).select("pos", "signal_name")
    plain = asked.where("pattern is null").select("pos", F.col("requested").alias("signal_name"))
    first = met.unionByName(plain).groupBy("signal_name").agg(F.min("pos").alias("pos"))
    # Numbered within each entry of the list; the entries' counts, one row each, add up.
    earlier = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = asked.select("pos").join(first.groupBy("pos").agg(F.count(F.lit(1)).alias("n")), "pos", "left")
    sums = spark.createDataFrame(sums.collect(), "pos int, n long").select("pos", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("pos").orderBy("signal_name")) - 1)
    out = numbered.join(F.broadcast(sums), "pos").select((F.col("base") + F.col("n")).cast("long").alias("place"), "signal_name")
    if most is not None:
        found = met.groupBy("pos").count().collect()
        for i, r, pattern in rows:
            n = next((x["count"] for x in found if x["pos"] == i), 0)
            if pattern and not n:
                raise SignalNotFoundError(f"no signal matches {r}")
        if sum(x["count"] for x in found) > most:
            raise ValueError(f"the patterns match more than {most} signals")
    return out


def _score(name: Column, requested: Column, parts: Column) -> Column:
    """How well a candidate fits: equality, ending, parts found in order, and brevity."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("points"), F.lit(True).alias("open"))

    def step(s, p):
        found = F.locate(p, name, s["at"] + 1) if isinstance(p, str) else F.call_function("locate", p, name, s["at"] + 1)
        hit = F.struct((found + F.length(p) - 1).alias("at"), (s["points"] + 5).alias("points"), F.lit(True).alias("open"))
        miss = F.struct(s["at"].alias("at"), (s["points"] - 5).alias("points"), F.lit(False).alias("open"))
        return F.when(~s["open"], s).when(found > 0, hit).otherwise(miss)

    in_order = F.aggregate(parts, zero, step, lambda s: s["points"])
    ends = F.when(name.endswith(requested), 400).otherwise(0)
    return F.when(name == requested, 1000).otherwise(0) + ends + 10 * F.size(parts) + in_order - F.floor(F.length(name) / 5)


def resolve(signals: DataFrame, requested: list[str]) -> DataFrame:
    """(requested, signal_id, signal_name, match): the best signal for each requested name that has one.

    An exact name comes first, then the only name that ends so, then the
    best-scored name that holds the parts in order; all candidates are ranked,
    the shorter name and then the lesser one winning ties.
    """
    rows = []
    for i, r in enumerate(requested):
        like = r.replace("*", "%").replace("?", "_")
        parts = [p for p in like.split(".") if p]
        rows.append((i, r, f"%{like}", "%" + "%".join(parts) + "%" if parts else like, parts))
    asked = signals.sparkSession.createDataFrame(rows, "pos int, requested string, ending string, anywhere string, parts array<string>")
    name = F.col("signal_name")
    met = signals.select("signal_id", "signal_name").distinct().join(F.broadcast(asked), F.expr("signal_name = requested or signal_name like ending or signal_name like anywhere"))
    met = met.withColumns({"is_exact": name == F.col("requested"), "is_ending": F.expr("signal_name like ending"), "score": _score(name, F.col("requested"), F.col("parts"))})
    of = Window.partitionBy("pos")
    met = met.withColumns({"exact": F.max("is_exact").over(of), "n_ending": F.count_if("is_ending").over(of)})
    match = F.when(F.col("exact"), "exact").when(F.col("n_ending") == 1, "suffix").otherwise("fuzzy")
    fits = F.when(match == "exact", F.col("is_exact")).when(match == "suffix", F.col("is_ending")).otherwise(F.expr("signal_name like anywhere"))
    best = met.withColumn("match", match).where(fits)
    order = Window.partitionBy("pos").orderBy(F.desc("score"), F.length(name), name, "signal_id")
    return best.withColumn("n", F.row_number().over(order)).where("n = 1").select("requested", "signal_id", "signal_name", "match")


def _paths(names: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(path, depth, child) of every ancestor of every name, itself included."""
    parts = F.split("signal_name", r"\.")
    upto = F.size(parts) if most_depth is None else F.least(F.size(parts), F.lit(most_depth))
    exploded = names.select("signal_name", parts.alias("parts"), F.explode(F.sequence(F.lit(1), upto)).alias("depth"))
    return exploded.select("signal_name", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".").alias("path"), F.size("parts").alias("n_parts"), F.get("parts", F.col("depth")).alias("child"))


def tree(signals: DataFrame, most_depth: int = 4) -> DataFrame:
    """(path, depth, signal_count): counts of names under every node down to ``most_depth``."""
    return _paths(list_signals(signals), most_depth).groupBy("path", "depth").agg(F.count(F.lit(1)).alias("signal_count")).select("path", F.col("depth").cast("long").alias("depth"), "signal_count")


def hierarchy(signals: DataFrame, pattern: str | None = None, depth: int = 3) -> DataFrame:
    """(module, signal_count, children): modules below the first match of ``pattern``, with their direct children's names.

    Without a pattern the roots are the start.  All signals under the start
    count, those directly under it too.
    """
    names = list_signals(signals)
    base = 0
    if pattern:
        names = names.where(F.col("signal_name").contains(pattern))
        first = names.agg(F.min("signal_name")).first()[0]
        if first is None:
            raise SignalNotFoundError(f"no signal matches {pattern}")
        parts = first.split(".")
        base = next((i + 1 for i, p in enumerate(parts) if pattern.lower() in p.lower()), 0)
        prefix = ".".join(parts[:base])
        names = names.where(F.col("signal_name").startswith(prefix + ".") | (F.col("signal_name") == prefix)) if prefix else names
    inner = _paths(names).where((F.col("depth") < F.col("n_parts")) & (F.col("depth") >= max(base, 1)) & (F.col("depth") <= base + depth))
    return inner.groupBy(F.col("path").alias("module")).agg(F.count(F.lit(1)).alias("signal_count"), F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))


def by_depth(names: DataFrame) -> DataFrame:
    return names.orderBy(name_depth(F.col("signal_name")), "signal_name")
