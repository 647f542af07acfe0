"""The façade: one method for each query, with results as dictionaries.

Methods resolve names, call the operators for all asked signals at once and
render at the end; ``frames`` below them are ordinary DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cycles, diagnose, lookups, names, semantics, steps, traces
from .plans import render
from .plans.catalog import Trace, TraceCatalog
from .schema import InvalidRangeError, SignalNotFoundError


class Engine:
    def __init__(self, spark: SparkSession, cache_dir: str | None = None):
        self.spark, self.catalog = spark, TraceCatalog(spark, cache_dir)
        self._resolved: dict[tuple[str, str], dict] = {}

    # Lifecycle

    def load(self, path: str, shards: int | None = None) -> dict:
        # A changed file may number its signals otherwise.
        self._resolved.clear()
        self.catalog.load(path, shards)
        return self.catalog.status()

    def ensure(self, path: str) -> dict:
        """Loads a file unless it is current."""
        return self.catalog.status() if self.catalog.current == path else self.load(path)

    def unload(self) -> dict:
        path = self.catalog.unload()
        return {"status": "unloaded" if path else "no_file_loaded", "previous_file": path}

    def status(self) -> dict:
        return self.catalog.status()

    @property
    def trace(self) -> Trace:
        return self.catalog.get()

    def sql(self, text: str) -> DataFrame:
        """Any query over the views wave, signals and trace_info."""
        self.catalog.get()
        return self.spark.sql(text)

    # Names

    def signals(self, pattern: str | None = None, limit: int = 500) -> dict:
        found = names.list_signals(self.trace.signals, pattern)
        total = found.count()
        shown = [r[0] for r in found.orderBy("signal_name").limit(limit).collect()]
        return {"signals": shown, "total_signals": total, "truncated": total > limit}

    def tree(self, max_depth: int = 4) -> dict:
        rows = names.tree(self.trace.signals, max_depth).collect()
        return {"tree": "\n".join(render.tree_lines([(r["path"], r["signal_count"]) for r in rows]))}

    def hierarchy(self, pattern: str | None = None, depth: int = 3, most_lines: int = 100) -> dict:
        rows = names.hierarchy(self.trace.signals, pattern, depth).collect()
        lines = render.tree_lines([(r["module"], r["signal_count"]) for r in rows])
        return {"pattern": pattern, "depth": depth, "hierarchy": "\n".join(lines[:most_lines]), "modules": [r.asDict() for r in sorted(rows, key=lambda r: r["module"])]}

    def expand(self, wanted: str | list[str], max_expand: int | None = None) -> list[str]:
        asked = names.split_list(wanted) if isinstance(wanted, str) else list(wanted)
        if not any(re.search(r"[*?]", a) for a in asked):
            return list(dict.fromkeys(asked))
        return [r["signal_name"] for r in names.expand(self.trace.signals, asked, max_expand or 1 << 31).orderBy("place").collect()]

    def _known(self, wanted: list[str]) -> list[str]:
        """Looks names up, all in one job; returns those that weren't known before."""
        path = self.trace.path
        new = [w for w in dict.fromkeys(wanted) if (path, w) not in self._resolved]
        if new:
            for r in names.resolve(self.trace.signals, new).collect():
                self._resolved[path, r["requested"]] = r.asDict()
        return new

    def resolve(self, wanted: list[str]) -> list[dict]:
        """signal_id, signal_name and match of each name; ``cached`` says whether it was known."""
        path, new = self.trace.path, self._known(wanted)
        missing = [w for w in wanted if (path, w) not in self._resolved]
        if missing:
            raise SignalNotFoundError(f"signal not found: {missing[0]}")
        return [self._resolved[path, w] | {"cached": w not in new} for w in wanted]

    def _chosen(self, wanted: str | list[str]) -> list[dict]:
        """Distinct signals of a request; later names of the same signal become aliases."""
        out: dict[int, dict] = {}
        for name, r in zip(w := self.expand(wanted), self.resolve(w), strict=True):
            if r["signal_id"] in out:
                out[r["signal_id"]]["aliases"].append(name)
            else:
                out[r["signal_id"]] = {"signal": r["signal_name"], "signal_id": r["signal_id"], "requested": name, "match": r["match"], "aliases": []}
        return list(out.values())

    def _wave(self, chosen: list[dict]) -> DataFrame:
        return self.trace.wave.where(F.col("signal_id").isin([c["signal_id"] for c in chosen]))

    def _range(self, start: int | None, end: int | None, clock: str | None = None, start_cycle: int | None = None, end_cycle: int | None = None, edge: str = "rising") -> tuple[int, int]:
        if clock is not None or start_cycle is not None or end_cycle is not None:
            if clock is None or start_cycle is None or end_cycle is None:
                raise InvalidRangeError("clock, start_cycle and end_cycle go together")
            own = self._wave(self._chosen([clock]))
            last = self.spark.createDataFrame([(self.trace.bounds[1],)], "end_time long")
            row = cycles.cycle_ranges(cycles.cycle_table(own, edge), start_cycle, end_cycle, last).first()
            if row is None:
                raise SignalNotFoundError(f"{clock} has no cycle {start_cycle}")
            return row["start_time"], row["end_time"]
        lo, hi = self.trace.bounds
        start, end = lo if start is None else start, hi if end is None else end
        steps.check_range(start, end)
        return start, end

    @staticmethod
    def _total(found: DataFrame, rows: list, limit: int) -> int:
        """How many rows there are, counted only where the shown ones aren't all."""
        return len(rows) if len(rows) < limit else found.count()

    # Queries

    def query(self, signal: str, start: int | None = None, end: int | None = None, max_changes: int | None = None) -> dict:
        start, end = self._range(start, end)
        one = self._chosen([signal])
        found = lookups.query_range(self._wave(one), start, end).orderBy("timestamp", "seq")
        # The initial value comes first, and one change more says whether there are more.
        rows = (found if max_changes is None else found.limit(max_changes + 2)).collect()
        changes = [(r["timestamp"], r["value_raw"]) for r in rows if r["kind"] == "change"]
        initial = next((r["value_raw"] for r in rows if r["kind"] == "initial"), None)
        out = {"signal": signal, "resolved_signal": one[0]["signal"], "signal_id": one[0]["signal_id"], "start": start, "end": end, "initial_value": initial, "changes": changes}
        if max_changes is not None and len(changes) > max_changes:
            out |= {"changes": changes[:max_changes], "truncated": True, "total_changes": self._wave(one).where(F.col("timestamp").between(start, end)).count()}
        return out

    def query_cycles(self, signal: str, clock: str, start_cycle: int, end_cycle: int, edge: str = "rising") -> dict:
        start, end = self._range(None, None, clock, start_cycle, end_cycle, edge)
        return self.query(signal, start, end) | {"clock": clock, "start_cycle": start_cycle, "end_cycle": end_cycle, "edge": edge}

    def probe(self, wanted, start=None, end=None, include_changes: bool = False, max_changes: int = 200, max_unique: int = 32, **by_cycle) -> dict:
        start, end = self._range(start, end, **by_cycle)
        chosen = self._chosen(wanted)
        wave = self._wave(chosen)
        summary = {r["signal_id"]: r.asDict() for r in lookups.probe(wave, start, end).collect()}
        unique: dict[int, list] = {}
        for r in lookups.probe_unique(wave, start, end, max_unique).orderBy("signal_id", "place").collect():
            unique.setdefault(r["signal_id"], []).append(r["value_raw"])
        changes: dict[int, list] = {}
        if include_changes:
            for r in lookups.probe_changes(wave, start, end, max_changes).orderBy("signal_id", "place").collect():
                changes.setdefault(r["signal_id"], []).append((r["timestamp"], r["value_raw"]))
        none = {"initial_value": None, "final_value": None, "change_count": 0, "transition_count": 0, "first_change": None, "last_change": None}
        out = []
        for c in chosen:
            row = {**c, **none, **summary.get(c["signal_id"], {}), "unique_values": unique.get(c["signal_id"], [])}
            if include_changes:
                row |= {"changes": changes.get(c["signal_id"], []), "truncated": row["change_count"] > max_changes}
            out.append(row)
        return {"start": start, "end": end, "signals": out}

    def inspect(self, wanted, start=None, end=None, include_changes: bool = True, max_changes: int = 200, max_unique: int = 32, max_pairs: int = 8, **by_cycle) -> dict:
        out = self.probe(wanted, start, end, include_changes, max_changes, max_unique, **by_cycle)
        chosen = out["signals"]
        ids = self.spark.createDataFrame([(c["signal_id"], c["signal"]) for c in chosen], "signal_id long, signal_name string")
        wave = self._wave(chosen)
        summary = semantics.summary(wave, ids, out["start"], out["end"])
        analysed = {r["signal_id"]: r.asDict() for r in summary.join(semantics.describe(summary, ids).drop("signal_name"), "signal_id").collect()}
        for c in chosen:
            c["analysis"] = analysed[c["signal_id"]]
        relations = [{"type": "handshake", **r.asDict()} for r in semantics.handshake(wave, ids, out["start"], out["end"]).collect()]
        if 1 < len(chosen) <= max_pairs:
            pos = self.spark.createDataFrame([(i, c["signal_id"]) for i, c in enumerate(chosen)], "pos int, signal_id long")
            by_id = {c["signal_id"]: c["signal"] for c in chosen}
            for r in semantics.coactivity(wave, pos, out["start"], out["end"]).collect():
                row = r.asDict()
                relations.append({"type": "coactivity", "a": by_id[row.pop("a_id")], "b": by_id[row.pop("b_id")], **row})
        return out | {"relations": relations}

    def analyze(self, signal: str, start=None, end=None) -> dict:
        row = self.inspect([signal], start, end, False)["signals"][0]
        return {"signal": row["signal"], "window": (start, end), "initial_value": row["initial_value"], "toggle_count": row["change_count"], "is_stable": row["change_count"] == 0, "description": row["analysis"]["description"]}

    def find_stall(self, signal: str, min_duration: int = 1000, start=None, end=None, max_results: int = 10) -> dict:
        start, end = self._range(start, end)
        one = self._chosen([signal])
        found = lookups.find_stall(self._wave(one), start, end, min_duration).drop("signal_id")
        rows = [r.asDict() for r in found.orderBy(F.desc("duration"), "start_time").limit(max_results).collect()]
        return {"signal": one[0]["signal"], "search_range": {"start": start, "end": end}, "min_duration_threshold": min_duration, "stall_periods": rows, "total_found": self._total(found, rows, max_results)}

    def find_event(self, signal: str, value: str, start=None, end=None, edge: str = "any", max_results: int = 20, parity: bool = False) -> dict:
        start, end = self._range(start, end)
        one = self._chosen([signal])
        rows = lookups.find_event(self._wave(one), value, start, end, edge, max_results, parity).orderBy("timestamp", "seq").collect()
        events = [{"time": r["timestamp"], "value": r["value_raw"], "prev": r["prev_value"]} for r in rows]
        return {"signal": one[0]["signal"], "search_value": value, "edge": edge, "events": events, "total_found": len(events)}

    def last_activity(self, wanted=None, pattern: str | None = None, sort_by: str = "time_desc", limit: int = 20) -> dict:
        known = names.list_signals(self.trace.signals, pattern).select("signal_name") if pattern or not wanted else self.spark.createDataFrame([(c["signal"],) for c in self._chosen(wanted)], "signal_name string")
        ids = self.trace.signals.select("signal_id", "signal_name").join(known, "signal_name")
        found = lookups.last_activity(self.trace.wave.join(ids.select("signal_id").distinct(), "signal_id", "left_semi")).join(ids, "signal_id")
        order = {"time_desc": [F.desc("last_change_time"), "signal_name"], "time_asc": ["last_change_time", "signal_name"]}.get(sort_by, ["signal_name"])
        rows = found.orderBy(*order).limit(limit).collect()
        return {"activities": [{"signal": r["signal_name"], "last_change_time": r["last_change_time"], "final_value": r["final_value"]} for r in rows], "total_checked": self._total(found, rows, limit)}

    def compare_points(self, wanted, time_a: int, time_b: int) -> dict:
        asked = self.expand(wanted)
        self._known(asked)
        known = [w for w in asked if (self.trace.path, w) in self._resolved]
        chosen = [c for w in known for c in self._chosen([w])]
        errors = [{"signal": w, "error": f"signal not found: {w}"} for w in asked if w not in known]
        found = {r["signal_id"]: r for r in lookups.compare_points(self._wave(chosen), time_a, time_b).collect()}
        rows = []
        for c in chosen:
            r = found.get(c["signal_id"])
            rows.append({"signal": c["requested"], "resolved": c["signal"], f"value_at_{time_a}": r and r["value_a"], f"value_at_{time_b}": r and r["value_b"], "changed": bool(r and r["changed"])})
        return {"time_a": time_a, "time_b": time_b, "comparisons": rows + errors, "changed_count": sum(r["changed"] for r in rows)}

    # Diagnostics

    def busy_tree(self, root: str, time: int, busy_patterns: list[str] | None = None) -> dict:
        rows = diagnose.busy_tree(self.trace.wave, self.trace.signals, re.escape(root), time, busy_patterns).orderBy("depth", "signal_name").collect()
        busy = [r.asDict() for r in rows if r["is_busy"]]
        return {"root": root, "time": time, "busy_count": len(busy), "total_checked": len(rows), "tree": "\n".join("  " * r["depth"] + r["signal_name"].rsplit(".", 1)[-1] + "=1" for r in busy[:80]), "details": busy[:30]}

    def find_deadlock(self, time: int, signals: list[str] | None = None, module: str | None = None) -> dict:
        found = diagnose.find_deadlock(self.trace.wave, self.trace.signals, time, signals, module)
        rows = found.orderBy(F.desc("issue_count"), "module").limit(20).collect()
        state = diagnose.watched_state(self.trace.wave, self.trace.signals, time, signals, module)
        shown: dict[str, dict] = {r["module"]: {} for r in rows}
        watched = F.lower("leaf").rlike("valid|ready|busy|stall") & F.col("module").isin(list(shown))
        for r in state.where(watched).orderBy("leaf").collect() if rows else []:
            shown[r["module"]][r["leaf"]] = r["value"]
        return {
            "time": time, "total_signals_checked": state.count(), "potential_deadlocks": self._total(found, rows, 20),
            "candidates": [{**r.asDict(), "signals": shown[r["module"]]} for r in rows], "note": "Modules with valid=1/ready=0 or busy=1 patterns",
        }

    def trace_dependency(self, signal: str, time: int, direction: str = "backward", max_depth: int = 5) -> dict:
        start = self._chosen([signal])[0]["signal"]
        rows = diagnose.trace_dependency(self.trace.wave, self.trace.signals, start, time, direction, max_depth).orderBy("depth", "signal_name").collect()
        lines = [f"{'  ' * r['depth']}{r['signal_name']}={r['value']}" + (f" <- {r['note']}" if r["note"] else "") for r in rows]
        return {"start_signal": start, "time": time, "direction": direction, "trace": lines[:30], "details": [r.asDict() for r in rows[:30]]}

    def compare_traces(self, labels: dict[str, str], busy: str, handshakes: dict[str, tuple[str, str]], command: str, response: str) -> dict:
        """Metrics of files by label, side by side."""
        loaded = {label: self.catalog.load(path) for label, path in labels.items()}
        rows = traces.metrics({k: (t.wave, t.signals) for k, t in loaded.items()}, busy, handshakes, command, response).collect()
        return {label: {r["metric"]: {k: v for k, v in r.asDict().items() if k not in ("trace", "metric")} for r in rows if r["trace"] == label} for label in labels}
