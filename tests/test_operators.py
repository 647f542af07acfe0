"""Operators against hand-derived rows and a naive step-function simulator."""

import random

import pytest
from pyspark.sql import functions as F

from tracequery.functions import values
from tracequery.operators import cycles, diagnose, lookups, names, semantics, steps, traces
from tracequery.schema import InvalidRangeError, SignalNotFoundError

#: A clock and a bus.
SIMPLE = [(0, 0, "0"), (0, 1, "00000000"), (5, 0, "1"), (10, 0, "0"), (10, 1, "11111111"), (15, 0, "1"), (20, 0, "0")]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def bit(v):
    return {"0": 0, "1": 1}.get((v or "").strip())


class Naive:
    """Values by looking through all changes for every tick."""

    def __init__(self, changes):
        self.changes = [(t, i, s, v) for i, (t, s, v) in enumerate(changes)]

    def at(self, signal, t, strict=False):
        seen = [(u, i, v) for u, i, s, v in self.changes if s == signal and (u < t if strict else u <= t)]
        return max(seen)[2] if seen else None

    def inside(self, signal, a, b):
        return [(u, v) for u, i, v in sorted((u, i, v) for u, i, s, v in self.changes if s == signal and a <= u <= b)]


def random_trace(seed, n=120, signals=4, span=60):
    rng = random.Random(seed)
    return [(rng.randrange(span), rng.randrange(signals), rng.choice(["0", "1", "0", "1", "x", "z", "10"])) for _ in range(n)]


def test_simple_queries(make_wave, make_names):
    w = make_wave(SIMPLE)
    q = rows(lookups.query_range(w.where("signal_id = 0"), 0, 20), "timestamp")
    assert [r[2] for r in q] == [0, 5, 10, 15, 20] and all(r[1] == "change" for r in q)
    assert rows(lookups.query_range(w.where("signal_id = 1"), 5, 9)) == [(1, "initial", 0, 1, "00000000")]
    assert rows(cycles.cycle_table(w.where("signal_id = 0")), "cycle") == [(0, 0, 5), (0, 1, 15)]
    assert rows(cycles.cycle_table(w.where("signal_id = 0"), "falling"), "cycle") == [(0, 0, 0), (0, 1, 10), (0, 2, 20)]
    c, end = cycles.cycle_table(w.where("signal_id = 0")), lookups.bounds(w)
    assert rows(cycles.cycle_ranges(c, 0, 0, end)) == [(0, 5, 14)]
    assert rows(cycles.cycle_ranges(c, 1, 1, end)) == [(0, 15, 20)]
    assert rows(cycles.cycle_ranges(c, 7, 7, end)) == []
    s = {r.signal_id: r for r in semantics.summary(w, make_names(["clk", "data"]), 0, 20).collect()}
    assert (s[0].rising, s[0].falling, s[0].hold_min, s[0].hold_max, s[0].hold_avg) == (2, 2, 0, 5, 3.5)
    assert rows(lookups.compare_points(w.where("signal_id = 1"), 5, 10)) == [(1, "00000000", "11111111", True)]
    assert [r[1:4] for r in rows(lookups.find_stall(w.where("signal_id = 1"), 0, 20, 10), "start_time")] == [(0, 10, 10), (10, 20, 10)]
    assert rows(lookups.last_activity(w), "signal_id") == [(0, 20, "0"), (1, 10, "11111111")]
    assert rows(semantics.classify(w), "signal_id") == [(0, "logic"), (1, "bus")]


def test_ties_follow_record_order(make_wave):
    w = make_wave([(1, 0, "0"), (5, 0, "1"), (5, 0, "0"), (5, 0, "1"), (9, 0, "0")])
    assert rows(steps.asof(w, 5)) == [(0, "1", 5)]
    assert rows(steps.asof(w, 5, strict=True)) == [(0, "0", 1)]
    assert rows(semantics.high_intervals(w, 0, 10)) == [(0, 5, 9)]
    assert lookups.probe(w, 0, 9).first().change_count == 5


def test_edges_need_bits_but_clock_edges_do_not(make_wave, make_names):
    w = make_wave([(0, 0, "x"), (1, 0, "1"), (2, 0, "x"), (3, 0, "0"), (4, 0, "1")])
    s = semantics.summary(w, make_names(["a"]), 0, 5).first()
    assert (s.rising, s.falling) == (1, 0)
    assert [r[2] for r in rows(cycles.cycle_table(w), "cycle")] == [1, 4]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_ticks", [None, 7])
def test_against_naive(make_wave, make_names, seed, slice_ticks):
    changes = random_trace(seed)
    w, naive, a, b = make_wave(changes), Naive(changes), 10, 45
    assert {r.signal_id: r.value_raw for r in steps.asof(w, 30).collect()} == {s: naive.at(s, 30) for s in range(4)}
    held = {}
    for r in steps.segments(w, a, b, slice_ticks).collect():
        for t in range(r.t_start, r.t_end):
            assert (r.signal_id, t) not in held
            held[r.signal_id, t] = r.value_raw
    assert held == {(s, t): v for s in range(4) for t in range(a, b + 1) if (v := naive.at(s, t)) is not None}
    duty = {r.signal_id: (r.high_time, r.low_time, r.unknown_time) for r in semantics.duty(w, make_names("abcd"), a, b, slice_ticks).collect()}
    for s in range(4):
        bits = [bit(naive.at(s, t)) for t in range(a, b + 1)]
        assert duty[s] == (bits.count(1), bits.count(0), bits.count(None))
    edges = sorted((r.signal_id, r.cycle, r.timestamp) for r in cycles.cycle_table(w, slice_ticks=slice_ticks).collect())
    want = []
    for s in range(4):
        prev, n = None, 0
        for t, v in naive.inside(s, 0, 99):
            if v == "1" and prev != "1":
                want.append((s, n, t))
                n += 1
            prev = v
    assert edges == want


@pytest.mark.parametrize("seed,slice_ticks", [(3, None), (4, None), (3, 7), (4, 20)])
def test_joint_times_against_naive(spark, make_wave, seed, slice_ticks):
    changes = random_trace(seed)
    w, naive, a, b = make_wave(changes), Naive(changes), 5, 50
    pairs = spark.createDataFrame([("p", 0, 1), ("q", 1, 0), ("r", 2, 3)], "pair string, a_id long, b_id long")
    got = {r.pair: r for r in steps.joint_times(w, pairs, a, b, slice_ticks).collect()}
    for pair, x, y in (("p", 0, 1), ("q", 1, 0), ("r", 2, 3)):
        states = [(bit(naive.at(x, t)), bit(naive.at(y, t))) for t in range(a, b + 1)]
        r = got[pair]
        assert (r.both_high, r.both_low, r.a_only, r.b_only) == tuple(states.count(s) for s in ((1, 1), (0, 0), (1, 0), (0, 1)))
        assert r.both_high + r.both_low + r.a_only + r.b_only + r.unknown == r.total_time == b - a + 1
    assert got["p"].a_only == got["q"].b_only


@pytest.mark.parametrize("seed", [5])
def test_events_and_stalls_against_naive(make_wave, seed):
    changes = random_trace(seed)
    w, naive, a, b = make_wave(changes), Naive(changes), 10, 50
    got = sorted((r.signal_id, r.timestamp) for r in lookups.find_event(w, "1", a, b, "rising", None).collect())
    want = []
    for s in range(4):
        prev = naive.at(s, a, strict=True)
        for t, v in naive.inside(s, a, b):
            if v == "1" and prev != "1":
                want.append((s, t))
            prev = v
    assert got == want
    stalls = sorted(tuple(r) for r in lookups.find_stall(w, a, b, 3, slice_ticks=5).collect())
    want = []
    for s in range(4):
        inside = naive.inside(s, a, b)
        for i, (t, v) in enumerate(inside):
            end = inside[i + 1][0] if i + 1 < len(inside) else b
            if end - t >= 3:
                want.append((s, t, end, end - t, v, i + 1 == len(inside)))
    assert stalls == sorted(want)


def test_parity_counts_a_held_value_as_entered(make_wave):
    w = make_wave([(0, 0, "1"), (5, 0, "1"), (7, 0, "0")])
    assert lookups.find_event(w, "1", 3, 9, "rising").count() == 0
    assert lookups.find_event(w, "1", 3, 9, "rising", parity=True).count() == 1


def test_ranges_are_checked(make_wave, make_names):
    w = make_wave(SIMPLE)
    for f in (lambda: lookups.query_range(w, 5, 4), lambda: lookups.probe(w, 5, 4), lambda: steps.segments(w, 9, 1), lambda: semantics.summary(w, make_names(["a"]), 2, 1)):
        with pytest.raises(InvalidRangeError):
            f()
    with pytest.raises(InvalidRangeError):
        cycles.cycle_ranges(w, -1, 2, w)


def test_empty_signal_and_empty_range(make_wave, make_names):
    w = make_wave(SIMPLE)
    s = {r.signal_id: r for r in semantics.summary(w, make_names(["clk", "data", "never"]), 100, 109).collect()}
    assert s[2].initial_value is None and s[2].is_stable and s[2].hold_avg == 10.0
    assert s[0].initial_value == "0" and s[0].change_count == 0
    assert lookups.find_stall(w, 100, 109, 1).count() == 0


def test_probe_lists(make_wave):
    w = make_wave([(1, 0, "a"), (2, 0, "b"), (3, 0, "a"), (4, 0, "c")])
    assert rows(lookups.probe_unique(w, 0, 9, 2), "place") == [(0, 1, "a"), (0, 2, "b")]
    assert rows(lookups.probe_changes(w, 2, 9, 2), "place") == [(0, 1, 2, "b"), (0, 2, 3, "a")]
    p = lookups.probe(w, 2, 9).first()
    assert (p.initial_value, p.final_value, p.change_count, p.first_change, p.last_change) == ("a", "c", 3, 2, 4)


def test_handshake_names(spark):
    n = F.col("n")
    df = spark.createDataFrame([("a.valid",), ("B_Ready",), ("a__valid",), (".ready",), ("valid",), ("io",)], "n string")
    got = {r[0]: (r[1], r[2]) for r in df.select(n, values.handshake_prefix(n), values.handshake_kind(n)).collect()}
    assert got["a.valid"] == ("a", "valid") and got["B_Ready"] == ("B", "ready") and got["a__valid"] == ("a_", "valid") and got[".ready"] == ("", "ready")
    assert got["valid"][1] is None and got["io"][1] is None


def test_handshake_skips_a_prefix_without_partner(make_wave, make_names):
    names_ = make_names(["a.valid", "a.ready", "b.valid"])
    w = make_wave([(0, 0, "1"), (0, 1, "0"), (4, 1, "1"), (0, 2, "1")])
    got = semantics.handshake(w, names_, 0, 9).collect()
    assert [(r.prefix, r.both_high, r.valid_only) for r in got] == [("a", 6, 4)]


def test_names(spark, make_names):
    s = make_names(["top.core0.clk", "top.core1.clk", "top.core1.deep.busy", "top.core1.deep.busy2", "other"])
    assert names.glob_pattern("a.*b?") == r"a\..*b."
    assert [r[1] for r in rows(names.expand(s, ["*core1*", "other", "*clk"]), "place")] == ["top.core1.clk", "top.core1.deep.busy", "top.core1.deep.busy2", "other", "top.core0.clk"]
    with pytest.raises(SignalNotFoundError):
        names.expand(s, ["*nothing*"], 10)
    with pytest.raises(ValueError):
        names.expand(s, ["*core1*"], 2)
    got = {r.requested: (r.signal_name, r.match) for r in names.resolve(s, ["other", "deep.busy", "clk", "core1.bus", "nix"]).collect()}
    assert got == {"other": ("other", "exact"), "deep.busy": ("top.core1.deep.busy", "suffix"), "clk": ("top.core0.clk", "fuzzy"), "core1.bus": ("top.core1.deep.busy", "fuzzy")}
    tree = {r.path: r.signal_count for r in names.tree(s, 2).collect()}
    assert tree == {"top": 4, "top.core0": 1, "top.core1": 3, "other": 1}
    h = {r.module: (r.signal_count, r.children) for r in names.hierarchy(s, "core1").collect()}
    assert h == {"top.core1": (3, "clk,deep"), "top.core1.deep": (2, "busy,busy2")}
    assert names.page(s, 2).first().truncated


def test_diagnose(make_wave, make_names):
    s = make_names(["top.a.io_valid", "top.a.io_ready", "top.a.io_busy", "top.b.busy", "top.full"])
    w = make_wave([(0, 0, "1"), (0, 1, "0"), (0, 2, "1"), (0, 3, "0"), (9, 3, "1"), (0, 4, "1")])
    assert [r[0] for r in rows(diagnose.busy_tree(w, s, "top", 5).where("is_busy"))] == ["top.a.io_busy"]
    d = diagnose.find_deadlock(w, s, 5).collect()
    assert [(r.module, r.issue_count, r.issues) for r in d] == [("top.a", 2, "io_busy=1 (busy); io_valid=1 but io_ready=0")]
    t = {r.signal_name: (r.depth, r.note) for r in diagnose.trace_dependency(w, s, "top.a.io_valid", 5).collect()}
    assert t["top.a.io_valid"] == (0, "Starting point") and t["top.a.io_ready"] == (1, "BLOCKING") and t["top.a.io_busy"] == (1, "BLOCKING")
    assert t["top.full"] == (2, "BLOCKING") and t["top.b.busy"] == (2, "")
    only = diagnose.trace_dependency(w, s, "top.a.io_valid", 5, "forward")
    assert {r.depth for r in only.collect()} == {0, 1}


def test_two_traces(make_wave, make_names):
    s = make_names(["busy", "c.valid", "c.ready", "r.valid", "r.ready"])
    w = make_wave([(0, 0, "0"), (2, 0, "1"), (8, 0, "0"), (0, 1, "0"), (0, 2, "1"), (1, 1, "1"), (5, 1, "0"), (0, 3, "0"), (0, 4, "1"), (7, 3, "1"), (9, 3, "0"), (10, 0, "0")])
    got = {r.metric: r for r in traces.metrics({"t": (w, s)}, "busy", {"cmd": ("c.valid", "c.ready"), "resp": ("r.valid", "r.ready")}, "cmd", "resp").collect()}
    assert (got["busy"].first, got["busy"].last, got["busy"].total) == (2, 7, 6)
    assert (got["cmd"].first, got["cmd"].last) == (1, 4) and (got["resp"].first, got["resp"].last) == (7, 8)
    assert got["cmd in busy window"].total == 3 and got["busy in command window"].total == 3
    assert (got["command to busy"].total, got["busy to response"].total, got["busy span"].total) == (1, 1, 6)


@pytest.mark.parametrize("per_slice", [1, 7, 1000])
def test_samples_of_every_clock_against_brute_force(make_wave, per_slice):
    rng = random.Random(per_slice)
    changes = sorted(((rng.randint(0, 60), rng.randint(0, 4), rng.choice(["0", "1", "x", None])) for _ in range(150)), key=lambda r: r[0])
    w = make_wave([*changes, (70, 9, "late"), (70, 10, None)])
    clocks = cycles.cycle_table(w.where("signal_id < 2"))
    want = []
    for e in clocks.collect():
        for s in {r.signal_id for r in w.select("signal_id").collect()}:
            past = [r for r in changes if r[1] == s and r[0] <= e.timestamp and r[2] is not None]
            want.append((e.signal_id, e.cycle, s, past[-1][2] if past else None))
    got = [tuple(r) for r in cycles.samples(w, clocks, per_slice).collect()]
    assert len(want) > 50 and sorted(got, key=repr) == sorted(want, key=repr)
    assert cycles.samples(w, clocks.where("false")).count() == 0


def test_the_registered_samples_cover_all_clocks_and_signals(spark):
    from tracequery.plans import suite

    sf = "/root/testdata/sf0.001"
    edges = suite.QUERIES["cycle_table_rising"](spark, sf).count()
    got = suite.QUERIES["cycle_samples"](spark, sf)
    n_signals = suite._wave(spark, sf).select("signal_id").distinct().count()
    assert got.count() == got.select("clock_id", "cycle", "signal_id").distinct().count() == edges * n_signals


def test_samples_at_cycles(make_wave):
    w = make_wave(SIMPLE)
    c = cycles.cycle_table(w.where("signal_id = 0"))
    assert rows(cycles.sample(w.where("signal_id = 1"), c), "cycle") == [(1, 0, "00000000"), (1, 1, "11111111")]


def test_plans_have_one_scan_no_python_and_partitioned_windows(spark, tmp_path, make_wave, make_names):
    path = str(tmp_path / "w")
    make_wave(SIMPLE).write.parquet(path)
    w = spark.read.parquet(path)
    for df in (lookups.find_stall(w, 0, 9), cycles.cycle_table(w)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan and "SinglePartition" not in plan
    # What lies before the range is read for its last values only, which are aggregated where they are read.
    for df in (lookups.probe(w, 5, 9), steps.segments(w, 5, 9), semantics.summary(w, make_names(["a"]), 5, 9), lookups.find_event(w, "1", 5, 9, "rising")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and "Python" not in plan and "SinglePartition" not in plan
        assert "LessThan(timestamp,5)" in plan and "GreaterThanOrEqual(timestamp,5), LessThanOrEqual(timestamp,9)" in plan
        assert "partial_max_by" in plan
    assert "PushedFilters: [IsNotNull(timestamp), LessThanOrEqual(timestamp,9)]" in lookups.compare_points(w, 3, 9)._jdf.queryExecution().executedPlan().toString()


def test_partial_summaries_say_so(make_wave, make_names):
    w, names = make_wave(SIMPLE), make_names(["clk", "data"])
    got = semantics.partial(semantics.summary(w, names, 0, 20), 2)
    by = {r.signal_id: r for r in got.collect()}
    assert by[0].analysis_partial and by[0].rising is None and by[0].hold_avg is None and by[0].change_count == 5
    assert not by[1].analysis_partial and by[1].hold_min is not None
    said = {r.signal_id: r.description for r in semantics.describe(got, names).collect()}
    assert said[0].endswith("Sample truncated.") and not said[1].endswith("truncated.")


def test_coactivity_is_of_few_signals(spark, make_wave):
    with pytest.raises(ValueError):
        semantics.coactivity(make_wave(SIMPLE), spark.range(5).selectExpr("id as pos", "id as signal_id"), 0, 9, most=4)


def test_traces_are_compared_in_few_scans(spark, tmp_path, make_wave, make_names):
    path = str(tmp_path / "w")
    make_wave(SIMPLE).write.parquet(path)
    w, names = spark.read.parquet(path), make_names(["clk", "data"])
    plan = traces.metrics({"a": (w, names), "b": (w, names)}, "clk", {"h": ("clk", "data")}, "h", "h")._jdf.queryExecution().executedPlan().toString()
    # For each trace: its busy signal, its pairs, and its end.
    assert plan.count("FileScan") == 6 and plan.count("Exchange") <= 40 and "CartesianProduct" not in plan
