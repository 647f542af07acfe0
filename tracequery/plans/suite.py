"""Registered queries of the trace operators and their SQL twins.

The traces are made of the event and order tables; every query works on all
rows.  Times are microseconds within the events' month.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import depth, leaf, module, ratio, scalar_code
from ..operators import cycles, diagnose, lookups, names, semantics, steps, traces
from ..sources import tables, vcd

START, END, AT = 1_704_500_000_000_000, 1_706_000_000_000_000, 1_705_363_200_000_000
SLICE = 200_000_000_000
GAP = 20_000_000_000
HANDSHAKES = {"core0": ("top.core0.io_valid", "top.core0.io_ready"), "core1": ("top.core1.io_valid", "top.core1.io_ready")}
RESOLVED = ["top.core1.clock", "core2.data", "core3.io_re", "core?.cl", "no.such.signal"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The event trace in SQL: w has the changes, s the names.
_TRACE = """
WITH RECURSIVE w AS (
  SELECT epoch_us(ts) AS timestamp, event_id AS seq, (user_id % 4) * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS signal_id,
    'top.core' || (user_id % 4) || '.' || CASE event_type WHEN 'click' THEN 'io_valid' WHEN 'view' THEN 'io_ready' WHEN 'error' THEN 'io_busy' WHEN 'signup' THEN 'clock' ELSE 'data' END AS signal_name,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN value < 5 THEN 'x' ELSE CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) END AS value_raw
  FROM events),
s AS (
  SELECT c * 5 + i - 1 AS signal_id, 'top.core' || c || '.' || ['io_valid', 'io_ready', 'io_busy', 'clock', 'data'][i] AS signal_name
  FROM range(4) a(c), range(1, 6) b(i)),
"""
_BIT = "CASE trim({0}) WHEN '0' THEN 0 WHEN '1' THEN 1 END"
_W = "OVER (PARTITION BY signal_id ORDER BY timestamp, seq)"
#: Pieces of [START, END + 1) over which values hold.
_SEGMENTS = f"""
seg AS (
  SELECT * FROM (
    SELECT signal_id, greatest(timestamp, {START}) AS t_start, coalesce(lead(timestamp) {_W}, {END + 1}) AS t_end, seq, value_raw
    FROM w WHERE timestamp <= {END}) WHERE t_end > t_start),
"""
_BITS = f"segb AS (SELECT *, {_BIT.format('value_raw')} AS b, t_end - t_start AS dur FROM seg),"


def _joint(pairs: str, out: str, start: int = START, end: int = END) -> str:
    """Joint state pieces of pairs (pair, a_id, b_id)."""
    return f"""
{out}_points AS (
  SELECT pair, timestamp, seq, side, CASE WHEN side = 0 THEN value_raw END AS va, CASE WHEN side = 1 THEN value_raw END AS vb
  FROM (SELECT pair, a_id AS signal_id, 0 AS side FROM {pairs} UNION ALL SELECT pair, b_id, 1 FROM {pairs}) p JOIN w USING (signal_id) WHERE timestamp <= {end}),
{out} AS (
  SELECT pair, t_start, t_end, {_BIT.format('fa')} AS a_bit, {_BIT.format('fb')} AS b_bit
  FROM (
    SELECT pair, greatest(timestamp, {start}) AS t_start, coalesce(lead(timestamp) OVER o, {end + 1}) AS t_end,
      last_value(va IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fa, last_value(vb IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fb
    FROM {out}_points WINDOW o AS (PARTITION BY pair ORDER BY timestamp, seq, side))
  WHERE t_end > t_start),
"""


def _query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_wave(spark, sf_dir).drop("signal_name")


def _signals(spark: SparkSession) -> DataFrame:
    return tables.events_signals(spark)


# Names


@_query("signals_list", _TRACE + "z AS (SELECT 1) SELECT signal_name FROM s")
def signals_list(spark, sf_dir):
    return names.list_signals(_signals(spark))


@_query("signals_regex", _TRACE + "z AS (SELECT 1) SELECT signal_name FROM s WHERE regexp_matches(signal_name, 'core[12].*io_')")
def signals_regex(spark, sf_dir):
    return names.list_signals(_signals(spark), "core[12].*io_")


@_query("signals_glob", _TRACE + "z AS (SELECT 1) SELECT signal_name FROM s WHERE regexp_matches(signal_name, 'core.\\.io_.*y')")
def signals_glob(spark, sf_dir):
    return names.list_signals(_signals(spark), names.glob_pattern("core?.io_*y"))


@_query("signals_page", _TRACE + "z AS (SELECT 1) SELECT signal_name, CAST(20 AS BIGINT) AS total_signals, true AS truncated FROM s ORDER BY signal_name LIMIT 7")
def signals_page(spark, sf_dir):
    return names.page(_signals(spark), 7)


@_query("signals_expand", _TRACE + """
e AS (
  SELECT signal_name, min(pos) AS pos FROM (
    SELECT 0 AS pos, signal_name FROM s WHERE regexp_matches(signal_name, 'core2\\..*') UNION ALL SELECT 1, 'top.core0.clock' UNION ALL SELECT 2, signal_name FROM s WHERE regexp_matches(signal_name, '.*\\.clock'))
  GROUP BY signal_name)
SELECT row_number() OVER (ORDER BY pos, signal_name) - 1 AS place, signal_name FROM e""")  # fmt: skip
def signals_expand(spark, sf_dir):
    return names.expand(_signals(spark), ["core2.*", "top.core0.clock", "*.clock"])


_PLACES = """
WITH p AS (
  SELECT c_custkey AS signal_id, replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') || '.' || replace(c_name, '#', '_') AS signal_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
parts AS (SELECT signal_name, string_split(signal_name, '.') AS a, unnest(range(1, 4)) AS depth FROM p),
"""


@_query("signals_tree", _PLACES + "z AS (SELECT 1) SELECT array_to_string(a[1:depth], '.') AS path, depth, count(*) AS signal_count FROM parts WHERE depth <= 2 GROUP BY ALL")
def signals_tree(spark, sf_dir):
    return names.tree(tables.place_names(spark, sf_dir), 2)


@_query("hierarchy", _PLACES + """
q AS (SELECT * FROM parts WHERE contains(signal_name, 'ASIA') AND depth < 3)
SELECT array_to_string(a[1:depth], '.') AS module, count(*) AS signal_count, string_agg(DISTINCT a[depth + 1], ',' ORDER BY a[depth + 1]) AS children FROM q GROUP BY 1""")  # fmt: skip
def hierarchy(spark, sf_dir):
    return names.hierarchy(tables.place_names(spark, sf_dir), "ASIA")


_ASKED = "r(requested, ending, anywhere, p1, p2, p3, n) AS (VALUES ('top.core1.clock', '%top.core1.clock', '%top%core1%clock%', 'top', 'core1', 'clock', 3), ('core2.data', '%core2.data', '%core2%data%', 'core2', 'data', NULL, 2), ('core3.io_re', '%core3.io_re', '%core3%io_re%', 'core3', 'io_re', NULL, 2), ('core?.cl', '%core_.cl', '%core_%cl%', 'core_', 'cl', NULL, 2), ('no.such.signal', '%no.such.signal', '%no%such%signal%', 'no', 'such', 'signal', 3)),"


@_query("resolve", _TRACE + _ASKED + """
c AS (SELECT *, signal_name = requested AS ex, signal_name LIKE ending AS en FROM r JOIN s ON signal_name = requested OR signal_name LIKE ending OR signal_name LIKE anywhere),
f AS (
  SELECT *, instr(signal_name, p1) AS i1 FROM c),
g AS (SELECT *, CASE WHEN i1 > 0 THEN instr(substr(signal_name, i1 + length(p1)), p2) ELSE 0 END AS i2, i1 + length(p1) AS k1 FROM f),
h AS (
  SELECT *, CASE WHEN i2 > 0 AND p3 IS NOT NULL THEN instr(substr(signal_name, k1 + i2 - 1 + length(p2)), p3) ELSE 0 END AS i3,
    max(ex) OVER (PARTITION BY requested) AS has_ex, count(*) FILTER (WHERE en) OVER (PARTITION BY requested) AS n_en FROM g),
m AS (
  SELECT *, CASE WHEN has_ex THEN 'exact' WHEN n_en = 1 THEN 'suffix' ELSE 'fuzzy' END AS match,
    CASE WHEN ex THEN 1000 ELSE 0 END + CASE WHEN ends_with(signal_name, requested) THEN 400 ELSE 0 END + 10 * n
    + CASE WHEN i1 = 0 THEN -5 WHEN i2 = 0 THEN 0 WHEN n = 2 THEN 10 WHEN i3 = 0 THEN 5 ELSE 15 END - length(signal_name) // 5 AS score FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY requested ORDER BY score DESC, length(signal_name), signal_name) AS place
  FROM m WHERE CASE match WHEN 'exact' THEN ex WHEN 'suffix' THEN en ELSE signal_name LIKE anywhere END)
SELECT requested, signal_id, signal_name, match FROM o WHERE place = 1""")  # fmt: skip
def resolve(spark, sf_dir):
    return names.resolve(_signals(spark), RESOLVED)


@_query("name_parts", _TRACE + "z AS (SELECT 1) SELECT signal_name, regexp_replace(signal_name, '\\.[^.]*$', '') AS module, regexp_extract(signal_name, '[^.]*$') AS leaf, CAST(2 AS BIGINT) AS depth FROM s")
def name_parts(spark, sf_dir):
    n = F.col("signal_name")
    return _signals(spark).select(n, module(n).alias("module"), leaf(n).alias("leaf"), depth(n).cast("long").alias("depth"))


# Points and ranges


@_query("status", _TRACE + "z AS (SELECT 1) SELECT count(DISTINCT signal_id) AS signal_count, min(timestamp) AS start_time, max(timestamp) AS end_time FROM w")
def status(spark, sf_dir):
    return lookups.status(_wave(spark, sf_dir))


@_query("bounds", _TRACE + "z AS (SELECT 1) SELECT min(timestamp) AS start_time, max(timestamp) AS end_time FROM w")
def bounds(spark, sf_dir):
    return lookups.bounds(_wave(spark, sf_dir))


@_query("scalar_codes", _TRACE + "z AS (SELECT 1) SELECT value_raw, CAST(CASE lower(value_raw) WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'x' THEN 2 WHEN 'z' THEN 3 ELSE 255 END AS SMALLINT) AS value_scalar, count(*) AS n FROM w GROUP BY value_raw")
def scalar_codes(spark, sf_dir):
    return _wave(spark, sf_dir).groupBy("value_raw").agg(F.count(F.lit(1)).alias("n")).select("value_raw", scalar_code(F.col("value_raw")).alias("value_scalar"), "n")


@_query("query_range", _TRACE + f"""
i AS (SELECT signal_id, 'initial' AS kind, max_by(timestamp, timestamp) AS timestamp, arg_max(seq, (timestamp, seq)) AS seq, arg_max(value_raw, (timestamp, seq)) AS value_raw FROM w WHERE timestamp < {START} GROUP BY signal_id)
SELECT * FROM i UNION ALL SELECT signal_id, 'change', timestamp, seq, value_raw FROM w WHERE timestamp BETWEEN {START} AND {END}""")  # fmt: skip
def query_range(spark, sf_dir):
    return lookups.query_range(_wave(spark, sf_dir), START, END)


_ASOF = _TRACE + "z AS (SELECT 1) SELECT signal_id, arg_max(value_raw, (timestamp, seq)) AS value_raw, max(timestamp) AS timestamp FROM w WHERE timestamp {0} {1} GROUP BY signal_id"


@_query("asof_strict", _ASOF.format("<", AT))
def asof_strict(spark, sf_dir):
    return steps.asof(_wave(spark, sf_dir), AT, strict=True)


@_query("asof_incl", _ASOF.format("<=", AT))
def asof_incl(spark, sf_dir):
    return steps.asof(_wave(spark, sf_dir), AT)


@_query("asof_times", _TRACE + f"""
t AS (SELECT unnest([{START - 10**12}, {START}, {AT}, {END}]) AS time)
SELECT s.signal_id, time, (SELECT arg_max(value_raw, (timestamp, seq)) FROM w WHERE w.signal_id = s.signal_id AND w.timestamp <= time) AS value_raw FROM s, t""")  # fmt: skip
def asof_times(spark, sf_dir):
    times = spark.createDataFrame([(START - 10**12,), (START,), (AT,), (END,)], "time long")
    return steps.asof_times(_wave(spark, sf_dir), times, _signals(spark))


@_query("asof_ties", """
WITH w AS (
  SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS timestamp, o_orderkey AS seq, CAST(o_orderpriority[1] AS BIGINT) AS signal_id, CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '0' ELSE 'x' END AS value_raw
  FROM orders)
SELECT signal_id, arg_max(value_raw, (timestamp, seq)) AS value_raw, max(timestamp) AS timestamp FROM w WHERE timestamp <= 10000 GROUP BY signal_id""")  # fmt: skip
def asof_ties(spark, sf_dir):
    return steps.asof(tables.orders_wave(spark, sf_dir), 10000)


@_query("probe_summary", _TRACE + f"""
k AS (SELECT *, lag(value_raw) {_W} AS pv, timestamp >= {START} AS here FROM w WHERE timestamp <= {END})
SELECT signal_id, arg_max(value_raw, (timestamp, seq)) FILTER (WHERE NOT here) AS initial_value, arg_max(value_raw, (timestamp, seq)) AS final_value, count(*) FILTER (WHERE here) AS change_count,
  count(*) FILTER (WHERE here AND value_raw IS DISTINCT FROM pv) AS transition_count, min(timestamp) FILTER (WHERE here) AS first_change, max(timestamp) FILTER (WHERE here) AS last_change
FROM k GROUP BY signal_id""")  # fmt: skip
def probe_summary(spark, sf_dir):
    return lookups.probe(_wave(spark, sf_dir), START, END)


@_query("probe_unique", _TRACE + f"""
f AS (SELECT signal_id, value_raw, min((timestamp, seq)) AS first FROM w WHERE timestamp BETWEEN {START} AND {END} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY first) AS place FROM f)
SELECT signal_id, place, value_raw FROM r WHERE place <= 4""")  # fmt: skip
def probe_unique(spark, sf_dir):
    return lookups.probe_unique(_wave(spark, sf_dir), START, END, 4)


@_query("probe_changes", _TRACE + f"r AS (SELECT signal_id, row_number() {_W} AS place, timestamp, value_raw FROM w WHERE timestamp BETWEEN {START} AND {END}) SELECT * FROM r WHERE place <= 20")
def probe_changes(spark, sf_dir):
    return lookups.probe_changes(_wave(spark, sf_dir), START, END, 20)


@_query("probe_alias", """
SELECT CAST(3 AS BIGINT) AS signal_id, 'top.core0.clock' AS signal_name, 'core0.clock,clk' AS aliases UNION ALL SELECT 9, 'top.core1.data', ''""")  # fmt: skip
def probe_alias(spark, sf_dir):
    asked = spark.createDataFrame([(0, "top.core0.clock", 3), (1, "core0.clock", 3), (2, "top.core1.data", 9), (3, "clk", 3)], "pos int, requested string, signal_id long")
    order = Window.partitionBy("signal_id").orderBy("pos")
    ranked = asked.withColumn("n", F.row_number().over(order))
    later = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("pos", "requested")))), lambda r: r["requested"])
    return ranked.groupBy("signal_id").agg(F.min_by("requested", "pos").alias("signal_name"), F.array_join(later, ",").alias("aliases"))


@_query("last_activity", _TRACE + "z AS (SELECT 1) SELECT signal_id, max(timestamp) AS last_change_time, arg_max(value_raw, (timestamp, seq)) AS final_value FROM w GROUP BY signal_id")
def last_activity(spark, sf_dir):
    return lookups.last_activity(_wave(spark, sf_dir))


@_query("compare_points", _TRACE + f"""
c AS (SELECT signal_id, arg_max(value_raw, (timestamp, seq)) FILTER (WHERE timestamp <= {START}) AS value_a, arg_max(value_raw, (timestamp, seq)) AS value_b FROM w WHERE timestamp <= {AT} GROUP BY signal_id)
SELECT *, value_a IS DISTINCT FROM value_b AS changed FROM c""")  # fmt: skip
def compare_points(spark, sf_dir):
    return lookups.compare_points(_wave(spark, sf_dir), START, AT)


_EVENT = "p AS (SELECT *, lag(value_raw) " + _W + " AS prev_value FROM w WHERE timestamp {0} {1}),"


@_query("find_event_any", _TRACE + f"r AS (SELECT *, row_number() {_W} AS n FROM w WHERE timestamp BETWEEN {START} AND {END} AND value_raw = '1') SELECT signal_id, timestamp, seq, value_raw, CAST(NULL AS VARCHAR) AS prev_value FROM r WHERE n <= 20")
def find_event_any(spark, sf_dir):
    return lookups.find_event(_wave(spark, sf_dir), "1", START, END)


@_query("find_event_rising", _TRACE + _EVENT.format("<=", END) + f"z AS (SELECT 1) SELECT signal_id, timestamp, seq, value_raw, prev_value FROM p WHERE timestamp >= {START} AND value_raw = '1' AND prev_value IS DISTINCT FROM '1'")
def find_event_rising(spark, sf_dir):
    return lookups.find_event(_wave(spark, sf_dir), "1", START, END, "rising", None)


@_query("find_event_falling", _TRACE + _EVENT.format("<=", END) + f"z AS (SELECT 1) SELECT signal_id, timestamp, seq, value_raw, prev_value FROM p WHERE timestamp >= {START} AND prev_value = '1' AND value_raw <> '1'")
def find_event_falling(spark, sf_dir):
    return lookups.find_event(_wave(spark, sf_dir), "1", START, END, "falling", None)


@_query("find_event_parity", _TRACE + _EVENT.format("BETWEEN", f"{START} AND {END}") + "z AS (SELECT 1) SELECT signal_id, timestamp, seq, value_raw, prev_value FROM p WHERE value_raw = '1' AND prev_value IS DISTINCT FROM '1'")
def find_event_parity(spark, sf_dir):
    return lookups.find_event(_wave(spark, sf_dir), "1", START, END, "rising", None, parity=True)


_STALL = f"""
g AS (
  SELECT signal_id, greatest(timestamp, {START}) AS start_time, coalesce(lead(timestamp) {_W}, {END}) AS end_time, value_raw AS value_held, lead(timestamp) {_W} IS NULL AS potential_hang
  FROM w WHERE timestamp {{0}} {END})
SELECT signal_id, start_time, end_time, end_time - start_time AS duration, value_held, potential_hang FROM g WHERE end_time - start_time >= {GAP}"""


@_query("find_stall", _TRACE + _STALL.format(f"BETWEEN {START} AND"))
def find_stall(spark, sf_dir):
    return lookups.find_stall(_wave(spark, sf_dir), START, END, GAP, slice_ticks=SLICE)


@_query("find_stall_lead", _TRACE + _STALL.format("<="))
def find_stall_lead(spark, sf_dir):
    return lookups.find_stall(_wave(spark, sf_dir), START, END, GAP, include_lead=True)


# Semantics

_SUMMARY = f"""
k AS (SELECT *, lag(value_raw) {_W} AS pv, lag(timestamp) {_W} AS pt, timestamp >= {START} AS here FROM w WHERE timestamp <= {END}),
a AS (
  SELECT signal_id, count(*) FILTER (WHERE here) AS change_count, count(*) FILTER (WHERE here AND trim(pv) = '0' AND trim(value_raw) = '1') AS rising, count(*) FILTER (WHERE here AND trim(pv) = '1' AND trim(value_raw) = '0') AS falling,
    min(timestamp - greatest(coalesce(pt, {START}), {START})) FILTER (WHERE here) AS least_gap, max(timestamp - greatest(coalesce(pt, {START}), {START})) FILTER (WHERE here) AS most_gap, max(timestamp) FILTER (WHERE here) AS last,
    arg_max(value_raw, (timestamp, seq)) FILTER (WHERE NOT here) AS initial_value, arg_max(value_raw, (timestamp, seq)) AS final_value
  FROM k GROUP BY signal_id),
b AS (SELECT s.signal_id, signal_name, initial_value, final_value, coalesce(change_count, 0) AS change_count, coalesce(rising, 0) AS rising, coalesce(falling, 0) AS falling, least_gap, most_gap, {END + 1} - coalesce(last, {START}) AS tail FROM s LEFT JOIN a USING (signal_id)),
"""


@_query("edges", _TRACE + _SUMMARY + "z AS (SELECT 1) SELECT signal_id, rising, falling FROM b")
def edges(spark, sf_dir):
    return semantics.summary(_wave(spark, sf_dir), _signals(spark), START, END).select("signal_id", "rising", "falling")


@_query("hold", _TRACE + _SUMMARY + f"z AS (SELECT 1) SELECT signal_id, least(coalesce(least_gap, tail), tail) AS hold_min, greatest(coalesce(most_gap, tail), tail) AS hold_max, round(CAST({END - START + 1} AS DOUBLE) / (change_count + 1), 2) AS hold_avg FROM b")
def hold(spark, sf_dir):
    return semantics.summary(_wave(spark, sf_dir), _signals(spark), START, END).select("signal_id", "hold_min", "hold_max", "hold_avg")


@_query("change_rate", _TRACE + _SUMMARY + f"z AS (SELECT 1) SELECT signal_id, round(CAST(change_count AS DOUBLE) / {END - START + 1}, 12) AS change_rate, change_count = 0 AS is_stable FROM b")
def change_rate(spark, sf_dir):
    return semantics.summary(_wave(spark, sf_dir), _signals(spark), START, END).select("signal_id", "change_rate", "is_stable")


@_query("describe", _TRACE + _SUMMARY + """
z AS (SELECT 1)
SELECT signal_id, signal_name, 'Signal ' || signal_name || CASE WHEN change_count = 0 THEN ' remained constant at ' || coalesce(initial_value, 'None') || '.' WHEN change_count > 50 THEN ' toggled heavily (' || change_count || ' changes).' ELSE ' changed ' || change_count || ' times.' END AS description
FROM b""")  # fmt: skip
def describe(spark, sf_dir):
    return semantics.describe(semantics.summary(_wave(spark, sf_dir), _signals(spark), START, END), _signals(spark))


_PAIRS = "pr AS (SELECT 'top.core' || c || '.io' AS pair, c * 5 AS a_id, c * 5 + 1 AS b_id FROM range(4) t(c)),"
_STATES = "count(*) AS n, {0} FROM jt GROUP BY pair"


def _state(a: int, b: int) -> str:
    return f"CAST(coalesce(sum(t_end - t_start) FILTER (WHERE a_bit = {a} AND b_bit = {b}), 0) AS BIGINT)"


_JOINT_SUMS = f"js AS (SELECT pair, {_state(1, 1)} AS both_high, {_state(0, 0)} AS both_low, {_state(1, 0)} AS a_only, {_state(0, 1)} AS b_only FROM jt GROUP BY pair),"
_SPAN = END - START + 1


@_query("handshake", _TRACE + _PAIRS + _joint("pr", "jt") + _JOINT_SUMS + f"""
z AS (SELECT 1)
SELECT pair AS prefix, both_high, a_only AS valid_only, b_only AS ready_only, both_low, {_SPAN} - both_high - both_low - a_only - b_only AS unknown, CAST({_SPAN} AS BIGINT) AS total_time,
  round(CAST(both_high AS DOUBLE) / {_SPAN}, 9) AS throughput_ratio, round(CAST(a_only AS DOUBLE) / {_SPAN}, 9) AS stall_ratio, round(CAST(b_only AS DOUBLE) / {_SPAN}, 9) AS ready_wait_ratio
FROM js""")  # fmt: skip
def handshake(spark, sf_dir):
    return semantics.handshake(_wave(spark, sf_dir), _signals(spark), START, END)


@_query("coactivity", _TRACE + "pr AS (SELECT a.i || '/' || b.i AS pair, a.i AS a_id, b.i AS b_id FROM range(8) a(i), range(8) b(i) WHERE a.i < b.i)," + _joint("pr", "jt") + _JOINT_SUMS + f"""
z AS (SELECT 1)
SELECT a_id, b_id, both_high, both_low, a_only, b_only, {_SPAN} - both_high - both_low - a_only - b_only AS unknown, round(CAST(both_high + both_low AS DOUBLE) / {_SPAN}, 9) AS same_state_ratio FROM pr JOIN js USING (pair)""")  # fmt: skip
def coactivity(spark, sf_dir):
    return semantics.coactivity(_wave(spark, sf_dir), spark.range(8).select(F.col("id").alias("pos"), F.col("id").alias("signal_id")), START, END, SLICE)


@_query("handshake_names", """
SELECT * FROM (VALUES ('a.io_valid', 'a.io', 'valid'), ('a__valid', 'a_', 'valid'), ('xREADY', 'x', 'ready'), ('.ready', '', 'ready')) t(signal_name, prefix, kind)""")  # fmt: skip
def handshake_names(spark, sf_dir):
    from ..functions.values import handshake_kind, handshake_prefix

    n = F.col("signal_name")
    rows = spark.createDataFrame([("a.io_valid",), ("a__valid",), ("xREADY",), (".ready",), ("valid",), ("data",)], "signal_name string")
    return rows.select(n, handshake_prefix(n).alias("prefix"), handshake_kind(n).alias("kind")).where("kind is not null")


@_query("classify", _TRACE + "z AS (SELECT 1) SELECT signal_id, CASE WHEN length(arg_min(value_raw, (timestamp, seq))) > 1 THEN 'bus' ELSE 'logic' END AS signal_type FROM w GROUP BY signal_id")
def classify(spark, sf_dir):
    return semantics.classify(_wave(spark, sf_dir))


@_query("activity_ratio", _TRACE + _SEGMENTS + _BITS + f"""
d AS (SELECT s.signal_id, CAST(coalesce(sum(dur) FILTER (WHERE b = 1), 0) AS BIGINT) AS high_time, CAST(coalesce(sum(dur) FILTER (WHERE b = 0), 0) AS BIGINT) AS low_time FROM s LEFT JOIN segb USING (signal_id) GROUP BY s.signal_id)
SELECT *, {_SPAN} - high_time - low_time AS unknown_time, round(CAST(high_time AS DOUBLE) / {_SPAN}, 9) AS activity_ratio FROM d""")  # fmt: skip
def activity_ratio(spark, sf_dir):
    return semantics.duty(_wave(spark, sf_dir), _signals(spark), START, END, SLICE)


@_query("ivl_high", _TRACE + _SEGMENTS + _BITS + "z AS (SELECT 1) SELECT signal_id, t_start, t_end FROM segb WHERE b = 1")
def ivl_high(spark, sf_dir):
    return semantics.high_intervals(_wave(spark, sf_dir), START, END)


@_query("ivl_both_high", _TRACE + _PAIRS + _joint("pr", "jt") + "z AS (SELECT 1) SELECT pair, t_start, t_end FROM jt WHERE a_bit = 1 AND b_bit = 1")
def ivl_both_high(spark, sf_dir):
    return semantics.both_high_intervals(_wave(spark, sf_dir), semantics.handshake_pairs(_signals(spark)), START, END)


_IVL_SUMMARY = "SELECT s.signal_id, count(dur) AS n, CAST(coalesce(sum(dur), 0) AS BIGINT) AS total, min(t_start) AS first, max(t_end) - 1 AS last, coalesce(max(dur), 0) AS longest, coalesce(round(CAST(sum(dur) AS DOUBLE) / count(dur), 2), 0) AS average FROM s LEFT JOIN (SELECT * FROM segb WHERE b = {0}) USING (signal_id) GROUP BY s.signal_id"


@_query("ivl_summary", _TRACE + _SEGMENTS + _BITS + "z AS (SELECT 1) " + _IVL_SUMMARY.format(1))
def ivl_summary(spark, sf_dir):
    return semantics.interval_summary(_signals(spark), semantics.high_intervals(_wave(spark, sf_dir), START, END), "signal_id")


@_query("utilization", _TRACE + _SEGMENTS + _BITS + f"z AS (SELECT 1) SELECT signal_id, round(CAST(sum(dur) AS DOUBLE) / {_SPAN}, 9) AS utilization FROM segb WHERE b = 1 AND signal_id % 5 = 2 GROUP BY signal_id")
def utilization(spark, sf_dir):
    busy = semantics.high_intervals(_wave(spark, sf_dir).where("signal_id % 5 = 2"), START, END)
    return busy.groupBy("signal_id").agg(ratio(F.sum(F.col("t_end") - F.col("t_start")), F.lit(_SPAN)).alias("utilization"))


@_query("idle_gaps", _TRACE + _SEGMENTS + _BITS + "r AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY dur DESC, t_start) AS place, t_start, t_end, dur AS duration FROM segb WHERE b = 0) SELECT * FROM r WHERE place <= 5")
def idle_gaps(spark, sf_dir):
    return semantics.longest(semantics.low_intervals(_wave(spark, sf_dir), START, END), "signal_id", 5)


@_query("health_check", _TRACE + _SEGMENTS + _BITS + _SUMMARY + f"""
h AS (SELECT b.*, coalesce((SELECT sum(dur) FROM segb x WHERE x.signal_id = b.signal_id AND x.b = 1), 0) AS high FROM b)
SELECT count(*) FILTER (WHERE ends_with(signal_name, 'clock') AND change_count >= 100) AS live_clocks, count(*) FILTER (WHERE ends_with(signal_name, 'clock')) AS clocks, CAST(0 AS BIGINT) AS active_resets, count(*) FILTER (WHERE contains(signal_name, 'busy') AND high > 0) AS active_busy
FROM h""")  # fmt: skip
def health_check(spark, sf_dir):
    return semantics.health_check(_wave(spark, sf_dir), _signals(spark), START, END)


# Cycles

_EDGES = "p AS (SELECT *, lag(value_raw) " + _W + " AS pv FROM w WHERE signal_id % 5 = 3), e AS (SELECT signal_id, row_number() " + _W + " - 1 AS cycle, timestamp FROM p WHERE value_raw = '{0}' AND pv IS DISTINCT FROM '{0}'),"


def _clocks(spark, sf_dir):
    return _wave(spark, sf_dir).where("signal_id % 5 = 3")


@_query("cycle_table_rising", _TRACE + _EDGES.format(1) + "z AS (SELECT 1) SELECT * FROM e")
def cycle_table_rising(spark, sf_dir):
    return cycles.cycle_table(_clocks(spark, sf_dir), slice_ticks=SLICE)


@_query("cycle_table_falling", _TRACE + _EDGES.format(0) + "z AS (SELECT 1) SELECT * FROM e")
def cycle_table_falling(spark, sf_dir):
    return cycles.cycle_table(_clocks(spark, sf_dir), "falling")


_CYCLES = """
c AS (
  SELECT signal_id, max(timestamp) FILTER (WHERE cycle = 3) AS start_time, CASE WHEN max(cycle) FILTER (WHERE cycle = 8) IS NULL THEN (SELECT max(timestamp) FROM w) ELSE greatest(max(timestamp) FILTER (WHERE cycle = 3), max(timestamp) FILTER (WHERE cycle = 8) - 1) END AS end_time
  FROM e GROUP BY signal_id HAVING start_time IS NOT NULL)
"""


@_query("cycle_range", _TRACE + _EDGES.format(1) + _CYCLES + "SELECT * FROM c")
def cycle_range(spark, sf_dir):
    return cycles.cycle_ranges(cycles.cycle_table(_clocks(spark, sf_dir)), 3, 7, lookups.bounds(_wave(spark, sf_dir)))


@_query("query_cycles", _TRACE + _EDGES.format(1) + _CYCLES + "SELECT c.signal_id AS clock_id, w.signal_id, w.timestamp, w.value_raw FROM w, c WHERE timestamp BETWEEN start_time AND end_time AND w.signal_id // 5 = c.signal_id // 5")
def query_cycles(spark, sf_dir):
    """Changes of every signal of a clock's module within cycles 3 to 7 of that clock."""
    wave = _wave(spark, sf_dir)
    ranges = cycle_range(spark, sf_dir).withColumnRenamed("signal_id", "clock_id")
    same = F.floor(F.col("signal_id") / 5) == F.floor(F.col("clock_id") / 5)
    return wave.join(ranges, same & F.col("timestamp").between(F.col("start_time"), F.col("end_time"))).select("clock_id", "signal_id", "timestamp", "value_raw")


@_query("probe_cycles", _TRACE + _EDGES.format(1) + _CYCLES + "SELECT w.signal_id, count(*) AS change_count, min(timestamp) AS first_change, max(timestamp) AS last_change FROM w, c WHERE timestamp BETWEEN start_time AND end_time AND w.signal_id // 5 = c.signal_id // 5 GROUP BY w.signal_id")
def probe_cycles(spark, sf_dir):
    return query_cycles(spark, sf_dir).groupBy("signal_id").agg(F.count(F.lit(1)).alias("change_count"), F.min("timestamp").alias("first_change"), F.max("timestamp").alias("last_change"))


@_query("cycle_samples", _TRACE + _EDGES.format(1) + """
marks AS (
  SELECT signal_id, timestamp AS time, 0 AS mark, seq, value_raw, CAST(NULL AS BIGINT) AS clock_id, CAST(NULL AS BIGINT) AS cycle FROM w
  UNION ALL SELECT s.signal_id, e.timestamp, 1, 0, NULL, e.signal_id, e.cycle FROM e, (SELECT DISTINCT signal_id FROM w) s),
q AS (SELECT *, last_value(value_raw IGNORE NULLS) OVER (PARTITION BY signal_id ORDER BY time, mark, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM marks)
SELECT clock_id, cycle, signal_id, held AS value_raw FROM q WHERE mark = 1""")  # fmt: skip
def cycle_samples(spark, sf_dir):
    """Every signal at every cycle of every clock."""
    return cycles.samples(_wave(spark, sf_dir), cycles.cycle_table(_clocks(spark, sf_dir), slice_ticks=SLICE))


# The VCD source


def _written(spark, wave, signals) -> str:
    """The trace as a VCD file in the folder that all executors share; the path of the file."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tracequery-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    folder = f"{folder.rstrip('/')}/vcd-{uuid.uuid4().hex}"
    change = F.concat(F.lit("#"), F.col("timestamp").cast("string"), F.lit("\ns"), F.col("value_raw"), F.lit(" c"), F.col("signal_id").cast("string"))
    wave.orderBy("timestamp", "seq").select(change).write.text(f"{folder}/parts")
    names = signals.orderBy("signal_id").collect()
    system, inner = vcd.open_path(folder)
    with system.open_output_stream(f"{inner}/trace.vcd") as out:
        out.write("".join(["$timescale 1us $end\n", *(f"$var string 1 c{r.signal_id} {r.signal_name} $end\n" for r in names), "$enddefinitions $end\n"]).encode())
        for part in sorted(f.path for f in system.get_file_info(FileSelector(f"{inner}/parts")) if f.base_name.startswith("part-")):
            with system.open_input_stream(part) as more:
                while piece := more.read(1 << 20):
                    out.write(piece)
    return f"{folder}/trace.vcd"


@_query("vcd_round_trip", _TRACE + f"z AS (SELECT 1) SELECT signal_name, row_number() {_W} - 1 AS place, timestamp, value_raw FROM w")
def vcd_round_trip(spark, sf_dir):
    """The event trace, written as a VCD file and read by the source in several ranges."""
    path = _written(spark, _wave(spark, sf_dir), _signals(spark))
    vcd.register(spark)
    read = spark.read.format("vcd").option("path", path).option("shards", 5)
    place = (F.row_number().over(steps.by_signal()) - 1).cast("long")
    found = read.load().withColumn("place", place)
    known = read.option("table", "signals").load().select("signal_id", "signal_name")
    return found.join(F.broadcast(known), "signal_id").select("signal_name", "place", "timestamp", "value_raw")


# Diagnostics

_AT_T = f"v AS (SELECT signal_id, arg_max(value_raw, (timestamp, seq)) AS value FROM w WHERE timestamp <= {AT} GROUP BY signal_id), n AS (SELECT signal_name, regexp_replace(signal_name, '\\.[^.]*$', '') AS module, regexp_extract(signal_name, '[^.]*$') AS leaf, value FROM s JOIN v USING (signal_id)),"


@_query("busy_tree", _TRACE + _AT_T + "z AS (SELECT 1) SELECT signal_name, value, value = '1' AS is_busy, CAST(2 AS BIGINT) AS depth FROM n WHERE leaf = 'io_busy'")
def busy_tree(spark, sf_dir):
    return diagnose.busy_tree(_wave(spark, sf_dir), _signals(spark), "top", AT)


@_query("deadlock", _TRACE + _AT_T + """
i AS (
  SELECT a.module, a.leaf || '=1 but ' || b.leaf || '=0' AS issue FROM n a JOIN n b ON a.module = b.module AND b.leaf = replace(a.leaf, 'valid', 'ready') WHERE contains(a.leaf, 'valid') AND a.value = '1' AND b.value = '0'
  UNION ALL SELECT module, leaf || '=1 (busy)' FROM n WHERE contains(leaf, 'busy') AND value = '1')
SELECT module, count(*) AS issue_count, string_agg(issue, '; ' ORDER BY issue) AS issues FROM i GROUP BY module""")  # fmt: skip
def deadlock(spark, sf_dir):
    return diagnose.find_deadlock(_wave(spark, sf_dir), _signals(spark), AT)


@_query("trace_dependency", _TRACE + _AT_T + """
l AS (
  SELECT *, CASE WHEN contains(signal_name, 'top.core1') THEN 0 ELSE 1 END AS level, CASE WHEN contains(leaf, 'ready') THEN 0 WHEN contains(leaf, 'valid') THEN 1 WHEN contains(leaf, 'busy') THEN 2 END AS word FROM n),
r AS (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY word, signal_name) AS place, value = '1' AND contains(leaf, 'busy') OR value = '0' AND contains(leaf, 'ready') AS blocking
  FROM l WHERE word IS NOT NULL AND signal_name <> 'top.core1.io_valid')
SELECT CAST(0 AS BIGINT) AS depth, signal_name, value, 'Starting point' AS note FROM n WHERE signal_name = 'top.core1.io_valid'
UNION ALL SELECT CAST(level + 1 AS BIGINT), signal_name, value, CASE WHEN blocking THEN 'BLOCKING' ELSE '' END FROM r WHERE place <= 10""")  # fmt: skip
def trace_dependency(spark, sf_dir):
    return diagnose.trace_dependency(_wave(spark, sf_dir), _signals(spark), "top.core1.io_valid", AT)


def _trace_sql() -> str:
    """Metrics of the two halves of the event trace by time."""
    bit = "CASE substr(trim({0}), 1, 1) WHEN '0' THEN 0 WHEN '1' THEN 1 END"
    summary = "count(t_start) AS n, CAST(coalesce(sum(t_end - t_start), 0) AS BIGINT) AS total, min(t_start) AS first, max(t_end) - 1 AS last, coalesce(max(t_end - t_start), 0) AS longest, coalesce(round(CAST(sum(t_end - t_start) AS DOUBLE) / count(t_start), 2), 0) AS average"
    gap = "SELECT trace, '{0}', 0, {1}, NULL, NULL, NULL, NULL FROM lim"
    return _TRACE + f"""
x AS (SELECT *, CASE WHEN timestamp < {AT} THEN 'early' ELSE 'late' END AS trace FROM w),
m AS (SELECT trace, min(timestamp) AS lo, max(timestamp) AS hi FROM x GROUP BY trace),
hv AS (
  SELECT trace, 'busy' AS metric, timestamp AS t_start, coalesce(lead(timestamp) OVER (PARTITION BY trace, signal_id ORDER BY timestamp, seq), hi + 1) AS t_end, {bit.format('value_raw')} AS b
  FROM x JOIN m USING (trace) WHERE signal_id = 2),
pt AS (
  SELECT trace, metric, timestamp, seq, hi, CASE WHEN signal_id % 5 = 0 THEN value_raw END AS va, CASE WHEN signal_id % 5 = 1 THEN value_raw END AS vb
  FROM x JOIN m USING (trace) JOIN (VALUES ('core0', 0), ('core0', 1), ('core1', 5), ('core1', 6)) k(metric, signal_id) USING (signal_id)),
jv AS (
  SELECT trace, metric, timestamp AS t_start, coalesce(lead(timestamp) OVER o, hi + 1) AS t_end, {bit.format('last_value(va IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS a_bit,
    {bit.format('last_value(vb IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS b_bit
  FROM pt WINDOW o AS (PARTITION BY trace, metric ORDER BY timestamp, seq)),
iv AS (SELECT trace, metric, t_start, t_end FROM hv WHERE b = 1 AND t_end > t_start UNION ALL SELECT trace, metric, t_start, t_end FROM jv WHERE a_bit = 1 AND b_bit = 1 AND t_end > t_start),
keys AS (SELECT * FROM (VALUES ('early'), ('late')) a(trace), (VALUES ('busy'), ('core0'), ('core1')) b(metric)),
base AS (SELECT trace, metric, {summary} FROM keys LEFT JOIN iv USING (trace, metric) GROUP BY trace, metric),
lim AS (
  SELECT trace, max(first) FILTER (WHERE metric = 'busy') AS b0, max(last) FILTER (WHERE metric = 'busy') AS b1, max(first) FILTER (WHERE metric = 'core0') AS c0, max(last) FILTER (WHERE metric = 'core0') AS c1, max(last) FILTER (WHERE metric = 'core1') AS r1
  FROM base GROUP BY trace),
cut AS (
  SELECT trace, metric || ' in busy window' AS metric, greatest(t_start, b0) AS t_start, least(t_end, b1 + 1) AS t_end FROM iv JOIN lim USING (trace) WHERE metric <> 'busy' AND t_start <= b1 AND t_end > b0
  UNION ALL SELECT trace, 'busy in command window', greatest(t_start, c0), least(t_end, c1 + 1) FROM iv JOIN lim USING (trace) WHERE metric = 'busy' AND t_start <= c1 AND t_end > c0),
keys2 AS (SELECT * FROM (VALUES ('early'), ('late')) a(trace), (VALUES ('core0 in busy window'), ('core1 in busy window'), ('busy in command window')) b(metric))
SELECT * FROM base UNION ALL SELECT trace, metric, {summary} FROM keys2 LEFT JOIN cut USING (trace, metric) GROUP BY trace, metric
UNION ALL {gap.format('command to busy', 'b0 - c0')} UNION ALL {gap.format('busy to response', 'r1 - b1')} UNION ALL {gap.format('busy span', 'b1 - b0 + 1')}"""


@_query("compare_traces", _trace_sql())
def compare_traces(spark, sf_dir):
    wave, signals = _wave(spark, sf_dir), _signals(spark)
    halves = {"early": (wave.where(F.col("timestamp") < AT), signals), "late": (wave.where(F.col("timestamp") >= AT), signals)}
    return traces.metrics(halves, "top.core0.io_busy", HANDSHAKES, "core0", "core1")
