"""The VCD source, ingestion, catalog, façade, command line and live stalls."""

import json
import socket

import pytest
from pyspark.sql import functions as F

from tracequery import cli
from tracequery.api import Engine
from tracequery.schema import InvalidRangeError, LoadError, NotLoadedError, SignalNotFoundError
from tracequery.sources import vcd

MULTI = """$date
  Dec 20, 2025
$end
$version
  Some Writer
$end
$timescale
  1ns
$end
$scope module top $end
$var wire 1 ! clk $end
$var wire 8 " data $end
$upscope $end
$enddefinitions $end
#0
$dumpvars
0!
b00000000 "
$end
#5
1!
#10
0!
b11111111 "
#15
1!
#20
0!
"""

SINGLE = MULTI.replace("\n  Dec 20, 2025\n", " today ").replace("\n  Some Writer\n", " 1.0 ").replace("\n  1ns\n", " 1ns ")

TRICKY = (
    "$timescale 10 us $end\n$scope module a $end $var wire 1 # h $end\n$var wire 4 $d bus [3:0] $end\n$var real 64 b r $end\n$var string 1 rr s $end\n$scope module in $end\n$var wire 1 # same $end\n$upscope $end\n"
    "$upscope $end\n$enddefinitions $end\n1#\n$comment 0#\n1# $end\n#3\r\n  0#\r\nb10X1 $d\r\nr1.5 b\r\nsIDLE rr\r\nXnothing\nZ#\n#7\np0 6 0 #\nb1 #"
)


def write(tmp_path, text, name="t.vcd"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def wave(spark, path, shards=1):
    vcd.register(spark)
    return [(r.timestamp, r.signal_id, r.value_raw, r.value_kind, r.value_scalar, r.value_real) for r in spark.read.format("vcd").option("path", path).option("shards", shards).load().orderBy("seq").collect()]


@pytest.mark.parametrize("text", [MULTI, SINGLE])
def test_header_styles_give_the_same_trace(spark, tmp_path, text):
    path = write(tmp_path, text)
    head = vcd.read_header(path)
    assert [(n["signal_id"], n["signal_name"], n["size"]) for n in head.names] == [(0, "top.clk", 1), (1, "top.data", 8)]
    assert head.timescale == "1ns" and vcd.timescale_seconds(head.timescale) == 1e-9
    assert wave(spark, path) == [
        (0, 0, "0", 0, 0, None), (0, 1, "00000000", 1, None, None), (5, 0, "1", 0, 1, None), (10, 0, "0", 0, 0, None), (10, 1, "11111111", 1, None, None), (15, 0, "1", 0, 1, None), (20, 0, "0", 0, 0, None),
    ]


def test_tricky_codes_kinds_and_lines(spark, tmp_path):
    path = write(tmp_path, TRICKY)
    head = vcd.read_header(path)
    assert [(n["signal_id"], n["signal_name"], n["is_alias"]) for n in head.names] == [(0, "a.h", False), (1, "a.bus[3:0]", False), (2, "a.r", False), (3, "a.s", False), (0, "a.in.same", True)]
    assert vcd.timescale_seconds(head.timescale) == pytest.approx(1e-5)
    assert wave(spark, path) == [
        (0, 0, "1", 0, 1, None), (3, 0, "0", 0, 0, None), (3, 1, "10X1", 1, None, None), (3, 2, "1.5", 2, None, 1.5), (3, 3, "IDLE", 3, None, None), (3, 0, "Z", 0, 3, None),
        (7, 0, "p0 6 0", 1, None, None), (7, 0, "1", 1, None, None),
    ]


@pytest.mark.parametrize("shards", [2, 3, 5, 8])
def test_shards_give_the_same_rows(spark, tmp_path, shards):
    body = "".join(f"#{t}\n{t % 2}!\nb{t:b} \"\n" for t in range(400))
    path = write(tmp_path, MULTI.split("#0")[0] + body)
    assert wave(spark, path, shards) == wave(spark, path, 1)
    assert len(vcd.cuts(path, vcd.read_header(path).body, shards)) == shards


def test_small_chunks_carry_lines_and_time(spark, tmp_path, monkeypatch):
    path = write(tmp_path, MULTI)
    whole = wave(spark, path)
    monkeypatch.setattr(vcd, "CHUNK", 7)
    reader = vcd._WaveReader(path, 1, 1 << 20)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["timestamp"], r["signal_id"], r["value_raw"]) for r in got] == [r[:3] for r in whole]


def test_errors(spark, tmp_path):
    with pytest.raises(LoadError):
        vcd.read_header(str(tmp_path / "none.vcd"))
    with pytest.raises(LoadError):
        vcd.read_header(write(tmp_path, "$date x $end\n"))
    head = MULTI.split("#0")[0]
    with pytest.raises(Exception, match="beyond"):
        wave(spark, write(tmp_path, head + f"#{1 << 63}\n1!\n"))
    with pytest.raises(LoadError):
        Engine(spark, str(tmp_path / "c")).load(str(tmp_path / "x.fst"))
    with pytest.raises(LoadError):
        Engine(spark, str(tmp_path / "c")).load(write(tmp_path, MULTI, "no.fst"))


def test_engine(spark, tmp_path):
    path = write(tmp_path, MULTI)
    e = Engine(spark, str(tmp_path / "cache"))
    with pytest.raises(NotLoadedError):
        e.signals()
    assert e.status()["status"] == "no_file_loaded"
    assert e.load(path) == {"status": "ok", "loaded_file": path, "signal_count": 2, "start_time": 0, "end_time": 20}
    before = e.trace.cache
    assert e.load(path) and e.trace.cache == before
    assert e.signals()["signals"] == ["top.clk", "top.data"]
    q = e.query("clk", 0, 20)
    assert q["resolved_signal"] == "top.clk" and q["initial_value"] is None and [c[0] for c in q["changes"]] == [0, 5, 10, 15, 20]
    assert e.query_cycles("data", "clk", 0, 0)["initial_value"] == "00000000"
    p = e.probe(["clk", "top.clk", "data"], include_changes=True)
    assert [(s["signal"], s["aliases"], s["change_count"]) for s in p["signals"]] == [("top.clk", ["top.clk"], 5), ("top.data", [], 2)]
    i = e.inspect("top.*", 0, 20)
    assert i["signals"][0]["analysis"]["rising"] == 2 and i["relations"][0]["type"] == "coactivity"
    assert e.analyze("clk", 0, 20)["toggle_count"] == 5 and "changed" in e.analyze("clk", 0, 20)["description"]
    assert [(s["start_time"], s["duration"]) for s in e.find_stall("data", 10, 0, 20)["stall_periods"]] == [(0, 10), (10, 10)]
    assert [x["time"] for x in e.find_event("clk", "1", edge="rising")["events"]] == [5, 15]
    assert e.last_activity()["activities"][0]["signal"] == "top.clk"
    c = e.compare_points(["clk", "data", "nix"], 5, 10)
    assert c["changed_count"] == 2 and "error" in c["comparisons"][-1]
    assert e.busy_tree("top", 5)["busy_count"] == 0 and e.find_deadlock(5)["potential_deadlocks"] == 0
    assert e.trace_dependency("clk", 5)["details"][0]["note"] == "Starting point"
    assert e.tree()["tree"].splitlines()[0] == "top (2 signals)" and e.hierarchy()["modules"][0]["module"] == "top"
    assert e.sql("select count(*) from wave").first()[0] == 7
    with pytest.raises(SignalNotFoundError):
        e.query("nothing_like_it", 0, 1)
    with pytest.raises(InvalidRangeError):
        e.probe(["clk"], 5, 4)
    with pytest.raises(InvalidRangeError):
        e.probe(["clk"], clock="clk")
    assert e.unload()["previous_file"] == path and e.unload()["status"] == "no_file_loaded"


def test_a_changed_file_is_read_again(spark, tmp_path):
    path = write(tmp_path, MULTI)
    e = Engine(spark, str(tmp_path / "cache"))
    e.load(path)
    write(tmp_path, MULTI + "#30\n1!\n")
    assert e.load(path)["end_time"] == 30


def test_names_are_looked_up_anew_after_a_reload(spark, tmp_path):
    path = write(tmp_path, MULTI)
    engine = Engine(spark, str(tmp_path / "cache"))
    engine.load(path)
    assert len(engine.query("clk", 0, 20)["changes"]) == 5
    swapped = MULTI.replace('$var wire 1 ! clk $end\n$var wire 8 " data $end', '$var wire 8 " data $end\n$var wire 1 ! clk $end  ')
    write(tmp_path, swapped)
    engine.load(path)
    got = engine.query("clk", 0, 20)
    assert got["resolved_signal"] == "top.clk" and [v for _, v in got["changes"]] == ["0", "1", "0", "1", "0"]


def test_limits_errors_and_totals(spark, tmp_path):
    engine = Engine(spark)
    engine.load(write(tmp_path, MULTI))
    # Without a folder the cache lies beside the recording.
    assert (tmp_path / ".tracequery").is_dir()
    got = engine.query("clk", 1, 20, max_changes=2)
    assert got["initial_value"] == "0" and got["changes"] == [(5, "1"), (10, "0")] and got["truncated"] and got["total_changes"] == 4
    got = engine.query("clk", 1, 20, max_changes=4)
    assert len(got["changes"]) == 4 and "truncated" not in got
    got = engine.compare_points(["clk", "nix_nix", "data"], 5, 10)
    assert [r.get("resolved") for r in got["comparisons"]] == ["top.clk", "top.data", None] and got["changed_count"] == 2 and "nix_nix" in got["comparisons"][2]["error"]
    assert engine.find_stall("data", 1, max_results=1)["total_found"] == 2 and engine.last_activity(limit=1)["total_checked"] == 2


def test_deadlock_answers_say_what_was_looked_at(spark, tmp_path):
    text = "$scope module m $end\n$var wire 1 a io_valid $end\n$var wire 1 b io_ready $end\n$var wire 1 c io_busy $end\n$var wire 1 d other $end\n$upscope $end\n$enddefinitions $end\n#0\n1a\n0b\n0c\n1d\n"
    engine = Engine(spark, str(tmp_path / "cache"))
    engine.load(write(tmp_path, text))
    got = engine.find_deadlock(0)
    assert got["total_signals_checked"] == 3 and got["potential_deadlocks"] == 1 and got["note"]
    (one,) = got["candidates"]
    assert one["module"] == "m" and one["signals"] == {"io_valid": "1", "io_ready": "0", "io_busy": "0"}


def test_comments_may_hold_the_end_of_the_header(spark, tmp_path):
    text = MULTI.replace("$scope module top $end", "$comment not yet: $enddefinitions $end\n$scope module top $end")
    assert wave(spark, write(tmp_path, text)) == wave(spark, write(tmp_path, MULTI, "u.vcd"))
    long = MULTI.replace("$scope module top $end", f"$comment {'x ' * (1 << 20)} $end\n$scope module top $end")
    assert wave(spark, write(tmp_path, long, "v.vcd"), 3) == wave(spark, str(tmp_path / "u.vcd"))
    assert vcd.parse_header(b"$comment $enddefinitions $") is None


def test_reals_and_odd_codes(spark, tmp_path):
    head = "$var real 64 r1 a $end\n$var wire 1 xy b $end\n$var wire 1 y c $end\n$enddefinitions $end\n#1\n"
    got = wave(spark, write(tmp_path, head + "r1.5e3 r1\nr-inf r1\nrnan r1\nr1x r1\nr .5 r1\nb101xy\n"))
    reals = [r[5] for r in got if r[1] == 0]
    assert reals[:2] == [1500.0, float("-inf")] and reals[4] == 0.5 and all(v is None or v != v for v in reals[2:4])
    assert [(r[1], r[2]) for r in got if r[1] != 0] == [(1, "101")]


def test_ranges_by_signal_hold_the_same_changes(spark, tmp_path):
    path = write(tmp_path, MULTI)
    vcd.register(spark)
    read = spark.read.format("vcd").option("path", path).option("shards", 2)
    a, b = read.load(), read.option("by_signal", True).load()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    from itertools import groupby

    parts = [list(g) for _, g in groupby(b.withColumn("p", F.spark_partition_id()).collect(), key=lambda r: r.p)]
    assert len(parts) == 2 and all([(r.signal_id, r.seq) for r in p] == sorted((r.signal_id, r.seq) for r in p) for p in parts)


def test_http_client(spark, tmp_path):
    from tracequery import surfaces

    path, engine = write(tmp_path, MULTI), Engine(spark, str(tmp_path / "cache"))
    with socket.socket() as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    client = surfaces.Client(f"http://127.0.0.1:{port}", lambda: engine)
    try:
        assert client.ensure_loaded(path)["signal_count"] == 2 and client.call("load", file_path=path)["loaded_file"] == path
        assert {"top.clk", "top.data"} <= set(client.signals(limit=10)["signals"])
        assert len(client.query(signal="top.clk", start=0, end=20)["changes"]) >= 4
        assert client.analyze(signal="top.clk", start=0, end=20)["toggle_count"] > 0
        with pytest.raises(SignalNotFoundError):
            client.query(signal="nix_nix", start=0, end=1)
        # Another client finds the server that runs.
        again = surfaces.Client(f"http://127.0.0.1:{port}", lambda: pytest.fail("a second engine"))
        assert again.alive() and again._server is None
        with pytest.raises(AttributeError):
            client.nothing  # noqa: B018
    finally:
        client.close()


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path, MULTI)
    base = ["--cache", str(tmp_path / "cache")]
    assert cli.main([*base, "query", path, "clk", "--from", "0", "--to", "10"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["changes"]) == 3
    assert cli.main([*base, "--format", "text", "inspect", path, "clk,data"], spark) == 0
    assert "top.data" in capsys.readouterr().out
    assert cli.main([*base, "query", path, "nix"], spark) == 1
    assert cli.main([path, "--signals", "clk", "--from", "0", "--to", "9", *base], spark) == 0
    assert json.loads(capsys.readouterr().out)[path]["signals"][0]["change_count"] == 2
    assert cli.main([path, "--signals", "nix", *base], spark) == 1


def test_shard_count(monkeypatch):
    from tracequery.plans.catalog import shard_count

    assert [shard_count(n, 8) for n in (0, 1 << 10, 4 << 20, 64 << 20, 1 << 30)] == [1, 1, 4, 8, 32]
    monkeypatch.setenv("TRACEQUERY_MAX_SHARDS", "5")
    assert shard_count(1 << 30, 8) == 5
    monkeypatch.setenv("TRACEQUERY_SHARDS", "3")
    assert shard_count(1 << 30, 8) == 3


def test_live_stalls(spark, tmp_path):
    from tracequery.streaming.live import stalls

    src = str(tmp_path / "in")
    schema = "timestamp long, seq long, signal_id long, value_raw string"
    spark.createDataFrame([(0, 0, 1, "0"), (3, 1, 1, "1"), (20, 2, 1, "0"), (0, 3, 2, "1")], schema).coalesce(1).write.parquet(src)
    q = stalls(spark.readStream.schema(schema).parquet(src), 10).writeStream.format("memory").queryName("live_stalls").outputMode("append").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(19, 4, 1, "1"), (35, 5, 1, "1"), (4, 6, 2, "0")], schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("live_stalls").collect())
    finally:
        q.stop()
    assert got == [(1, 3, 20, 17, "1"), (1, 20, 35, 15, "0")]


def test_http_surface(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from tracequery.surfaces import http_server

    path = write(tmp_path, MULTI)
    server = http_server(Engine(spark, str(tmp_path / "cache")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(where, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + where, data)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health")[1]["status"] == "no_file_loaded"
        assert ask("/query", {"signal": "clk", "start": 0, "end": 9})[0] == 400
        assert ask("/load", {"path": path})[1]["signal_count"] == 2
        assert ask("/load", {"path": path + "x"})[0] == 500
        assert ask("/signals?pattern=clk&limit=5")[1]["signals"] == ["top.clk"]
        assert len(ask("/query", {"signal": "top.clk", "start": 0, "end": 20})[1]["changes"]) == 5
        assert ask("/query", {"signal": "nix_nix", "start": 0, "end": 20})[0] == 404
        assert ask("/query", {"signal": "top.clk"})[0] == 400
        assert ask("/query_cycles", {"signal": "data", "clock": "clk", "start_cycle": 1, "end_cycle": 1})[1]["start"] == 15
        assert ask("/probe", {"signals": ["clk"], "start": 0, "end": 20})[1]["signals"][0]["change_count"] == 5
        assert ask("/inspect", {"signals": ["clk"], "clock": "clk", "start_cycle": 0, "end_cycle": 0})[1]["end"] == 14
        assert ask("/analyze", {"signal": "clk", "start": 0, "end": 20})[1]["toggle_count"] == 5
        assert ask("/find_stall", {"signal": "data", "min_duration": 10})[1]["total_found"] == 2
        assert ask("/last_activity", {"pattern": "data"})[1]["activities"][0]["last_change_time"] == 10
        assert ask("/compare_points", {"signals": ["data"], "time_a": 5, "time_b": 10})[1]["changed_count"] == 1
        assert ask("/nothing")[0] == 404
        assert ask("/unload", {})[1]["previous_file"] == path
    finally:
        server.shutdown()


def test_tool_surface_and_client(spark, tmp_path):
    import io

    from tracequery import surfaces

    path = write(tmp_path, MULTI)
    engine = Engine(spark, str(tmp_path / "cache"))
    calls = [
        ("wave_load", {"path": path}), ("wave_status", {}), ("wave_signals", {}), ("wave_query", {"signal": "clk", "start": 0, "end": 20, "max_changes": 2}), ("wave_hierarchy", {}),
        ("wave_busy_tree", {"root": "top", "time": 5}), ("wave_find_deadlock", {"time": 5}), ("wave_trace_dependency", {"signal": "clk", "time": 5}), ("wave_find_event", {"signal": "clk", "value": "1", "edge": "rising"}),
        ("wave_inspect", {"signals": ["clk", "data"]}), ("wave_query", {"signal": "nix_nix", "start": 0, "end": 1}), ("wave_unload", {}), ("nix", {}),
    ]
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": a}}) for i, (n, a) in enumerate(calls)]
    lines = [json.dumps({"jsonrpc": "2.0", "id": "a", "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": "b", "method": "tools/list"}), *lines, "no json", json.dumps({"id": 9, "method": "x"})]
    sink = io.StringIO()
    surfaces.serve_tools(engine, lines, sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(out) == len(lines) - 1 and len(out[1]["result"]["tools"]) == 16
    got = [json.loads(x["result"]["content"][0]["text"]) for x in out[2:-2]]
    assert got[0]["signal_count"] == 2 and got[3]["truncated"] and got[3]["total_changes"] == 5 and [e["time"] for e in got[8]["events"]] == [5, 15]
    assert got[9]["signals"][0]["analysis"]["rising"] == 2 and "changes" not in got[9]["signals"][0]
    assert "error" in got[10] and got[11]["previous_file"] == path and "error" in got[12]
    assert out[-2]["error"]["code"] == -32700 and out[-1]["error"]["code"] == -32601
    w = surfaces.Waveform(engine, path)
    assert w.query("clk", 0, 20)["signal_id"] == 0 and surfaces.probe(engine, path, "clk")["signals"][0]["change_count"] == 5
    assert surfaces.inspect(engine, path, "clk")["relations"] == []


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def signed(n):
    out = b""
    while not -64 <= n < 64:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n & 0x7F])


def fst_file(pack, hierarchy, blocks):
    """An FST file: clk (1 bit), data (8 bits), clk's alias, a real, a string; blocks of (frame, times, chains by handle)."""
    import gzip
    import struct
    import zlib

    import pyarrow as pa

    u64 = lambda *n: struct.pack(f">{len(n)}Q", *n)
    block = lambda kind, body: bytes([kind]) + u64(len(body) + 8) + body
    lz4 = lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True)
    head = u64(0, 20) + struct.pack("<d", 2.7182818284590452354) + u64(0, 2, 5, 4, len(blocks)) + struct.pack("b", -9) + b"writer".ljust(128, b"\0") + b"today".ljust(119, b"\0") + bytes([0]) + u64(0)
    assert len(head) == 321
    var = lambda tag, name, size, alias=0: bytes([tag, 1]) + name + b"\0" + varint(size) + varint(alias)
    tree = bytes([254, 0]) + b"top\0\0" + var(16, b"clk", 1) + var(16, b"data", 8) + bytes([252, 0, 0]) + b"note\0" + varint(3) + bytes([253]) + bytes([254, 0]) + b"in\0\0" + var(16, b"clk2", 1, 1) + bytes([255]) + var(3, b"r", 64) + var(21, b"s", 0) + bytes([255])
    geometry = varint(1) + varint(8) + varint(0) + varint(0xFFFFFFFF)
    packed_geometry = zlib.compress(geometry)
    geometry = block(3, u64(len(geometry), 4) + (packed_geometry if len(packed_geometry) < len(geometry) else geometry))
    names = {"gz": block(4, u64(len(tree)) + gzip.compress(tree)), "lz4": block(6, u64(len(tree)) + lz4(tree))}
    once = lz4(tree)
    names["twice"] = block(7, u64(len(tree)) + varint(len(once)) + lz4(once))
    out = block(0, head)
    for frame, times, chains in blocks:
        waves, table, at = pack.encode(), b"", 0
        for chain in chains:
            if chain is None:
                table += varint(1 << 1)
                continue
            body = {"4": lz4, "Z": zlib.compress}[pack](chain) if len(chain) > 20 else chain
            table += signed((len(waves) - at) << 1 | 1)
            at = len(waves)
            waves += varint(len(chain) if len(chain) > 20 else 0) + body
        deltas = b"".join(varint(b - a) for a, b in zip([0, *times], times))
        z = zlib.compress(frame)
        body = u64(times[0], times[-1], 0) + varint(len(frame)) + varint(len(z)) + varint(4) + z + varint(4) + waves + table + u64(len(table)) + deltas + u64(len(deltas), len(deltas), len(times))
        out += block(8, body)
    return out + geometry + names[hierarchy]


@pytest.mark.parametrize("pack,hierarchy,wrapped", [("4", "gz", False), ("Z", "lz4", False), ("4", "twice", True)])
def test_fst(spark, tmp_path, pack, hierarchy, wrapped):
    import gzip
    import struct

    bit = lambda delta, value: varint(delta << 4 | "xzhuwl-?".index(value) << 1 | 1) if value in "xz" else varint(delta << 2 | int(value) << 1)
    clk = bit(0, "0") + b"".join(bit(1, str((i + 1) % 2)) for i in range(30))
    data = varint(0) + bytes([0]) + varint(2 << 1 | 1) + b"1010xz01"
    real = varint(1 << 1 | 1) + struct.pack("<d", 2.5)
    text = varint(3 << 1) + varint(4) + b"IDLE"
    frame = b"x" + b"x" * 8 + struct.pack("<d", 0.5)
    later = bit(0, "z")
    raw = fst_file(pack, hierarchy, [(frame, [5 * i for i in range(31)], [clk, data, real, text]), (frame, [200, 201], [later, None, None, None])])
    path = tmp_path / "t.fst"
    path.write_bytes(bytes([254]) + struct.pack(">QQ", 0, len(raw)) + gzip.compress(raw) if wrapped else raw)
    e = Engine(spark, str(tmp_path / "cache"))
    status = e.load(str(path))
    assert (status["signal_count"], status["start_time"], status["end_time"]) == (4, 0, 20)
    assert e.signals()["signals"] == ["top.clk", "top.data", "top.in.clk2", "top.r", "top.s"]
    q = e.query("top.clk", 0, 300)["changes"]
    assert q[0] == (0, "x") and q[1:32] == [(5 * i, str(i % 2)) for i in range(31)] and q[32] == (200, "z")
    assert e.query("top.in.clk2", 0, 300)["changes"] == q
    assert e.query("top.data", 0, 300)["changes"] == [(0, "xxxxxxxx"), (0, "00000000"), (10, "1010xz01")]
    assert e.query("top.r", 0, 300)["changes"] == [(0, "0.5"), (5, "2.5")] and e.query("top.s", 0, 300)["changes"] == [(15, "IDLE")]
    rows = {(r.signal_id, r.value_kind) for r in e.trace.wave.collect()}
    assert rows == {(0, 0), (1, 1), (2, 2), (3, 3)}
    info = e.trace.info.first()
    assert (info.source, info.version, info.date, info.timescale_exponent, info.max_handle) == ("fst", "writer", "today", -9, 4)
