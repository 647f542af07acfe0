"""Command line: ``python -m tracequery.cli COMMAND FILE ...``, or ``FILE ... --signals a,b`` to inspect files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import surfaces
from .api import Engine
from .plans import render
from .schema import TraceError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracequery")
    p.add_argument("--format", choices=("json", "text"), default="json")
    p.add_argument("--cache", help="folder for ingested traces; beside the recording by default")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, ranged: bool = False, **options):
        c = sub.add_parser(name)
        c.add_argument("file")
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            c.add_argument(flag, action="store_true") if v is bool else c.add_argument(flag, type=v)
        if ranged:
            c.add_argument("--start", "--from", type=int, dest="start")
            c.add_argument("--end", "--to", type=int, dest="end")

    serve = sub.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    sub.add_parser("tools")
    cycle = {"clock": str, "start_cycle": int, "end_cycle": int, "edge": str}
    add("load")
    add("signals", pattern=str, limit=int)
    add("tree", max_depth=int)
    add("hierarchy", pattern=str, depth=int)
    add("query", "signal", ranged=True, max_changes=int)
    add("query-cycles", "signal", **cycle)
    add("probe", "signals", ranged=True, include_changes=bool, max_changes=int, max_unique=int, **cycle)
    add("inspect", "signals", ranged=True, max_changes=int, max_unique=int, **cycle)
    add("analyze", "signal", ranged=True)
    add("find-stall", "signal", ranged=True, min_duration=int, max_results=int)
    add("find-event", "signal", "value", ranged=True, edge=str, max_results=int)
    add("last-activity", pattern=str, sort_by=str, limit=int)
    add("compare-points", "signals", "time_a", "time_b")
    add("busy-tree", "root", "time")
    add("find-deadlock", "time", module=str)
    add("trace-dependency", "signal", "time", direction=str, max_depth=int)
    return p


def default_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracequery")
    p.add_argument("files", nargs="+")
    p.add_argument("--signals", required=True)
    p.add_argument("--start", "--from", type=int, dest="start")
    p.add_argument("--end", "--to", type=int, dest="end")
    p.add_argument("--format", choices=("json", "text"), default="json")
    p.add_argument("--cache", help="folder for ingested traces; beside the recording by default")
    return p


def wants_default(argv: list[str]) -> bool:
    """Whether the arguments name files and --signals rather than a command."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    return any(a.split("=")[0] == "--signals" for a in argv) and not any(a in commands for a in argv[:5])


def run(engine: Engine, args: argparse.Namespace) -> dict:
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "file", "format", "cache")}
    for k in ("time", "time_a", "time_b"):
        if k in given:
            given[k] = int(given[k])
    status = engine.ensure(args.file)
    if args.command == "load":
        return status
    if "signals" in given and args.command != "find-deadlock":
        given["wanted"] = given.pop("signals")
    return getattr(engine, args.command.replace("-", "_"))(**given)


def _inspect_files(engine: Engine, args: argparse.Namespace) -> int:
    results = {}
    try:
        for f in args.files:
            engine.ensure(f)
            results[f] = engine.inspect(args.signals, args.start, args.end)
    except TraceError as e:
        print(render.to_json({"error": str(e), "kind": type(e).__name__}), file=sys.stderr)
        return 1
    print(render.to_json(results) if args.format == "json" else render.to_text(results))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    default = wants_default(argv)
    args = (default_parser() if default else parser()).parse_args(argv)
    spark = spark or SparkSession.builder.appName("tracequery").getOrCreate()
    engine = Engine(spark, args.cache)
    if default:
        return _inspect_files(engine, args)
    if args.command == "serve":
        surfaces.http_server(engine, args.host, args.port).serve_forever()
    if args.command == "tools":
        surfaces.serve_tools(engine)
        return 0
    try:
        result = run(engine, args)
    except TraceError as e:
        print(render.to_json({"error": str(e), "kind": type(e).__name__}), file=sys.stderr)
        return 1
    print(render.to_json(result) if args.format == "json" else render.to_text(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
