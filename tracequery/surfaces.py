"""The engine by HTTP, by tool calls over standard input, and as a client object.

All three are thin: a table of operations names the engine's method, the
arguments it takes and their defaults, which differ between surfaces.
"""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlencode, urlsplit
from urllib.request import Request, urlopen

from .api import Engine
from .schema import InvalidRangeError, LoadError, NotLoadedError, SignalNotFoundError, TraceError

_CYCLE = {"clock": None, "start_cycle": None, "end_cycle": None, "edge": "rising"}
_RANGE = {"start": None, "end": None}
REQUIRED = object()

#: Path: verb, engine method, arguments with defaults.
ENDPOINTS = {
    "/health": ("GET", "status", {}),
    "/unload": ("POST", "unload", {}),
    "/load": ("POST", "load", {"path": REQUIRED}),
    "/signals": ("GET", "signals", {"pattern": None, "limit": 500}),
    "/query": ("POST", "query", {"signal": REQUIRED, "start": REQUIRED, "end": REQUIRED}),
    "/query_cycles": ("POST", "query_cycles", {"signal": REQUIRED, "clock": REQUIRED, "start_cycle": REQUIRED, "end_cycle": REQUIRED, "edge": "rising"}),
    "/probe": ("POST", "probe", {"signals": REQUIRED, **_RANGE, **_CYCLE, "include_changes": False, "max_changes": 200, "max_unique": 32}),
    "/inspect": ("POST", "inspect", {"signals": REQUIRED, **_RANGE, **_CYCLE, "include_changes": True, "max_changes": 200, "max_unique": 32}),
    "/analyze": ("POST", "analyze", {"signal": REQUIRED, "start": REQUIRED, "end": REQUIRED}),
    "/find_stall": ("POST", "find_stall", {"signal": REQUIRED, "min_duration": 1000, **_RANGE, "max_results": 10}),
    "/last_activity": ("POST", "last_activity", {"signals": None, "pattern": None, "sort_by": "time_desc", "limit": 20}),
    "/compare_points": ("POST", "compare_points", {"signals": REQUIRED, "time_a": REQUIRED, "time_b": REQUIRED}),
}

#: Tool: description, engine method, arguments with defaults.
TOOLS = {
    "wave_load": ("Load a recording.", "load", {"path": REQUIRED}),
    "wave_unload": ("Forget the loaded recording.", "unload", {}),
    "wave_status": ("The loaded recording, its signals and its time range.", "status", {}),
    "wave_signals": ("Signal names, by regular expression.", "signals", {"pattern": None, "limit": 100}),
    "wave_query": ("A signal's value before a range and its changes in it.", "query", {"signal": REQUIRED, "start": REQUIRED, "end": REQUIRED, "max_changes": 50}),
    "wave_query_cycles": ("The same for a range of clock cycles.", "query_cycles", {"signal": REQUIRED, "clock": REQUIRED, "start_cycle": REQUIRED, "end_cycle": REQUIRED, "edge": "rising"}),
    "wave_probe": ("Initial and final values, counts and unique values of signals.", "probe", {"signals": REQUIRED, **_RANGE, **_CYCLE, "include_changes": False, "max_changes": 20, "max_unique": 16}),
    "wave_inspect": ("Probe with analysis of each signal and of their relations.", "inspect", {"signals": REQUIRED, **_RANGE, **_CYCLE, "include_changes": False, "max_changes": 20, "max_unique": 16}),
    "wave_find_stall": ("Long times without a change.", "find_stall", {"signal": REQUIRED, "min_duration": 1000, **_RANGE, "max_results": 10}),
    "wave_compare_points": ("Values of signals at two times.", "compare_points", {"signals": REQUIRED, "time_a": REQUIRED, "time_b": REQUIRED}),
    "wave_find_event": ("Changes to, into or out of a value.", "find_event", {"signal": REQUIRED, "value": REQUIRED, **_RANGE, "edge": "any", "max_results": 20}),
    "wave_last_activity": ("The last change of signals.", "last_activity", {"signals": None, "pattern": None, "sort_by": "time_desc", "limit": 20}),
    "wave_hierarchy": ("Modules with their numbers of signals.", "hierarchy", {"pattern": None, "depth": 3}),
    "wave_busy_tree": ("Busy signals under a module at a time.", "busy_tree", {"root": REQUIRED, "time": REQUIRED, "busy_patterns": None}),
    "wave_find_deadlock": ("Modules with blocked handshakes or busy signals at a time.", "find_deadlock", {"time": REQUIRED, "signals": None, "module": None}),
    "wave_trace_dependency": ("Control signals around a signal at a time.", "trace_dependency", {"signal": REQUIRED, "time": REQUIRED, "direction": "backward", "max_depth": 5}),
}


def call(engine: Engine, method: str, takes: dict, given: dict) -> dict:
    """Calls an engine method with defaults filled in; unknown and missing arguments are errors; ``file_path`` may be said for ``path``."""
    if "path" in takes and "file_path" in given:
        given = {**{k: v for k, v in given.items() if k != "file_path"}, "path": given["file_path"]}
    if unknown := set(given) - set(takes):
        raise InvalidRangeError(f"unknown arguments: {', '.join(sorted(unknown))}")
    if missing := [k for k, v in takes.items() if v is REQUIRED and given.get(k) is None]:
        raise InvalidRangeError(f"missing arguments: {', '.join(missing)}")
    args = {k: given.get(k, v) for k, v in takes.items()}
    if args.get("clock") is None and "signals" in takes:
        for k in _CYCLE:
            args.pop(k, None)
    if "signals" in args and method != "find_deadlock":
        args["wanted"] = args.pop("signals")
    return getattr(engine, method)(**args)


def status_code(error: Exception) -> int:
    if isinstance(error, SignalNotFoundError):
        return 404
    if isinstance(error, (NotLoadedError, InvalidRangeError, ValueError)):
        return 400
    return 500


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for ``serve_forever``; one request at a time uses the engine."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, verb: str):
            url = urlsplit(self.path)
            known = ENDPOINTS.get(url.path)
            try:
                if known is None or known[0] != verb:
                    return self._send(404, {"detail": f"no {verb} {url.path}"})
                if verb == "GET":
                    given = {k: int(v[0]) if v[0].isdigit() else v[0] for k, v in parse_qs(url.query).items()}
                else:
                    given = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                with lock:
                    result = call(engine, known[1], known[2], given)
                self._send(200, result)
            except Exception as e:  # noqa: BLE001  every failure is an answer
                self._send(status_code(e), {"detail": str(e)})

        def _send(self, code: int, body: dict):
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self._answer("GET")

        def do_POST(self):  # noqa: N802
            self._answer("POST")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def tool_list() -> list[dict]:
    shape = lambda takes: {"type": "object", "properties": {k: {} for k in takes}, "required": [k for k, v in takes.items() if v is REQUIRED]}
    return [{"name": n, "description": d, "inputSchema": shape(takes)} for n, (d, _, takes) in TOOLS.items()]


def call_tool(engine: Engine, name: str, arguments: dict) -> dict:
    if name not in TOOLS:
        return {"error": f"unknown tool: {name}"}
    try:
        return call(engine, *TOOLS[name][1:], arguments)
    except (TraceError, ValueError) as e:
        return {"error": str(e)}


def serve_tools(engine: Engine, source=sys.stdin, sink=sys.stdout) -> None:
    """Answers JSON-RPC requests (initialize, tools/list, tools/call), one a line."""
    handlers: dict[str, Callable[[dict], dict]] = {
        "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tracequery", "version": "1"}},
        "ping": lambda p: {},
        "tools/list": lambda p: {"tools": tool_list()},
        "tools/call": lambda p: {"content": [{"type": "text", "text": json.dumps(call_tool(engine, p.get("name", ""), p.get("arguments") or {}), default=str)}]},
    }
    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            if "id" not in request:
                continue
            answer = {"jsonrpc": "2.0", "id": request["id"]}
            handler = handlers.get(request.get("method"))
            answer |= {"result": handler(request.get("params") or {})} if handler else {"error": {"code": -32601, "message": f"no method {request.get('method')}"}}
        sink.write(json.dumps(answer) + "\n")
        sink.flush()


class Waveform:
    """One recording; its methods load it when another one is current."""

    def __init__(self, engine: Engine, path: str):
        self.engine, self.path = engine, path

    def __getattr__(self, name: str):
        if name.startswith("_") or not callable(getattr(Engine, name, None)):
            raise AttributeError(name)

        def run(*args, **kwargs):
            self.engine.ensure(self.path)
            return getattr(self.engine, name)(*args, **kwargs)

        return run


class Client:
    """The engine behind an HTTP server, which it starts unless one answers there already.

    Methods are the endpoints' names and take their arguments; ``ensure_loaded``
    loads a file unless it is the current one.
    """

    def __init__(self, url: str = "http://127.0.0.1:8000", engine: Callable[[], Engine] | None = None, timeout: float = 600):
        self.url, self.timeout, self._server = url.rstrip("/"), timeout, None
        if engine is not None and not self.alive():
            parts = urlsplit(self.url)
            self._server = http_server(engine(), parts.hostname or "127.0.0.1", parts.port or 80)
            threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def alive(self) -> bool:
        try:
            return "status" in self.call("health")
        except OSError:
            return False

    def call(self, endpoint: str, **arguments) -> dict:
        verb = ENDPOINTS[f"/{endpoint}"][0]
        query = "?" + urlencode({k: v for k, v in arguments.items() if v is not None}) if verb == "GET" and arguments else ""
        body = json.dumps(arguments).encode() if verb == "POST" else None
        request = Request(f"{self.url}/{endpoint}{query}", body, {"Content-Type": "application/json"}, method=verb)
        try:
            with urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except HTTPError as e:
            kind = {404: SignalNotFoundError, 400: InvalidRangeError}.get(e.code, TraceError)
            raise kind(json.loads(e.read() or b"{}").get("detail", str(e))) from None

    def ensure_loaded(self, path: str) -> dict:
        status = self.call("health")
        return status if status.get("loaded_file") == path else self.call("load", path=path)

    def __getattr__(self, name: str):
        if f"/{name}" not in ENDPOINTS:
            raise AttributeError(name)
        return lambda **arguments: self.call(name, **arguments)

    def close(self) -> None:
        """Stops the server if this client started it."""
        if self._server is not None:
            self._server.shutdown()
            self._server.server_close()
            self._server = None


def inspect(engine: Engine, path: str, signals, **options) -> dict:
    return Waveform(engine, path).inspect(signals, **options)


def probe(engine: Engine, path: str, signals, **options) -> dict:
    return Waveform(engine, path).probe(signals, **options)


__all__ = ["ENDPOINTS", "TOOLS", "Client", "LoadError", "Waveform", "call_tool", "http_server", "inspect", "probe", "serve_tools", "tool_list"]
