"""A small HTTP front: ``GET /query?<statement>`` answers in the text form.

    python -m keyloom.server --port 8081 --db-root /path/to/db
"""

from __future__ import annotations

import argparse
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

from pyspark.sql import SparkSession

from keyloom.errors import EngineError
from keyloom.plans.engine import Engine


def answer(engine: Engine, target: str) -> tuple[int, str]:
    """Status and body for a request target."""
    path, _, query = target.partition("?")
    if path != "/query" or not query:
        return 404, "use /query?<statement>\n"
    try:
        return 200, engine.text(unquote(query))
    except EngineError as e:
        return 200, f"{e.code.name}: {e}\n"


def serve(engine: Engine, port: int = 8081, host: str = "127.0.0.1") -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = answer(engine, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            return

    return HTTPServer((host, port), Handler)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser()
    p.add_argument("--port", type=int, default=8081)
    p.add_argument("--db-root", required=True)
    return p.parse_args(argv)


def repl(engine: Engine, read=input, write=print) -> None:
    """Statements line by line until an empty one."""
    while line := read("> ").strip():
        try:
            write(engine.text(line), end="")
        except EngineError as e:
            write(f"{e.code.name}: {e}")


if __name__ == "__main__":
    args = arguments()
    serve(Engine(SparkSession.builder.getOrCreate(), args.db_root), args.port).serve_forever()
