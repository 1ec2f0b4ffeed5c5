"""A small SPARQL endpoint over a session: GET and POST /sparql, /health, /stats, /cache/stats, /cache/clear."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from graphloom.engine import Engine
from graphloom.operators.cache import QueryCache, RateLimiter
from graphloom.operators.reasoning import statistics
from graphloom.sources import files
from graphloom.sources.graphs import Dataset, Graph


def answer(engine: Engine, text: str, accept: str = "") -> tuple[str, str]:
    """The result's text and media type: JSON or XML for bindings, N-Triples for graphs."""
    df = engine.sparql(text)
    if df.columns == ["s", "p", "o"] and text.lstrip().upper().find("CONSTRUCT") + text.upper().find("DESCRIBE") > -2:
        return "".join(r.value + "\n" for r in files.ntriples_lines(df).toLocalIterator()), "application/n-triples"
    if "xml" in accept:
        return files.results_xml(df), "application/sparql-results+xml"
    return files.results_json(df), "application/sparql-results+json"


def make_server(engine: Engine, port: int = 8000, rate: float = 100.0) -> ThreadingHTTPServer:
    cache, limiter = QueryCache(), RateLimiter(rate, int(rate))
    texts: dict[tuple[str, str], tuple[str, str]] = {}
    held = {"engine": engine}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _query(self, text: str | None) -> None:
            if not limiter.allow():
                return self._send(429, json.dumps({"error": "too many requests"}))
            if not text:
                return self._send(400, json.dumps({"error": "no query"}))
            key = cache.key(text), self.headers.get("Accept", "")
            try:
                if key in texts:
                    cache.hits += 1
                else:
                    cache.misses += 1
                    texts[key] = answer(held["engine"], text, key[1])
                return self._send(200, *texts[key])
            except ValueError as e:
                return self._send(400, json.dumps({"error": str(e)}))

        def _update(self, text: str) -> None:
            """The endpoint's data from now on; answers kept so far are void."""
            if not limiter.allow():
                return self._send(429, json.dumps({"error": "too many requests"}))
            try:
                held["engine"] = held["engine"].update(text)
                texts.clear()
                return self._send(200, json.dumps({"status": "updated"}))
            except ValueError as e:
                return self._send(400, json.dumps({"error": str(e)}))

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path == "/sparql":
                self._query(parse_qs(url.query).get("query", [None])[0])
            elif url.path in ("/", "/health"):
                self._send(200, json.dumps({"status": "ok"}))
            elif url.path == "/stats":
                data = held["engine"].data
                data = data.default() if isinstance(data, Dataset) else data
                self._send(200, json.dumps(statistics(Graph(data.triples)).first().asDict()))
            elif url.path == "/cache/stats":
                self._send(200, json.dumps({"hits": cache.hits, "misses": cache.misses, "entries": len(texts)}))
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if self.path == "/cache/clear":
                texts.clear()
                return self._send(200, json.dumps({"status": "cleared"}))
            kind = self.headers.get("Content-Type", "")
            if kind.startswith("application/x-www-form-urlencoded"):
                fields = parse_qs(body)
                if "update" in fields:
                    return self._update(fields["update"][0])
                body = fields.get("query", [""])[0]
            return self._update(body) if kind.startswith("application/sparql-update") else self._query(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
