"""GET /query?query=... on 127.0.0.1, answered in SPARQL JSON."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import islice
from urllib.parse import parse_qs, urlsplit

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException

from .engine import Engine
from .terms import SparqlError

PAGE = """<!doctype html><meta charset="utf-8"><title>Query</title>
<style>body{display:flex;gap:1em;font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #aaa;padding:.2em .5em}</style>
<form id="f" action="/query" method="get"><textarea name="query" rows="20" cols="70">SELECT * WHERE { ?s ?p ?o } LIMIT 10</textarea><br><button>Run</button></form>
<div><p id="note"></p><table id="rows"></table></div>
<script>
const note = document.getElementById("note"), rows = document.getElementById("rows");
const line = (tag, cells) => { const tr = rows.insertRow(); for (const c of cells) tr.appendChild(Object.assign(document.createElement(tag), {textContent: c})); };
document.getElementById("f").onsubmit = async event => {
  event.preventDefault();
  rows.replaceChildren();
  note.textContent = "running";
  const reply = await fetch("/query?" + new URLSearchParams(new FormData(event.target)));
  if (!reply.ok) { note.textContent = await reply.text(); return; }
  const found = await reply.json();
  if ("boolean" in found) { note.textContent = found.boolean; return; }
  note.textContent = found.results.bindings.length + " solutions";
  line("th", found.head.vars);
  for (const b of found.results.bindings) line("td", found.head.vars.map(v => v in b ? b[v].value : ""));
};
</script>
"""


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path in ("/", "/index.html"):
                return self.reply(200, "text/html; charset=utf-8", [PAGE])
            if url.path != "/query":
                return self.reply(404, "text/plain", ["not found"])
            text = parse_qs(url.query).get("query", [""])[0]
            if not text:
                return self.reply(400, "text/plain", ["the parameter query is missing"])
            try:
                body = engine.json(text)
                first = list(islice(body, 2))  # with the second piece the job has run up to its first row
            except (SparqlError, AnalysisException) as e:
                return self.reply(400, "text/plain; charset=utf-8", [str(e)])
            except (PySparkException, Py4JError) as e:
                return self.reply(500, "text/plain; charset=utf-8", [str(e)])
            return self.reply(200, "application/sparql-results+json", first, body)

        def reply(self, status: int, kind: str, head: list[str], rest=()) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            for piece in head:
                self.wfile.write(piece.encode())
            for piece in rest:
                self.wfile.write(piece.encode())

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8005) -> ThreadingHTTPServer:
    """A server that is bound but not yet running; call serve_forever()."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(engine))
