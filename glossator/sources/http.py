"""The tool calls over HTTP: JSON in a POST, JSON back."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from ..operators.tools import respond


def answer(method: str, content_type: str, body: bytes, library: Any, enabled: bool = True) -> tuple[int, Any]:
    """Status and value for a request. 404 while switched off, 405 but for POST, 415 without JSON, 400 with what is none; 202
    without a value when there is nothing to answer."""
    if not enabled:
        return 404, None
    if method != "POST":
        return 405, None
    if content_type.split(";")[0].strip().lower() != "application/json":
        return 415, None
    try:
        message = json.loads(body)
        if not isinstance(message, (dict, list)):
            raise ValueError
    except ValueError:
        return 400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a JSON object"}}
    value = respond(message, library)
    return (202, None) if value is None else (200, value)


def server(library: Any, port: int = 0, enabled: Callable[[], bool] = lambda: True, most: int = 4 << 20) -> ThreadingHTTPServer:
    """A server on this machine alone; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, value = (413, None) if size > most else answer(self.command, self.headers.get("Content-Type") or "", self.rfile.read(size), library, enabled())
            data = b"" if value is None else json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            if status == 405:
                self.send_header("Allow", "POST")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
