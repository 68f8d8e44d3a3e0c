"""A small server for metrics: /metrics, /healthz and a page at /."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def parse_endpoint(text: str) -> tuple[str, int]:
    """`host:port`, `port` or `:port`; the host is local unless named."""
    host, _, port = text.rpartition(":")
    if not port.isdigit() or not 0 <= int(port) <= 65535:
        raise ValueError(f"no endpoint: {text}")
    return host or "127.0.0.1", int(port)


class MetricsServer:
    def __init__(self, endpoint: str, render: Callable[[], str]):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                pages = {"/metrics": ("text/plain; version=0.0.4", render), "/healthz": ("text/plain", lambda: "ok\n"), "/": ("text/plain", lambda: "see /metrics\n")}
                kind, page = pages.get(self.path.split("?")[0], ("text/plain", None))
                body = (page() if page else "not found\n").encode()
                self.send_response(200 if page else 404)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer(parse_endpoint(endpoint), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
