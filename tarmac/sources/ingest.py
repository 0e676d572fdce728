"""Ingest over HTTP: lines that are posted become files of a stream.

One listener stands on one machine and keeps nothing: each body is a file in the stream's folder before the sender gets its answer. Where the folder is shared, any number of listeners may fill it.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import TracebackType

#: Bytes that one body may have.
MOST = 64 << 20


class Listener:
    """``with Listener(folder) as listener:`` takes POST requests at ``listener.url``; a file for each, visible only when it is whole."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, path: str = "/flights"):
        os.makedirs(folder, exist_ok=True)

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                size = self.headers.get("Content-Length", "")
                if self.path != path:
                    return self._answer(404)
                if not size.isdigit() or int(size) > MOST:
                    return self._answer(413 if size.isdigit() else 411)
                body = self.rfile.read(int(size))
                if len(body) < int(size):
                    return self._answer(400)
                name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.csv"
                with open(f"{folder}/.{name}", "wb") as out:
                    out.write(body)
                    out.flush()
                    os.fsync(out.fileno())
                os.rename(f"{folder}/.{name}", f"{folder}/{name}")
                self._answer(200)

            def _answer(self, status: int) -> None:
                self.send_response(status)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}{path}"

    def __enter__(self) -> Listener:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.server.shutdown()
        self.server.server_close()
