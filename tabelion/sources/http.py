"""A polite HTTP client: a least interval, retries with backoff for passing errors, provenance of each answer."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

# Fixed values.
PASSING = frozenset({429, 500, 502, 503, 504})
INTERVAL, TRIES, TIMEOUT, LONGEST_WAIT = 1.0, 5, 60, 60


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


def send(method: str, url: str, headers: dict, body: bytes | None) -> bytes:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=TIMEOUT) as answer:
            return answer.read()
    except urllib.error.HTTPError as error:
        raise HttpError(error.code) from error


class Client:
    """transport: (method, url, headers, body) -> bytes, raising HttpError or OSError; a picklable function for use in tasks."""

    def __init__(self, transport: Callable[[str, str, dict, bytes | None], bytes] = send, headers: dict | None = None, interval: float = INTERVAL, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.headers, self.interval, self.sleep, self.last = transport, headers or {}, interval, sleep, 0.0

    def request(self, method: str, url: str, params: dict | None = None, body: dict | None = None) -> tuple[dict, dict]:
        full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
        data = json.dumps(body).encode() if body is not None else None
        headers = self.headers | ({"Content-Type": "application/json"} if data else {})
        for attempt in range(TRIES):
            wait = self.last + self.interval - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                raw = self.transport(method, full, headers, data)
                break
            except HttpError as error:
                if error.status not in PASSING or attempt + 1 == TRIES:
                    raise
            except OSError:
                if attempt + 1 == TRIES:
                    raise
            self.sleep(min(LONGEST_WAIT, 2 ** (attempt + 1)))
        source = {"url": url, "metodo": method, "parametros": json.dumps(params or body or {}, ensure_ascii=False, sort_keys=True), "coletado_em": datetime.now(UTC).isoformat(timespec="seconds"), "sha256": hashlib.sha256(raw).hexdigest()}
        return json.loads(raw), source
