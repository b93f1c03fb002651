"""One HTTP request for a fetch: budget, validators, limits, errors."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from tidemark.errors import HttpError
from tidemark.functions.web import parse_problem, parse_rate_limit, parse_retry_after, request_url

Send = Callable[[str, str, Mapping[str, str], bytes | None, float], tuple[int, Mapping[str, str], bytes]]


def send(method: str, url: str, headers: Mapping[str, str], body: bytes | None, timeout: float) -> tuple[int, Mapping[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, dict(headers), method=method), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


@dataclass
class Client:
    """Asks once; what to do about a failure is the schedule's business."""

    base: str
    clock: Callable[[], int]
    send: Send = send
    headers: dict[str, str] = field(default_factory=dict)
    charge: Callable[[], None] = lambda: None
    validators: dict[str, dict] = field(default_factory=dict)

    def get(self, path: str, query: Mapping[str, object] | None = None, timeout: float = 30) -> tuple[object, dict]:
        """The JSON body (None for 304) and what the headers say."""
        url = request_url(self.base + path, query)
        known = self.validators.get(hashlib.sha256(url.encode()).hexdigest()[:32], {})
        headers = self.headers | {k: v for k, v in (("If-None-Match", known.get("etag")), ("If-Modified-Since", known.get("last_modified"))) if v}
        self.charge()
        status, got, body = self.send("GET", url, headers, None, timeout)
        low = {k.lower(): v for k, v in got.items()}
        about = {"status": status, "rate_limit": parse_rate_limit(low, self.clock())}
        if status == 304:
            return None, about
        if not 200 <= status < 300:
            text = body.decode("utf-8", "replace")
            raise HttpError(f"GET {url} gave {status}", status=status, retry_after_ms=parse_retry_after(low.get("retry-after"), self.clock()), problem=parse_problem(low.get("content-type"), text))
        if "etag" in low or "last-modified" in low:
            self.validators[hashlib.sha256(url.encode()).hexdigest()[:32]] = {"etag": low.get("etag"), "last_modified": low.get("last-modified"), "stored_at": self.clock()}
        return json.loads(body) if body else None, about
