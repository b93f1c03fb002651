"""Webhook sink: signed posts of events (K5, K9)."""

from __future__ import annotations

import json
from collections.abc import Callable

from tidemark.errors import DeliveryFailed
from tidemark.functions.web import parse_retry_after, sign
from tidemark.sources.http import Send, send

MOST_BODY = 4096


def cloudevent(event: dict, prefix: str = "feed") -> dict:
    """K10 for one event; its data and previous are JSON texts."""
    value = lambda k: json.loads(event[k]) if event.get(k) else None
    out = {"specversion": "1.0", "id": event["id"], "source": event["source"], "type": f"{event['poller']}.{event['type']}", "subject": event["subject"], "time": event["time"], "datacontenttype": "application/json"}
    if event.get("data") is not None:
        out["data"] = value("data")
    out |= {prefix + "partition": event.get("partition", ""), prefix + "lane": event["lane"], prefix + "sequence": event["sequence"], prefix + "poller": event["poller"]}
    if event.get("previous") is not None:
        out[prefix + "previous"] = value("previous")
    return out


def webhook(url: str, secret: str | None, clock: Callable[[], int], post: Send = send, timeout: float = 30, raw: bool = False) -> Callable[[dict], None]:
    """A handler that posts each event; anything but a 2xx answer is a failed delivery."""

    def deliver(event: dict) -> None:
        body = json.dumps(event if raw else cloudevent(event), separators=(",", ":"))
        stamp = str(clock() // 1000)
        headers = {"content-type": "application/json" if raw else "application/cloudevents+json", "webhook-id": event["id"], "webhook-timestamp": stamp}
        if secret:
            headers["webhook-signature"] = sign(secret, event["id"], stamp, body)
        status, got, answer = post("POST", url, headers, body.encode(), timeout)
        if not 200 <= status < 300:
            low = {k.lower(): v for k, v in got.items()}
            raise DeliveryFailed(f"{url} gave {status}", status=status, body=answer.decode("utf-8", "replace")[:MOST_BODY], retry_after_ms=parse_retry_after(low.get("retry-after"), clock()))

    return deliver
