"""HTTP values: Retry-After, rate-limit headers, problem details, redaction, URLs, signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from collections.abc import Mapping
from email.utils import parsedate_to_datetime
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError

#: Header names that are always masked, and the mask.
REDACTED = ("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization")
MASK = "***"
SECRET_PREFIX = "whsec_"
TOLERANCE_S = 300


def retry_after_ms(c: Column, now_ms: Column) -> Column:
    """Seconds (fractions allowed) or an HTTP date, never below 0; null where it is neither."""
    t = F.trim(c)
    seconds = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), t.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"^\w+, ", ""), " GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(seconds.isNotNull(), F.when(seconds >= 0, F.floor(seconds * 1000 + 0.5).cast("long"))).when(date.isNotNull(), F.greatest(F.unix_millis(date) - now_ms, F.lit(0)))


def parse_retry_after(value: str | None, now_ms: int) -> int | None:
    text = (value or "").strip()
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", text):
        return int(float(text) * 1000 + 0.5) if float(text) >= 0 else None
    try:
        return max(0, int(parsedate_to_datetime(text).timestamp() * 1000) - now_ms)
    except (ValueError, TypeError):
        return None


#: Numbers at the start of a header, and from where on a reset is in milliseconds.
LEADING = r"^\s*([0-9]+(?:\.[0-9]+)?)"
EPOCH_MS = 100_000_000_000


def _number(text: str | None) -> float | None:
    """The number that a header begins with."""
    m = re.match(LEADING, text or "")
    return float(m[1]) if m else None


def parse_rate_limit(headers: Mapping[str, str], now_ms: int) -> dict | None:
    """Structured headers first, then the plain draft names, then vendors' X- names.

    A reset is a date in epoch milliseconds from ``EPOCH_MS`` on, one in epoch seconds above 30 days of seconds, and else
    counts from now; one under a name with -after always counts from now.
    """
    low = {k.lower(): v for k, v in headers.items()}

    def reset(value: float | None) -> int | None:
        if value is None:
            return None
        if value >= EPOCH_MS:
            return int(value)
        return int(value * 1000) if value > 30 * 86_400 else int(now_ms + value * 1000)

    if "ratelimit" in low and ("=" in low["ratelimit"]):
        fields = dict(re.findall(r"(\w+)\s*=\s*\"?([^;,\"\s]+)", low["ratelimit"]))
        policy = dict(re.findall(r"(\w+)\s*=\s*\"?([^;,\"\s]+)", low.get("ratelimit-policy", "")))
        name = re.match(r'\s*"?([\w.-]+)"?\s*;', low["ratelimit"])
        out = {"limit": _number(fields.get("limit") or policy.get("q")), "remaining": _number(fields.get("r") or fields.get("remaining")), "reset_at": reset(_number(fields.get("t") or fields.get("reset"))), "policy": name[1] if name else None, "source": "ietf"}
        return out if out["remaining"] is not None or out["limit"] is not None else None
    for prefix, source in (("ratelimit-", "legacy"), ("x-ratelimit-", "vendor"), ("x-rate-limit-", "vendor")):
        values = {k: _number(low.get(prefix + k)) for k in ("limit", "remaining", "reset")}
        after = _number(low.get(prefix + "reset-after"))
        if after is not None:
            return {"limit": values["limit"], "remaining": values["remaining"], "reset_at": int(now_ms + after * 1000), "policy": None, "source": source}
        if any(v is not None for v in values.values()):
            return {"limit": values["limit"], "remaining": values["remaining"], "reset_at": reset(values["reset"]), "policy": None, "source": source}
    return None


def rate_limit_columns(headers: Column, now_ms: Column) -> Column:
    """The same as a struct (limit, remaining, reset_at, source); header names are lower-case."""
    text = lambda k: F.try_element_at(headers, F.lit(k))
    get = lambda k: F.regexp_extract(text(k), LEADING, 1).try_cast("double")
    part = lambda k, *names: F.coalesce(*(F.regexp_extract(text(k), rf'(?:^|[;,\s]){n}\s*=\s*"?([0-9.]+)', 1).try_cast("double") for n in names))
    ietf = text("ratelimit").contains("=") & F.coalesce(part("ratelimit", "r", "remaining", "limit"), part("ratelimit-policy", "q")).isNotNull()
    plain = F.coalesce(*(get(f"ratelimit-{k}") for k in ("limit", "remaining", "reset", "reset-after"))).isNotNull()
    vendor = F.coalesce(*(get(f"x-ratelimit-{k}") for k in ("limit", "remaining", "reset", "reset-after"))).isNotNull()
    structured = {"limit": F.coalesce(part("ratelimit", "limit"), part("ratelimit-policy", "q")), "remaining": part("ratelimit", "r", "remaining"), "reset": part("ratelimit", "t", "reset"), "reset-after": F.lit(None).cast("double")}
    one = lambda k: F.when(F.coalesce(ietf, F.lit(False)), structured[k]).when(plain, get(f"ratelimit-{k}")).otherwise(get(f"x-ratelimit-{k}"))
    at, after = one("reset"), one("reset-after")
    reset = F.when(after.isNotNull(), now_ms + after * 1000).when(at >= EPOCH_MS, at).when(at > 30 * 86_400, at * 1000).otherwise(now_ms + at * 1000).cast("long")
    source = F.when(F.coalesce(ietf, F.lit(False)), F.lit("ietf")).when(plain, F.lit("legacy")).when(vendor, F.lit("vendor"))
    return F.struct(one("limit").cast("long").alias("limit"), one("remaining").cast("long").alias("remaining"), reset.alias("reset_at"), source.alias("source"))


def is_problem(content_type: Column, body: Column) -> Column:
    """F16: whether a response carries RFC 9457 details."""
    media = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    problem = media == "application/problem+json"
    jsonish = problem | (media == "application/json") | media.endswith("+json")
    keys = F.json_object_keys(body)
    known = F.arrays_overlap(keys, F.array(*(F.lit(k) for k in ("type", "title", "status", "detail", "instance"))))
    return F.coalesce(jsonish & body.rlike(r"^\s*\{") & (problem | known), F.lit(False))


def problem_field(body: Column, name: str) -> Column:
    return F.get_json_object(body, f"$.{name}")


def parse_problem(content_type: str | None, body: str | None) -> dict | None:
    media = (content_type or "").split(";")[0].strip().lower()
    if not body or not (media == "application/json" or media.endswith("+json")):
        return None
    try:
        got = json.loads(body)
    except ValueError:
        return None
    known = {"type", "title", "status", "detail", "instance"}
    if not isinstance(got, dict) or (media != "application/problem+json" and not known & got.keys()):
        return None
    out = {k: v for k, v in got.items() if k not in known}
    out |= {k: got[k] for k in ("type", "title", "detail", "instance") if isinstance(got.get(k), str)}
    status = got.get("status")
    if isinstance(status, (int, float)) and not isinstance(status, bool):
        out["status"] = status
    elif isinstance(status, str) and re.fullmatch(r"\d{3}", status):
        out["status"] = int(status)
    return out


def redacted(headers: Column, extra: tuple[str, ...] = ()) -> Column:
    names = [*REDACTED, *(x.strip().lower() for x in extra)]
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*names), F.lit(MASK)).otherwise(v))


def redact_headers(headers: Mapping[str, str], extra: tuple[str, ...] = ()) -> dict[str, str]:
    names = {*REDACTED, *(x.strip().lower() for x in extra)}
    return {k: MASK if k.lower() in names else v for k, v in headers.items()}


def request_url(base: str, query: Mapping[str, object] | None = None) -> str:
    """Nulls are left out, lists repeat their key."""
    pairs = [(k, x) for k, v in (query or {}).items() for x in (v if isinstance(v, (list, tuple)) else [v]) if x is not None]
    if not pairs:
        return base
    return base + ("&" if "?" in base else "?") + urlencode([(k, str(v).lower() if isinstance(v, bool) else v) for k, v in pairs])


def request_url_column(base: Column, names: list[str], values: list[Column]) -> Column:
    parts = [F.when(v.isNotNull(), F.concat(F.lit(n + "="), F.url_encode(v.cast("string")))) for n, v in zip(names, values)]
    query = F.concat_ws("&", *parts)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def decode_secret(secret: str) -> bytes:
    if not secret.startswith(SECRET_PREFIX):
        return secret.encode()
    try:
        return base64.b64decode(secret.removeprefix(SECRET_PREFIX), validate=True)
    except ValueError:
        raise ConfigError("a webhook secret's text after its prefix must be base64") from None


def sign(secret: str, message_id: str, timestamp: object, body: str) -> str:
    mac = hmac.new(decode_secret(secret), f"{message_id}.{timestamp}.{body}".encode(), hashlib.sha256)
    return "v1," + base64.b64encode(mac.digest()).decode()


def verify(secret: str, message_id: str, timestamp: str, body: str, header: str, now_ms: int, tolerance_s: int = TOLERANCE_S) -> bool:
    if not re.fullmatch(r"\d+", timestamp) or abs(now_ms // 1000 - int(timestamp)) > tolerance_s:
        return False
    wanted = sign(secret, message_id, timestamp, body)
    return any(hmac.compare_digest(wanted.encode(), x.encode()) for x in header.split())


def signature_column(secret: str):
    """F19 as an Arrow UDF of (id, timestamp, body)."""

    @F.pandas_udf("string")
    def signed(ids: pd.Series, times: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([sign(secret, i, t, b) for i, t, b in zip(ids, times, bodies)])

    return signed


def verified_column(secret: str, now_ms: int):
    """``verify`` as an Arrow UDF of (id, timestamp, body, header)."""

    @F.pandas_udf("boolean")
    def verified(ids: pd.Series, times: pd.Series, bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([verify(secret, *x, now_ms) for x in zip(ids, times, bodies, headers)], dtype=bool)

    return verified


def weak_etag_equal(a: Column, b: Column) -> Column:
    """F26."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    return F.exists(F.split(b, ","), lambda x: (F.trim(x) == "*") | (bare(x) == bare(a)))


def offset_token(offset: Column) -> Column:
    """F27."""
    return F.base64(F.concat(F.lit("o:"), offset.cast("string")).cast("binary"))


def token_offset(token: Column) -> Column:
    return F.regexp_extract(F.unbase64(token).cast("string"), r"^o:(\d+)$", 1).try_cast("long")
