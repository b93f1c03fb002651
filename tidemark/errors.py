"""Errors with stable codes (API)."""

from __future__ import annotations


class FeedError(Exception):
    code = "FEED"

    def __init__(self, message: str, **details: object):
        super().__init__(message)
        self.details = details


def _kind(name: str, code: str) -> type[FeedError]:
    return type(name, (FeedError,), {"code": code})


ConfigError = _kind("ConfigError", "CONFIG")
HttpError = _kind("HttpError", "HTTP")
ValidationFailed = _kind("ValidationFailed", "VALIDATION")
LeaseLost = _kind("LeaseLost", "LEASE_LOST")
StoreError = _kind("StoreError", "STORE")
BudgetTimeout = _kind("BudgetTimeout", "BUDGET_TIMEOUT")
Aborted = _kind("Aborted", "ABORTED")
PoisonHalt = _kind("PoisonHalt", "POISON_HALT")
DeliveryFailed = _kind("DeliveryFailed", "DELIVERY")
HandlerError = _kind("HandlerError", "HANDLER")
CircuitOpen = _kind("CircuitOpen", "CIRCUIT_OPEN")
Unsupported = _kind("Unsupported", "UNSUPPORTED")


def serialize_error(error: BaseException, depth: int = 3) -> dict:
    """name, message, code, status and at most ``depth`` causes."""
    out: dict = {"name": type(error).__name__, "message": str(error)}
    for key in ("code", "status"):
        value = getattr(error, key, None) or getattr(error, "details", {}).get(key)
        if value is not None:
            out[key] = value
    if error.__cause__ is not None and depth > 0:
        out["cause"] = serialize_error(error.__cause__, depth - 1)
    return out


def is_throttle(status: int | None, retry_after: object = None) -> bool:
    """429, or 503 with Retry-After."""
    return status == 429 or (status == 503 and retry_after is not None)
