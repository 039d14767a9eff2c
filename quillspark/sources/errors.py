"""Error codes, their exit codes, and the translation of HTTP answers."""

from __future__ import annotations

import json

#: Codes and exit codes (fixed values).
EXIT = {
    "auth_missing": 2, "auth_expired": 2, "auth_denied": 2, "quota_exceeded": 3, "rate_limited": 3, "not_found": 4,
    "invalid_args": 5, "empty_input": 5, "unsupported_language": 5, "unknown_metric": 5,
    "network_unreachable": 6, "api_5xx": 6, "provider_unavailable": 6, "generic": 1,
}
FATAL = ("auth_missing", "auth_denied", "auth_expired", "quota_exceeded", "rate_limited", "provider_unavailable")


class TextError(Exception):
    def __init__(self, code: str, message: str, hint: str = "", retriable: bool = False, retry_after: float | None = None):
        super().__init__(message)
        self.code, self.message, self.hint, self.retriable, self.retry_after = code, message, hint, retriable, retry_after

    @property
    def exit_code(self) -> int:
        return EXIT.get(self.code, 1)

    def line(self) -> str:
        """One JSON line."""
        e: dict = {"code": self.code, "message": self.message}
        if self.hint:
            e["hint"] = self.hint
        e["retriable"] = self.retriable
        if self.retry_after:
            e["retry_after_sec"] = int(self.retry_after)
        return json.dumps({"error": e}, ensure_ascii=False, separators=(",", ":"))

    def struct(self) -> tuple:
        return self.code, self.message, self.retriable


ERROR_STRUCT = "struct<code:string,message:string,retriable:boolean>"


def from_status(status: int, headers: dict[str, str] | None = None, message: str = "", keyed: bool = True) -> TextError:
    """The error of an HTTP status."""
    wait = retry_after((headers or {}).get("retry-after"))
    text = message or f"HTTP {status}"
    if status in (401, 403):
        return TextError("auth_denied" if keyed else "auth_missing", text)
    if status == 402:
        return TextError("quota_exceeded", text)
    if status == 429:
        return TextError("rate_limited", text, retriable=True, retry_after=wait)
    if status == 404:
        return TextError("not_found", text)
    if status in (408, 504):
        return TextError("network_unreachable", text, retriable=True)
    if status >= 500:
        return TextError("api_5xx", text, retriable=True)
    return TextError("invalid_args", text)


def retry_after(value: str | None) -> float | None:
    """Seconds of a Retry-After header, if it gives a number."""
    try:
        x = float((value or "").strip())
    except ValueError:
        return None
    return x if x >= 0 else None


def is_fatal(code: str) -> bool:
    """Whether an error will repeat for every other page of a run."""
    return code in FATAL
