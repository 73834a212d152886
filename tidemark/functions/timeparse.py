"""Times of the query language, read on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from ..errors import RequestError

#: Where an open beginning starts, and fixed values: seconds of each unit.
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_DURATION = re.compile(r"([+-]?)((?:\d+(?:\.\d+)?(?:ms|[smhdw]))+)")
_PART = re.compile(r"(\d+(?:\.\d+)?)(ms|[smhdw])")


def duration(text: str) -> timedelta:
    m = _DURATION.fullmatch(text.strip())
    if not m:
        raise RequestError(f"not a duration: {text!r}")
    seconds = sum(float(n) * UNITS[u] for n, u in _PART.findall(m[2]))
    return timedelta(seconds=-seconds if m[1] == "-" else seconds)


def instant(value: str | int | datetime, now: datetime | None = None) -> datetime:
    """RFC 3339, `now`, or a duration from now; cut to milliseconds."""
    now = now or datetime.now(timezone.utc)
    if isinstance(value, datetime):
        out = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    elif not isinstance(value, str):
        raise RequestError("a time is text or a timestamp, not a number")
    elif value.strip().lower() == "now":
        out = now
    elif _DURATION.fullmatch(value.strip()):
        out = now + duration(value)
    else:
        try:
            out = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError:
            raise RequestError(f"not a time: {value!r}") from None
        if out.tzinfo is None:
            raise RequestError(f"a time needs a zone: {value!r}")
    return out.replace(microsecond=out.microsecond // 1000 * 1000)


def time_range(op: str, value: object, end: object = None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """Bounds, both inclusive: > and >= are alike, and so are < and <=."""
    now = now or datetime.now(timezone.utc)
    if op == "BETWEEN":
        return instant(value, now), instant(end, now)
    t = instant(value, now)
    if op == "=":
        return t, t
    return (t, instant(now, now)) if op in (">", ">=") else (EPOCH, t)
