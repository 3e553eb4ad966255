"""Driver-side parameters: time bounds, steps, intervals."""

from __future__ import annotations

import re
from datetime import UTC, datetime

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def step_seconds(step: str | float | None, span: float | None = None) -> int:
    """``30s``, ``5m``, ``5000ms``, ``60`` -> whole seconds, at least 1; without a step a 500th of the span."""
    if step in (None, ""):
        return max(1, int((span or 0) / 500))
    if m := re.fullmatch(r"\s*([0-9.]+)\s*(ms|s|m|h|d)?\s*", str(step)):
        return max(1, int(float(m[1]) * _UNITS[m[2] or "s"]))
    raise ValueError(f"not a step: {step!r}")


def interval_seconds(interval_ms: float) -> int:
    """The bucket of access-log metrics: a minute at least."""
    return max(60, int(interval_ms) // 1000)


def bound(value: str | float | datetime) -> datetime:
    """A time bound as a zone-less UTC time: epoch numbers by magnitude (s, ms, us, ns), ISO-8601 text, or a datetime."""
    if isinstance(value, datetime):
        return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    try:
        number = float(value)
    except ValueError:
        return bound(datetime.fromisoformat(str(value)))
    for limit, scale in ((1e10, 1), (1e13, 1e3), (1e16, 1e6)):
        if abs(number) < limit:
            return datetime.fromtimestamp(number / scale, UTC).replace(tzinfo=None)
    return datetime.fromtimestamp(int(value) // 1000 / 1e6, UTC).replace(tzinfo=None)
