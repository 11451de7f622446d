"""Lengths of time as Spark's watermarks take them."""

from __future__ import annotations

from datetime import timedelta


def milliseconds(text: str) -> int:
    """Milliseconds of e.g. ``10 minutes`` or ``1 hour 30 seconds``."""
    parts = text.lower().split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a length of time: {text!r}")
    units = {(u if u.endswith("s") else u + "s"): float(v) for v, u in zip(parts[::2], parts[1::2])}
    return round(timedelta(**units).total_seconds() * 1000)
