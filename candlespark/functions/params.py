"""Checks of a request's parameters, made on the driver before a plan is built."""

from __future__ import annotations

import datetime as dt

from candlespark.operators.read import instant


def whole_number(text: str | None, name: str, default: int) -> int:
    """A whole number from 1 on; blank gives the default."""
    text = (text or "").strip()
    if not text:
        return default
    if not text.removeprefix("+").removeprefix("-").isascii() or not text.removeprefix("+").removeprefix("-").isdigit():
        raise ValueError(f"{name}: {text!r} isn't a whole number")
    if int(text) < 1:
        raise ValueError(f"{name}: {text} is below 1")
    return int(text)


def day(text: str | None, name: str, default: dt.date) -> dt.date:
    """A date as YYYY-MM-DD; blank gives the default."""
    text = (text or "").strip()
    if not text:
        return default
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date() if len(text) == 10 else dt.date.fromisoformat("")
    except ValueError:
        raise ValueError(f"{name}: {text!r} isn't a date like 2024-01-31") from None


def moment(text: str | None, name: str) -> dt.datetime | None:
    """An RFC 3339 instant with its offset, as UTC; blank gives None."""
    text = (text or "").strip()
    if not text:
        return None
    try:
        found = dt.datetime.fromisoformat(text)
    except ValueError:
        found = None
    if found is None or found.tzinfo is None or text[10:11] not in "Tt":
        raise ValueError(f"{name}: {text!r} isn't an instant like 2024-01-31T13:00:00Z")
    return instant(found)


def in_order(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    """A range whose start isn't after its end."""
    if start > end:
        raise ValueError(f"the range starts on {start}, after its end {end}")
    return start, end
