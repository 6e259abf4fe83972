"""Date arguments: period strings, range checks, look-back extension."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

PERIOD_PATTERN = r"(\d+)(y|mo|d)"


def parse_day(text: str) -> date:
    """Parse a ``YYYY-MM-DD`` day or raise ValueError."""
    return datetime.strptime(text, "%Y-%m-%d").date()


def _months_before(day: date, months: int) -> date:
    index = day.year * 12 + (day.month - 1) - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


def period_range(period: str, now: date) -> tuple[date, date]:
    """``ytd``, ``max`` or ``<n>(y|mo|d)`` as a (start, end) pair ending at ``now``."""
    if period == "ytd":
        return date(now.year, 1, 1), now
    if period == "max":
        return date(1970, 1, 1), now
    match = re.fullmatch(PERIOD_PATTERN, period)
    if match is None:
        raise ValueError(f"period {period!r} is not of the form 1y, 6mo or 5d")
    count, unit = int(match[1]), match[2]
    if unit == "d":
        return now - timedelta(days=count), now
    return _months_before(now, count * (12 if unit == "y" else 1)), now


def check_range(start: str | None, end: str | None, period: str | None) -> None:
    """Either a period or both dates; dates must parse and be in order."""
    if period and (start or end):
        raise ValueError("give either a period or start and end dates, not both")
    if (start is None) != (end is None):
        raise ValueError("start and end dates must be given together")
    if start and end and parse_day(start) >= parse_day(end):
        raise ValueError(f"start date {start} must be before end date {end}")


def resolve_range(
    start: str | None, end: str | None, period: str | None, now: date | None = None
) -> tuple[date | None, date | None]:
    """Checked (start, end); a period is turned into dates once, here."""
    check_range(start, end, period)
    if period:
        return period_range(period, now or date.today())
    return (parse_day(start), parse_day(end)) if start else (None, None)


def extended_start(start: date, lookback: int) -> date:
    """Move ``start`` back far enough for ``lookback`` bars, with a margin for closed days."""
    return start - timedelta(days=int(lookback * 1.6) + 10)
