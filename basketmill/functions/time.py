"""Months, cutoffs and elapsed days over zone-less timestamps."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass(frozen=True)
class MonthWindow:
    """A calendar month as the half-open range ``[start, end)``."""

    label: str
    start: datetime
    end: datetime


def _first_day(serial: int) -> datetime:
    return datetime(serial // 12, serial % 12 + 1, 1)


def _serial(label: str) -> int:
    day = datetime.strptime(label, "%Y-%m")
    return day.year * 12 + day.month - 1


def month_window(label: str) -> MonthWindow:
    serial = _serial(label)
    return MonthWindow(label, _first_day(serial), _first_day(serial + 1))


def month_minus(label: str, months: int) -> str:
    return f"{_first_day(_serial(label) - months):%Y-%m}"


def previous_months(label: str, count: int) -> list[str]:
    """The ``count`` months before ``label``, oldest first."""
    return [month_minus(label, back) for back in range(count, 0, -1)]


def ntz_sql(moment: datetime) -> str:
    """A zone-less timestamp literal (``F.lit`` would make a zoned one)."""
    return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'"


def back_sql(cutoff: datetime, days: int) -> str:
    return ntz_sql(cutoff - timedelta(days=days))


def whole_days_sql(since: str, cutoff: datetime) -> str:
    """Whole elapsed days up to ``cutoff``: time of day counts, unlike ``datediff``."""
    return f"timestampdiff(DAY, {since}, {ntz_sql(cutoff)})"
