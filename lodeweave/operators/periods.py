"""Periods of whole days: presets, named and explicit ones, and the period before.

Driver-side date arithmetic; plans get literals.
"""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

PRESETS = ("today", "yesterday", "this_week", "last_week", "this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year", "last_7_days", "last_30_days")
MOST_UNITS = 60


class Refusal(ValueError):
    """A caller's mistake, told in words."""


def add_months(d: date, n: int) -> date:
    """The same day n months on, or the last day of that month."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, monthrange(y, m + 1)[1]))


def shift(d: date, unit: str, n: int) -> date:
    """By whole calendar units, never into the next month."""
    if unit in ("day", "week"):
        return d + timedelta(days=n * (7 if unit == "week" else 1))
    return add_months(d, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def start_of(d: date, unit: str) -> date:
    """The first day of the unit that d is in; weeks begin on Monday."""
    if unit == "week":
        return d - timedelta(days=d.weekday())
    if unit == "day":
        return d
    return date(d.year, {"month": d.month, "quarter": (d.month - 1) // 3 * 3 + 1, "year": 1}[unit], 1)


def whole_units(first: date, last: date, unit: str) -> int | None:
    """How many whole units [first, last] is, up to 60; None if it isn't."""
    if start_of(first, unit) != first:
        return None
    return next((n for n in range(1, MOST_UNITS + 1) if shift(first, unit, n) - timedelta(days=1) == last), None)


@dataclass(frozen=True)
class Period:
    """A closed range of days. ``unit`` and ``units`` say how to go back by one such period; without a unit, by its days."""

    first: date
    last: date
    label: str
    unit: str | None = None
    units: int = 1

    @staticmethod
    def days(first: date, last: date, label: str) -> Period:
        """With the largest unit of which the days are whole ones."""
        for unit in ("year", "quarter", "month", "week"):
            if n := whole_units(first, last, unit):
                return Period(first, last, label, unit, n)
        return Period(first, last, label)

    @property
    def bounds(self) -> tuple[datetime, datetime]:
        """First and last second."""
        return datetime.combine(self.first, time()), datetime.combine(self.last, time(23, 59, 59))

    def _whole(self) -> bool:
        return self.unit is not None and whole_units(self.first, self.last, self.unit) is not None

    def previous(self) -> Period:
        """Whole units before, kept whole; the same days of the unit before for a running one; else as many days before."""
        if self.unit is None:
            n = timedelta(days=(self.last - self.first).days + 1)
            return Period(self.first - n, self.last - n, "previous period")
        first, last = shift(self.first, self.unit, -self.units), shift(self.last, self.unit, -self.units)
        if self._whole():
            last = shift(first, self.unit, self.units) - timedelta(days=1)
        return Period(first, last, "previous period", self.unit, self.units)

    def previous_year(self) -> Period:
        """A year before; 29 February becomes 1 March."""

        def back(d: date) -> date:
            return date(d.year - 1, 3, 1) if (d.month, d.day) == (2, 29) else d.replace(year=d.year - 1)

        first, last = back(self.first), back(self.last)
        if self._whole():
            last = shift(first, self.unit or "day", self.units) - timedelta(days=1)
        return Period(first, last, "same period last year", self.unit, self.units)


def _date(value: str, argument: str) -> date:
    try:
        return date.fromisoformat(value)
    except ValueError:
        raise Refusal(f'"{argument}" must be a date like 2026-01-31.') from None


def resolve(period: str | None = None, first: str | None = None, last: str | None = None, named: dict[str, tuple[str, str]] | None = None, today: date | None = None) -> Period:
    """Explicit days, a named period or a preset; this month if nothing is given. Running presets end today."""
    today, named = today or date.today(), named or {}
    if first or last:
        a, b = _date(first or last or "", "from"), _date(last or first or "", "to")
        if b < a:
            raise Refusal('"to" is before "from".')
        return Period.days(a, b, f"{a} – {b}")
    period = period or "this_month"
    if period in named:
        return Period.days(*(_date(x, period) for x in named[period]), period)
    one = timedelta(days=1)
    if period == "today":
        return Period(today, today, period, "day")
    if period == "yesterday":
        return Period(today - one, today - one, period, "day")
    if period in ("last_7_days", "last_30_days"):
        return Period(today - timedelta(days=int(period.split("_")[1]) - 1), today, period)
    if period not in PRESETS:
        raise Refusal(f"unknown period [{period}]. Use one of: {', '.join([*PRESETS, *named])}, or \"from\"/\"to\".")
    which, unit = period.split("_")
    start = start_of(today, unit)
    if which == "this":
        return Period(start, today, period, unit)
    before = shift(start, unit, -1)
    return Period.days(before, start - one, period)
