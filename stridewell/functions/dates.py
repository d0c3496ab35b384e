"""Date expressions and half-open date ranges, worked out on the driver."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the named ranges; None is all of time, "ytd" the year so far.
PRESETS: dict[str, int | str | None] = {"all": None, "7d": 7, "4w": 28, "3m": 90, "6m": 182, "ytd": "ytd", "12m": 365, "2y": 730, "5y": 1826}


def add_months(day: date, months: int) -> date:
    """The same day of another month, or that month's last day."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def shift(day: date, count: int, unit: str) -> date:
    if unit in "dw":
        return day + timedelta(days=count * (7 if unit == "w" else 1))
    return add_months(day, count * (12 if unit == "y" else 1))


def parse_date_expr(expr: str | None, reference: date) -> date:
    """A day from YYYY, YYYY-MM, YYYY-MM-DD, or [-]N and one of d, w, m, y relative to reference."""
    text = (expr or "").strip()
    if m := re.fullmatch(r"(-?)(\d+)([dwmy])", text):
        return shift(reference, -int(m[2]) if m[1] else int(m[2]), m[3])
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text):
        return date(int(m[1]), int(m[2] or 1), int(m[3] or 1))
    raise ValueError(f"not a date expression: {expr!r}")


def build_date_range(after: str | None = None, before: str | None = None, span: str | None = None, today: date | None = None) -> tuple[date | None, date | None]:
    """[from, to) of two expressions, or of a start and a span that is counted from it; open ends are None."""
    today = today or date.today()
    if span and before:
        raise ValueError("span and before exclude each other")
    if span and not after:
        raise ValueError("span needs after")
    start = parse_date_expr(after, today) if after else None
    if span:
        return start, parse_date_expr(span.lstrip("-"), start)
    return start, parse_date_expr(before, today) if before else None


def preset_range(name: str, today: date) -> tuple[date | None, date | None]:
    days = PRESETS[name]
    if days is None:
        return None, None
    return (date(today.year, 1, 1) if days == "ytd" else today - timedelta(days=days)), None


def within(column: Column, start: date | None, end: date | None) -> Column:
    """start <= column < end, which reaches the scan; an end that is None is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= F.lit(start))
    if end is not None:
        out = out & (column < F.lit(end))
    return out


def sunday_week(day: Column) -> Column:
    return F.date_sub(F.date_trunc("week", F.date_add(day, 1)).cast("date"), 1)


def monday_week(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def iso_week_label(day: Column) -> Column:
    """Calendar year and ISO week."""
    return F.format_string("%d-W%02d", F.year(day), F.weekofyear(day))
