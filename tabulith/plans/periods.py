"""Business periods as closed date intervals, for columns or literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("current_week", "previous_complete_week", "current_month", "previous_month", "current_quarter", "previous_quarter", "current_fiscal_year", "previous_fiscal_year", "current_fiscal_quarter", "previous_fiscal_quarter", "custom")


def period(kind: str, day: Column, week_start: int = 0, fiscal_start: int = 1, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """First and last day of the period of a kind that holds, or comes before, a day. Weeks start on week_start (Monday is 0)."""
    if kind not in KINDS:
        raise ValueError(f"unknown or ambiguous period: {kind}")
    back = 1 if kind.startswith("previous") else 0
    if kind == "custom":
        if start is None or end is None:
            raise ValueError("a custom period needs both days")
        return start, end
    if kind.endswith("week"):
        first = F.date_sub(day, (F.pmod(F.weekday(day) - week_start, F.lit(7)) + 7 * back).cast("int"))
        return first, F.date_add(first, 6)
    if kind.endswith("month"):
        months, shift = 1, F.lit(0)
    elif kind.endswith("fiscal_year"):
        months, shift = 12, F.pmod(F.month(day) - fiscal_start, F.lit(12))
    else:
        months, shift = 3, F.pmod(F.month(day) - (fiscal_start if "fiscal" in kind else 1), F.lit(3))
    first = F.add_months(F.trunc(day, "MM"), (-shift - months * back).cast("int"))
    return first, F.date_sub(F.add_months(first, months), 1)
