"""Names of periods in two languages, days as of which they hold, and the cells that show them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators.verify import same_value
from tabulith.plans import periods
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import workbook

# What people call a period, what is never one period, and what a date's cell may show.
NAMES = {
    "本周": "current_week", "this week": "current_week",
    "上周": "previous_complete_week", "上一个完整周": "previous_complete_week", "last complete week": "previous_complete_week", "previous complete week": "previous_complete_week",
    "本月": "current_month", "this month": "current_month", "上个月": "previous_month", "last month": "previous_month",
    "本季度": "current_quarter", "this quarter": "current_quarter", "上季度": "previous_quarter", "last quarter": "previous_quarter",
    "本财年": "current_fiscal_year", "this fiscal year": "current_fiscal_year", "上财年": "previous_fiscal_year", "last fiscal year": "previous_fiscal_year",
    "本财季": "current_fiscal_quarter", "this fiscal quarter": "current_fiscal_quarter", "上财季": "previous_fiscal_quarter", "last fiscal quarter": "previous_fiscal_quarter",
    "自定义": "custom", "custom": "custom",
}
AMBIGUOUS = ("最近一周", "近一周", "last week", "recent week", "past week")
ROLES = ("period", "period_start", "period_end", "generated_on", "deadline")
PROTECTED = "historical_event_date"


class PeriodError(ValueError):
    pass


class AmbiguousPeriod(PeriodError):
    pass


def kind(expression: Column) -> Column:
    """The kind of period that a text names: `ambiguous` for some texts, null for what is no period."""
    text = F.lower(F.trim(F.regexp_replace(expression, r"\s+", " ")))
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.when(text.isin(*AMBIGUOUS), "ambiguous").otherwise(F.try_element_at(known, text))


def kind_of(expression: str) -> str:
    text = " ".join((expression or "").lower().split())
    if text in AMBIGUOUS:
        raise AmbiguousPeriod(f"{expression}: seven days back, or the last complete week?")
    if text not in NAMES:
        raise PeriodError(f"no period: {expression!r}")
    return NAMES[text]


def as_of(value: date | datetime | str | None, zone: str = "UTC") -> tuple[date, bool]:
    """The day that a value means in a time zone, and whether the zone moved it: moments with an offset are converted, others are kept."""
    try:
        there = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise PeriodError(f"no time zone: {zone}") from e
    if value is None:
        return datetime.now(there).date(), True
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError as e:
            raise PeriodError(f"no day: {value}") from e
    if isinstance(value, datetime):
        moved = value.astimezone(there) if value.tzinfo else value
        return moved.date(), moved.date() != value.date()
    return value, False


def day_in(moment: Column, zone: str) -> Column:
    """The day of ISO texts in a time zone: those with an offset or Z are converted, others are kept; null where there is none."""
    offset = moment.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(moment.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")))
    return F.when(offset, local).otherwise(F.substring(moment, 1, 10).try_cast("date"))


@dataclass(frozen=True)
class Period:
    start: date
    end: date
    on: date
    moved: bool
    rule: dict[str, Any]

    @property
    def text(self) -> str:
        return f"{self.start} 至 {self.end}"


def _months(day: date, n: int) -> date:
    k = 12 * day.year + day.month - 1 + n
    return date(k // 12, k % 12 + 1, 1)


def resolved(expression: str, on: date | datetime | str | None = None, zone: str = "UTC", week_start: int = 0, fiscal_start: int = 1, first: str | date | None = None, last: str | date | None = None) -> Period:
    """The period that an expression names, as of a day. rule holds all that it follows from."""
    name = kind_of(expression)
    if not 0 <= week_start <= 6 or not 1 <= fiscal_start <= 12:
        raise PeriodError("a week starts on day 0 to 6, a fiscal year in month 1 to 12")
    day, moved = as_of(on, zone)
    rule = {"expression": expression.strip(), "period_kind": name, "week_start": week_start, "fiscal_year_start_month": fiscal_start, "timezone": zone}
    if name == "custom":
        try:
            start, end = (x if isinstance(x, date) else date.fromisoformat(str(x).strip()) for x in (first, last))
        except ValueError as e:
            raise PeriodError("a custom period needs two ISO days") from e
        if start > end:
            raise PeriodError("the first day is after the last")
        return Period(start, end, day, moved, rule | {"custom_start": start.isoformat(), "custom_end": end.isoformat()})
    back = int(name.startswith("previous"))
    if name.endswith("week"):
        start = day - timedelta(days=(day.weekday() - week_start) % 7 + 7 * back)
        return Period(start, start + timedelta(days=6), day, moved, rule)
    span = 1 if name.endswith("month") else 12 if name.endswith("year") else 3
    begin = fiscal_start if "fiscal" in name else 1
    start = _months(day, -((day.month - begin) % span) - span * back)
    return Period(start, _months(start, span) - timedelta(days=1), day, moved, rule)


def columns(expression: str, day: Column, **policy: int) -> tuple[Column, Column]:
    """The same for a column of days."""
    return periods.period(kind_of(expression), day, **policy)


@dataclass(frozen=True)
class Slot:
    """A cell, or a sheet's title (cell is None), that shows a period's date."""

    sheet: str
    role: str
    cell: str | None = None
    template: str = "{value}"
    when_empty: bool = True
    data_start_row: int = 2


def shown(template: str, p: Period, generated: date | None = None, deadline: date | None = None) -> str:
    return template.format(**context(p, generated, deadline), value=p.text)


def context(p: Period, generated: date | None, deadline: date | None) -> dict[str, Any]:
    return {"period": p.text, "period_start": p.start, "period_end": p.end, "generated_on": generated or p.on, "deadline": deadline}


def slot_value(slot: Slot, p: Period, generated: date | None = None, deadline: date | None = None) -> Any:
    """What a slot is to show; dates of events past are never changed."""
    if slot.role not in ROLES:
        raise PeriodError(f"a {slot.role} is protected or not known")
    values = context(p, generated, deadline)
    if values[slot.role] is None:
        raise PeriodError(f"{slot.role} has no value")
    return values[slot.role] if slot.template == "{value}" else slot.template.format(**values, value=values[slot.role])


SLOTS = "pos int, sheet string, cell string, role string, when_empty boolean, data_start_row int, new_value string"


def slots_frame(spark: SparkSession, slots: list[Slot], p: Period, generated: date | None = None, deadline: date | None = None) -> DataFrame:
    text = lambda s: None if s.role == PROTECTED else str(slot_value(s, p, generated, deadline))
    return spark.createDataFrame([(k, s.sheet, s.cell, s.role, s.when_empty, s.data_start_row, text(s)) for k, s in enumerate(slots)], SLOTS)


def slot_changes(cells: DataFrame, slots: DataFrame) -> DataFrame:
    """(pos, sheet, target, role, old_value, new_value, status): updated, unchanged, protected or empty_skipped for each slot.

    cells: (sheet, row, cell, value). A slot without a cell is its sheet's title.
    """
    last = cells.where("value <> ''").groupBy("sheet").agg(F.max("row").alias("last"))
    out = slots.join(last, "sheet", "left").join(cells.select("sheet", "cell", F.col("value").alias("old")), ["sheet", "cell"], "left")
    old = F.when(F.col("cell").isNull(), F.col("sheet")).otherwise(F.col("old"))
    empty = ~F.col("when_empty") & (F.coalesce("last", F.lit(0)) < F.col("data_start_row"))
    same = F.coalesce(same_value(old, F.col("new_value")), F.lit(False))
    status = F.when(F.col("role") == PROTECTED, "protected").when(empty, "empty_skipped").when(same, "unchanged").otherwise("updated")
    kept = status.isin("protected", "empty_skipped")
    return out.select("pos", "sheet", F.coalesce("cell", F.lit("<sheet title>")).alias("target"), "role", old.alias("old_value"), F.when(kept, old).otherwise(F.col("new_value")).alias("new_value"), status.alias("status"))


def slot_findings(changes: DataFrame, cells: DataFrame) -> DataFrame:
    """(pos, sheet, target) of slots that an output does not show. cells: those of the output (sheet, cell, value)."""
    titles = changes.where("target = '<sheet title>'").select(F.col("sheet").alias("was"), F.col("new_value").alias("is"))
    moved = changes.join(titles, changes["sheet"] == titles["was"], "left").select("pos", "sheet", "target", "new_value", F.coalesce("is", "sheet").alias("now"))
    there = cells.select(F.col("sheet").alias("now")).distinct().withColumn("there", F.lit(True))
    have = cells.select(F.col("sheet").alias("now"), F.col("cell").alias("target"), F.col("value").alias("have"))
    both = moved.join(there, "now", "left").join(have, ["now", "target"], "left")
    bad = F.col("there").isNull() | ((F.col("target") != "<sheet title>") & ~same_value(F.col("new_value"), F.col("have")))
    return both.where(bad).select("pos", "sheet", "target")


def refresh(spark: SparkSession, source: str, target: str, p: Period, slots: list[Slot], generated: date | None = None, deadline: date | None = None, dry_run: bool = False) -> DataFrame:
    """Write a copy of a workbook whose declared slots show a period, read it back, and return slot_changes."""
    if not slots or source == target:
        raise PeriodError("slots and a target of its own are needed")
    cells = workbook.cells(spark, source).select("sheet", "row", "cell", "value")
    known = {r.sheet for r in workbook.layout(spark, source).select("sheet").collect()}
    lost = {s.sheet for s in slots} - known
    if lost:
        raise PeriodError(f"missing sheet: {', '.join(sorted(lost))}")
    changes = slot_changes(cells, slots_frame(spark, slots, p, generated, deadline))
    rows = changes.orderBy("pos").collect()  # one for each slot
    if dry_run:
        return changes
    writes: dict[str, list[W.Write]] = {}
    titles = {}
    for r in rows:
        if r.status == "updated" and r.target == "<sheet title>":
            titles[r.sheet] = r.new_value
        elif r.status == "updated":
            row, col, *_ = workbook.bounds(r.target)
            writes.setdefault(r.sheet, []).append(W.Write(row, col, r.new_value))
    beside = f"{target[: target.rfind('.')]}.part{target[target.rfind('.'):]}"
    files.write(spark, beside, W.patched(files.read(spark, source), writes, titles=titles))
    wrong = slot_findings(changes, workbook.cells(spark, beside)).limit(1).count()
    if wrong:
        files.delete(spark, beside)
        raise PeriodError("a slot does not show its period")
    files.move(spark, beside, target)
    return spark.createDataFrame(rows, changes.schema)
