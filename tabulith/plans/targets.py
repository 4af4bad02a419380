"""What a delivery is told: its inputs, targets, their mappings, and the formats of its outputs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabulith import contract as C
from tabulith.plans import formats
from tabulith.sources.workbook import column_number

# What a target's columns may hold, and the formats of outputs.
DELIVERED = ("record_id", *(f.name for f in C.RECORD.fields))
FORMATS = ("xlsx", "csv", "pdf")
CSV_MODES = ("one-file-per-sheet", "single-sheet")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Expected:
    """A cell that has to show a period."""

    sheet: str
    cell: str
    value: Any
    field: str = "report_period"


@dataclass(frozen=True)
class Target:
    key: str
    template: str
    sheet: str
    columns: Mapping[str, int]
    aliases: tuple[str, ...] = ()
    header_row: int = 1
    data_start_row: int = 2
    style_row: int | None = None
    max_rows: int | None = None
    overwrite_formulas: bool = False
    required: tuple[str, ...] = ()
    record_id_field: str = "record_id"
    expected: tuple[Expected, ...] = ()
    name: str | None = None
    kinds: Mapping[str, str] = field(default_factory=dict)
    currency: str | None = None
    formulas: tuple[Mapping[str, Any], ...] = ()

    def __post_init__(self) -> None:
        if not self.key.strip() or not self.sheet.strip() or not self.columns:
            raise ConfigError("a target needs a key, a sheet and columns")
        if self.header_row < 1 or self.data_start_row <= self.header_row:
            raise ConfigError(f"{self.key}: data begin below the header")
        if self.max_rows is not None and self.max_rows < 0:
            raise ConfigError(f"{self.key}: max_rows is negative")
        if len(set(self.columns.values())) < len(self.columns):
            raise ConfigError(f"{self.key}: two fields share a column")
        lost = sorted(set(self.kinds) - set(self.columns))
        if lost:
            raise ConfigError(f"{self.key}: formats of fields without a column: {', '.join(lost)}")


def column(ref: object, key: str) -> int:
    try:
        return column_number(ref)  # type: ignore[arg-type]
    except ValueError as e:
        raise ConfigError(f"{key}: {e}") from e


def target(raw: Mapping[str, Any], base: str = "") -> Target:
    if not isinstance(raw, Mapping):
        raise ConfigError("each target is an object")
    key, columns = str(raw.get("key") or "").strip(), raw.get("field_columns")
    if not key or not isinstance(columns, Mapping) or not columns:
        raise ConfigError("each target needs a key and field_columns")
    policy = raw.get("format_policy") or {}
    if not isinstance(policy, Mapping):
        raise ConfigError(f"{key}: format_policy is an object")
    sheet = str(raw.get("sheet") or "")
    rules = raw.get("formulas", ())
    if not isinstance(rules, (list, tuple)) or not all(isinstance(x, Mapping) for x in rules):
        raise ConfigError(f"{key}: formulas are an array of objects")
    expected = tuple(Expected(str(x.get("sheet") or sheet), str(x.get("cell")), x.get("expected"), str(x.get("field", "report_period"))) for x in raw.get("period_expectations", ()) if isinstance(x, Mapping))
    return Target(
        key, under(base, str(raw.get("template") or "")), sheet, {f: column(c, key) for f, c in columns.items()}, tuple(map(str, raw.get("aliases", ()))), int(raw.get("header_row", 1)), int(raw.get("data_start_row", 2)),
        raw.get("style_source_row"), raw.get("max_rows"), bool(raw.get("overwrite_formulas", False)), tuple(map(str, raw.get("required_fields", ()))), str(raw.get("record_id_field", "record_id")), expected, raw.get("delivery_name"),
        {f: str(k) for f, k in (policy.get("fields") or {}).items()}, policy.get("currency"), tuple(rules),
    )


def under(base: str, name: str) -> str:
    return name if not base or "://" in name or name.startswith("/") else f"{base.rstrip('/')}/{name}"


@dataclass(frozen=True)
class Exports:
    """Which formats are asked for, and the scopes of those that need one."""

    formats: tuple[str, ...] = ("xlsx",)
    csv_mode: str | None = None
    csv_sheet: str | None = None
    pdf_sheets: tuple[str, ...] | None = None

    def warnings(self) -> tuple[str, ...]:
        return tuple(w for f, w in (("csv", "csv_drops_workbook_features"), ("pdf", "pdf_is_not_editable")) if f in self.formats)


def exports(payload: Mapping[str, Any]) -> Exports:
    """The formats that a configuration asks for, and nothing that contradicts them."""
    asked = payload.get("delivery") or {}
    if not isinstance(asked, Mapping):
        raise ConfigError("delivery is an object")
    names = asked.get("formats", payload.get("formats", ["xlsx"]))
    if not isinstance(names, (list, tuple)) or not names or any(n not in FORMATS for n in names):
        raise ConfigError(f"formats are some of {', '.join(FORMATS)}")
    csv, pdf = asked.get("csv") or {}, asked.get("pdf") or {}
    if not isinstance(csv, Mapping) or not isinstance(pdf, Mapping):
        raise ConfigError("csv and pdf are objects")
    mode, sheet, sheets = csv.get("mode"), csv.get("sheet"), pdf.get("sheets")
    if ("csv" in names) != (mode is not None) or (mode is not None and mode not in CSV_MODES):
        raise ConfigError(f"csv takes a mode of {', '.join(CSV_MODES)}, and only csv does")
    if sheet is not None and (not isinstance(sheet, str) or "csv" not in names):
        raise ConfigError("csv.sheet names the sheet of a csv")
    if mode == "single-sheet" and not (sheet or "").strip():
        raise ConfigError("a single sheet has to be named")
    listed = isinstance(sheets, (list, tuple)) and len(sheets) > 0 and all(isinstance(s, str) and s.strip() for s in sheets)
    if ("pdf" in names and not (sheets == "all" or listed)) or ("pdf" not in names and sheets is not None):
        raise ConfigError("pdf takes all sheets or a list of them, and only pdf does")
    return Exports(tuple(dict.fromkeys(names)), mode, sheet.strip() if sheet else None, tuple(sheets) if listed else None)


@dataclass(frozen=True)
class Options:
    inputs: tuple[str, ...]
    staging: str
    delivery: str
    least_confidence: float = C.LEAST_CONFIDENCE
    recipe: str | None = None
    exports: Exports = field(default_factory=Exports)


def load(payload: Mapping[str, Any], base: str = "") -> tuple[list[Target], Options]:
    """Targets and options of a configuration; what is incomplete or contradicts itself is refused."""
    raw, inputs = payload.get("targets"), payload.get("inputs")
    if not isinstance(raw, list) or not raw or not isinstance(inputs, list) or not inputs:
        raise ConfigError("a configuration needs targets and inputs")
    common = {k: payload[k] for k in ("format_policy",) if k in payload}
    targets = [target({**common, **t} if isinstance(t, Mapping) else t, base) for t in raw]
    if len({t.key for t in targets}) < len(targets):
        raise ConfigError("two targets share a key")
    recipe = payload.get("recipe")
    return targets, Options(
        tuple(under(base, str(x)) for x in inputs), under(base, str(payload.get("staging_dir") or "staging")), under(base, str(payload.get("delivery_dir") or "delivery")),
        float(payload.get("confidence_threshold", C.LEAST_CONFIDENCE)), under(base, str(recipe)) if recipe else None, exports(payload),
    )


def blockers(t: Target, has_template: bool) -> list[str]:
    """Why nothing may be written to a target."""
    name = t.template.rpartition("/")[2]
    out = [] if has_template else [f"{t.key}: missing_template:{name}"]
    out += [f"{t.key}: unmapped_contract_field:{f}" for f in sorted(set(t.columns) - set(DELIVERED))]
    out += [] if t.record_id_field in t.columns else [f"{t.key}: record_id_not_mapped:{t.record_id_field}"]
    out += [f"{t.key}: required_field_not_mapped:{f}" for f in sorted(set(t.required) - set(t.columns))]
    return out + ([f"{t.key}: template_accepts_no_rows"] if t.max_rows == 0 else [])


def destinations(spark: SparkSession, targets: list[Target]) -> DataFrame:
    return spark.createDataFrame([(t.key, list(t.aliases)) for t in targets], "key string, aliases array<string>")


MAPPING = "destination string, sheet string, field string, col int, header_row int, data_start_row int, overwrite boolean"


def mapping(spark: SparkSession, targets: list[Target]) -> DataFrame:
    """A row for each mapped field of each target."""
    return spark.createDataFrame([(t.key, t.sheet, f, c, t.header_row, t.data_start_row, t.overwrite_formulas) for t in targets for f, c in t.columns.items()], MAPPING)


def number_formats(t: Target, currency: str | None) -> dict[str, str]:
    """The format code of each field that has a kind."""
    return {f: formats.code(kind, currency=currency or t.currency if kind == "amount" else None) for f, kind in t.kinds.items()}
