"""Health findings of workbooks as one table, the repairs that they propose, and repaired copies that are checked.

A finding is a row (finding_id, code, severity, sheet, location, evidence, fixability, details), details
as JSON. A repair is bound to the content that it was planned for and to one finding; only selected
repairs whose target is known are applied, nothing else may change, and a copy is kept only if a new
scan agrees.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.operators import health
from tabulith.operators.state import canonical, digest
from tabulith.operators.write import letters
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import workbook

# What each finding asks for, what can be applied, the cells that a blank and zero scan may take, names of empty sheets.
OPERATIONS = {
    "abnormal_merged_cells": "unmerge_cells", "blank_data_rows": "remove_blank_rows", "blank_zero_scan_budget_exceeded": "report_scan_budget", "blank_zero_semantics": "declare_blank_zero_policy",
    "content_beyond_working_area": "remove_outlying_content", "default_empty_sheet": "remove_empty_sheet", "duplicate_header": "rename_duplicate_header", "empty_workbook": "report_empty_workbook",
    "extra_whitespace": "normalize_whitespace", "filter_range_mismatch": "align_filter_range", "freeze_panes_mismatch": "align_freeze_panes", "inconsistent_cell_style": "declare_style_baseline",
    "invisible_characters": "remove_invisible_characters", "mixed_date_formats": "declare_date_format", "numeric_text": "convert_numeric_text", "print_area_mismatch": "align_print_area",
}
APPLICABLE = ("normalize_whitespace", "remove_invisible_characters", "convert_numeric_text", "rename_duplicate_header", "align_filter_range", "align_freeze_panes", "align_print_area", "declare_date_format", "declare_blank_zero_policy")
BUDGET, WIDE_MERGE = 100_000, 100
DEFAULT_SHEET = r"(?i)^(sheet|工作表)\s*\d*$"
UNSUPPORTED = ("abnormal_merged_cells", "blank_zero_scan_budget_exceeded", "content_beyond_working_area", "empty_workbook")
BASELINES = {"duplicate_header": "target_header", "inconsistent_cell_style": "target_signature_digest", "mixed_date_formats": "target_number_format,locale", "blank_zero_semantics": "blank_action,zero_action"}

FINDINGS = "code string, sheet string, location string, details string"


class RepairError(ValueError):
    pass


def covers(ref: Column, row1: Column, row2: Column, col1: Column, col2: Column) -> Column:
    """Whether a range, of its own sheet or with its name, covers a table."""
    plain = F.replace(F.upper(F.regexp_replace(ref, "^.*!", "")), F.lit("$"))
    p = r"^([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?$"
    part = lambda k: F.regexp_extract(plain, p, k)
    from tabulith.operators.write import column_number

    right, bottom = F.when(part(3) != "", part(3)).otherwise(part(1)), F.when(part(4) != "", part(4)).otherwise(part(2))
    inside = (column_number(part(1)) <= col1) & (part(2).try_cast("int") <= row1) & (column_number(right) >= col2) & (bottom.try_cast("int") >= row2)
    return F.coalesce(plain.rlike(p) & inside, F.lit(False))


def tables(cells: DataFrame) -> DataFrame:
    """(sheet, header_row, max_row, max_col): each sheet's header, its first row with two texts, and its working area."""
    full = cells.where("value <> '' or formula is not null")
    rows = full.groupBy("sheet", "row").agg(F.count_if((F.col("kind") == "s") | F.col("formula").isNotNull()).alias("texts"))
    header = rows.groupBy("sheet").agg(F.coalesce(F.min(F.when(F.col("texts") >= 2, F.col("row"))), F.min("row")).alias("header_row"))
    down = health.primary_limit(full, "sheet", "row", health.ROW_GAP).withColumnRenamed("limit", "max_row")
    along = health.primary_limit(full, "sheet", "col", health.COLUMN_GAP).withColumnRenamed("limit", "max_col")
    return header.join(down, "sheet").join(along, "sheet")


def _out(df: DataFrame, code: str, location: Column, **details: Column) -> DataFrame:
    body = F.to_json(F.struct(*[c.alias(k) for k, c in details.items()]), {"ignoreNullFields": "false"}) if details else F.lit("{}")
    return df.select(F.lit(code).alias("code"), "sheet", location.alias("location"), body.alias("details"))


def detected(cells: DataFrame, layout: DataFrame, merges: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """Every finding of one workbook's cells, layout and merged ranges, as (code, sheet, location, details).

    budget: the cells up to which a sheet is scanned for blanks and zeros, a finding beyond; None scans sheets of any size.
    """
    full = cells.where("value <> '' or formula is not null")
    area = tables(cells)
    known = full.join(F.broadcast(area), "sheet")  # a row for each sheet
    texts = known.where("kind = 's' and formula is null and not startswith(value, '=')")
    at = F.col("cell")
    out = _out(health.whitespace_findings(texts), "extra_whitespace", at, current_value=F.col("value"), candidate_value=F.col("candidate"))
    out = out.unionByName(_out(health.invisible_findings(texts), "invisible_characters", at, current_value=F.col("value"), candidate_value=F.col("candidate")))
    numeric = health.numeric_findings(texts.where("row <> header_row"))
    exact = F.when(F.col("digits") <= 15, F.col("candidate_text"))
    out = out.unionByName(_out(numeric, "numeric_text", at, current_value=F.col("value"), candidate_value=exact))
    heads = texts.where("row = header_row").withColumn("k", F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))).where("k <> ''")
    w = Window.partitionBy("sheet", "k").orderBy("col")
    again = heads.withColumns({"n": F.row_number().over(w), "first": F.first("cell").over(w)}).where("n > 1")
    out = out.unionByName(_out(again, "duplicate_header", at, current_header=F.col("value"), current_normalized=F.col("k"), duplicates_coordinate=F.col("first"), header_row=F.col("header_row")))
    inside = known.where("row > header_row and row <= max_row and col <= max_col")
    filled = inside.select("sheet", "row").distinct()
    span = area.where("max_row > header_row + 1").select("sheet", "max_col", F.explode(F.sequence(F.col("header_row") + 1, "max_row")).alias("row"))
    gaps = health.islands(span.join(filled, ["sheet", "row"], "left_anti"), "sheet", "row").join(area, "sheet")
    out = out.unionByName(_out(gaps, "blank_data_rows", F.concat(F.lit("A"), F.col("first").cast("string"), F.lit(":"), letters(F.col("max_col")), F.col("last").cast("string")), first=F.col("first"), last=F.col("last")))
    out = out.unionByName(_out(known.where("row > max_row or col > max_col"), "content_beyond_working_area", at, coordinate=at))
    ranges = merges.join(area, "sheet", "left").withColumn("cells", (F.col("row2") - F.col("row1") + 1) * (F.col("col2") - F.col("col1") + 1)).where(f"row2 > header_row or cells > {WIDE_MERGE}")
    shown = F.concat(letters(F.col("col1")), F.col("row1").cast("string"), F.lit(":"), letters(F.col("col2")), F.col("row2").cast("string"))
    out = out.unionByName(_out(ranges, "abnormal_merged_cells", shown, merged_range=shown))
    column = F.concat(letters(F.col("col")), (F.col("header_row") + 1).cast("string"), F.lit(":"), letters(F.col("col")), F.col("max_row").cast("string"))
    by_column = ["sheet", "col", "header_row", "max_row"]
    forms = inside.where("kind = 'd'").groupBy(*by_column, "number_format").agg(F.array_sort(F.collect_list("cell")).alias("cells")).groupBy(*by_column).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number_format", "cells")))).alias("formats")).where(F.size("formats") > 1)
    out = out.unionByName(_out(forms, "mixed_date_formats", column, formats=F.col("formats")))
    styles = inside.groupBy(*by_column, "style").agg(F.min("cell").alias("sample"), F.count("*").alias("n")).groupBy(*by_column).agg(F.array_sort(F.collect_list(F.struct("style", "sample", "n"))).alias("signatures")).where(F.size("signatures") > 1)
    out = out.unionByName(_out(styles, "inconsistent_cell_style", column, signatures=F.col("signatures")))
    out = out.unionByName(layout_findings(inside, layout, area))
    extent = layout.select("sheet", F.col("max_row").alias("last_row"), F.col("max_col").alias("last_col")).join(area, "sheet").withColumn("declared", F.greatest(F.lit(0), F.col("last_row") - F.col("header_row")) * F.greatest(F.lit(1), F.col("last_col")))
    over = F.concat(F.lit("A"), (F.col("header_row") + 1).cast("string"), F.lit(":"), letters(F.col("last_col")), F.col("last_row").cast("string"))
    small = inside
    if budget is not None:
        out = out.unionByName(_out(extent.where(F.col("declared") > budget), "blank_zero_scan_budget_exceeded", over, declared_cells=F.col("declared"), cell_budget=F.lit(budget)))
        small = inside.join(extent.where(F.col("declared") <= budget).select("sheet"), "sheet", "left_semi")
    zero = (F.col("kind") == "n") & (F.col("value").try_cast("double") == 0)
    held = small.groupBy(*by_column).agg(F.count_distinct("row").alias("used"), F.count_if(zero).alias("n")).where("n > 0 and used < max_row - header_row")
    small = small.join(held.select("sheet", "col"), ["sheet", "col"], "left_semi")  # only their rows are listed
    zeros = small.groupBy(*by_column).agg(F.count_distinct("row").alias("used"), F.array_sort(F.collect_list(F.when(zero, F.col("row")))).alias("zero_rows"), F.array_sort(F.collect_list("row")).alias("rows"))
    both = zeros.where("size(zero_rows) > 0 and used < max_row - header_row")
    named = lambda rows: F.transform(rows, lambda r: F.concat(letters(F.col("col")), r.cast("string")))
    blank = F.array_except(F.sequence(F.col("header_row") + 1, "max_row"), "rows")
    out = out.unionByName(_out(both, "blank_zero_semantics", column, zero_locations=named(F.col("zero_rows")), blank_locations=named(blank)))
    empty = layout.select("sheet").join(full.select("sheet").distinct(), "sheet", "left_anti")
    out = out.unionByName(_out(empty.where(F.trim("sheet").rlike(DEFAULT_SHEET)), "default_empty_sheet", F.lit("A1"), sheet=F.col("sheet")))
    none = layout.groupBy().agg(F.min_by("sheet", "sheet_index").alias("sheet"), F.count("*").alias("n")).join(full.agg(F.count("*").alias("c")), F.lit(True)).where("c = 0")  # one row each
    return out.unionByName(_out(none, "empty_workbook", F.lit("A1"), sheet_count=F.col("n")))


def layout_findings(inside: DataFrame, layout: DataFrame, area: DataFrame) -> DataFrame:
    """Filters, frozen panes and print areas that do not go with the table that was found. inside: its cells (sheet, col)."""
    left = inside.groupBy("sheet").agg(F.min("col").alias("min_col"))
    rows = layout.drop("max_row", "max_col").join(area, "sheet").join(left, "sheet", "left").withColumn("min_col", F.coalesce("min_col", F.lit(1)))
    table = F.concat(letters(F.col("min_col")), F.col("header_row").cast("string"), F.lit(":"), letters(F.col("max_col")), F.col("max_row").cast("string"))
    fits = lambda ref: covers(ref, F.col("header_row"), F.col("max_row"), F.col("min_col"), F.col("max_col"))
    out = _out(rows.where(F.col("filter_ref").isNotNull() & ~fits(F.col("filter_ref"))), "filter_range_mismatch", F.col("filter_ref"), current_ref=F.col("filter_ref"), candidate_ref=table)
    frozen = F.regexp_extract("freeze", r"(\d+)$", 1).try_cast("int")
    below = F.concat(F.lit("A"), (F.col("header_row") + 1).cast("string"))
    out = out.unionByName(_out(rows.where(F.col("freeze").isNotNull() & (frozen != F.col("header_row") + 1)), "freeze_panes_mismatch", F.col("freeze"), current_coordinate=F.col("freeze"), candidate_coordinate=below))
    printed = rows.where((F.size("print_refs") > 0) & ~F.exists("print_refs", fits))
    return out.unionByName(_out(printed, "print_area_mismatch", F.array_join("print_refs", ","), current_refs=F.col("print_refs"), candidate_refs=F.array(table)))


def identified(found: DataFrame) -> DataFrame:
    """found with finding_id, severity and fixability, in the order in which they are reported."""
    out = found.withColumn("finding_id", F.concat(F.lit("finding-"), F.substring(F.sha2(F.concat_ws("\x1f", "code", "sheet", "location", "details"), 256), 1, 20)))
    return out.select("finding_id", "code", F.when(F.col("code") == "default_empty_sheet", "info").otherwise("warning").alias("severity"), "sheet", "location", F.when(F.col("code").isin(*UNSUPPORTED), "unsupported").otherwise("review").alias("fixability"), "details").distinct()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The findings of one workbook; what is no workbook is refused."""
    if not path.lower().endswith((".xlsx", ".xlsm")) or not files.exists(spark, path):
        raise RepairError(f"no workbook: {path}")
    if workbook.metadata(spark, path).first().reason:
        raise RepairError(f"unreadable workbook: {path}")
    return identified(detected(workbook.cells(spark, path), workbook.layout(spark, path), workbook.merges(spark, path)))


def actions(found: DataFrame, content: str) -> DataFrame:
    """(action_id, finding_id, code, operation, sheet, location, classification, status, details): the repair that each finding proposes."""
    operation = F.try_element_at(F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair]), F.col("code"))
    asks = F.col("code").isin(*BASELINES) | ((F.col("code") == "numeric_text") & F.get_json_object("details", "$.candidate_value").isNull())
    status = F.when(F.col("fixability") == "unsupported", "report_only").when(asks, "requires_declared_baseline").otherwise("ready")
    ident = F.concat(F.lit("health-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(content), "finding_id", operation, F.sha2("details", 256)), 256), 1, 20))
    return found.select(ident.alias("action_id"), "finding_id", "code", operation.alias("operation"), "sheet", "location", F.col("fixability").alias("classification"), status.alias("status"), "details")


def action_counts(planned: DataFrame) -> DataFrame:
    """(classification, n)."""
    return planned.groupBy("classification").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Repair:
    """What became of a workbook."""

    output: str | None
    changes: tuple[Mapping[str, Any], ...]
    failures: tuple[str, ...]
    remaining: int


def _baseline(action: Mapping[str, Any], given: Mapping[str, Any] | None) -> Mapping[str, Any]:
    """What a repair sets, from its finding and from what a person declared; what does not fit is refused."""
    about, op = json.loads(action["details"]), action["operation"]
    given = given or {}
    if op in ("declare_date_format", "declare_blank_zero_policy", "rename_duplicate_header") and not given:
        raise RepairError(f"{op} needs a baseline")
    if op == "rename_duplicate_header":
        text = " ".join(str(given.get("target_header") or "").split())
        if not text or text.casefold() == about["current_normalized"]:
            raise RepairError("a new header differs from the repeated one")
        return {"value": text}
    if op == "declare_date_format":
        if not str(given.get("target_number_format") or "").strip() or not str(given.get("locale") or "").strip():
            raise RepairError("a date format and its locale are needed")
        return {"format": given["target_number_format"], "cells": sorted(c for v in about["formats"].values() for c in v)}
    if op == "declare_blank_zero_policy":
        if given.get("blank_action") not in ("preserve", "convert_to_zero") or given.get("zero_action") not in ("preserve", "convert_to_blank"):
            raise RepairError("say what blanks and zeros become")
        writes = {c: 0 for c in about["blank_locations"]} if given["blank_action"] == "convert_to_zero" else {}
        return {"writes": writes | ({c: None for c in about["zero_locations"]} if given["zero_action"] == "convert_to_blank" else {})}
    if op == "convert_numeric_text":
        if about.get("candidate_value") is None:
            if given.get("target_representation") != "preserve_text":
                raise RepairError("a number of so many digits stays a text")
            return {"value": about["current_value"]}
        text = about["candidate_value"]
        return {"value": int(text) if text.lstrip("+-").isdigit() else float(text)}
    if given:
        raise RepairError(f"{op} takes no baseline")
    return {"value": about["candidate_value"]} if "candidate_value" in about else {"ref": about.get("candidate_ref") or about.get("candidate_coordinate") or (about.get("candidate_refs") or [None])[0]}


def applied(content: bytes, chosen: Iterable[Mapping[str, Any]], baselines: Mapping[str, Mapping[str, Any]]) -> tuple[bytes, list[dict[str, Any]], set[tuple[str, str]]]:
    """A copy of a workbook with the chosen repairs, what they changed, and the cells that they were allowed to change."""
    writes: dict[str, list[W.Write]] = {}
    layout: dict[str, dict[str, str]] = {}
    forms: dict[str, dict[str, str]] = {}
    changes, allowed = [], set()
    heads: dict[tuple[str, int, str], str] = {}
    for a in chosen:
        if a["operation"] not in APPLICABLE:
            raise RepairError(f"{a['operation']} is not applied")
        to, sheet = _baseline(a, baselines.get(a["action_id"])), a["sheet"]
        if a["operation"] == "rename_duplicate_header":
            key = sheet, json.loads(a["details"])["header_row"], str(to["value"]).casefold()
            if heads.setdefault(key, a["action_id"]) != a["action_id"]:
                raise RepairError("two headers are renamed alike")
        cells = to.get("writes", {a["location"]: to["value"]} if "value" in to else {})
        for cell, value in cells.items():
            row, col, *_ = workbook.bounds(cell)
            writes.setdefault(sheet, []).append(W.Write(row, col, value))
            allowed.add((sheet, cell))
        if "ref" in to:
            layout.setdefault(sheet, {})[{"align_filter_range": "filter_ref", "align_freeze_panes": "freeze", "align_print_area": "print_ref"}[a["operation"]]] = to["ref"]
        for cell in to.get("cells", ()):
            forms.setdefault(sheet, {})[cell] = to["format"]
            allowed.add((sheet, cell))
        changes.append({"action_id": a["action_id"], "operation": a["operation"], "sheet": sheet, "location": a["location"], "after": to.get("value", to.get("ref", to.get("format")))})
    return W.patched(content, writes, layout, formats=forms), changes, allowed


def unauthorized(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """(sheet, cell) that differ though nobody allowed it. before, after: cells; allowed: (sheet, cell)."""
    what = ["sheet", "cell", "value", "kind", "formula", "number_format"]
    a, b = (df.select(*what).join(allowed, ["sheet", "cell"], "left_anti").where("value <> '' or formula is not null") for df in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("sheet", "cell").distinct()


def failures(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """(finding_id, problem) by health.reconciled, under the names in which they are reported."""
    names = F.create_map(*[F.lit(x) for x in ("not_repaired", "authorized_finding_remains", "vanished", "unauthorized_finding_changed", "new", "new_finding_introduced")])
    return health.reconciled(before.select("finding_id"), after.select("finding_id"), selected.select("finding_id")).withColumn("problem", names[F.col("problem")])


def repair(spark: SparkSession, source: str, target: str, selected: list[str], baselines: Mapping[str, Mapping[str, Any]] | None = None) -> Repair:
    """Apply selected repairs to a copy, scan it again, and keep it only if all of them, and nothing else, happened."""
    if not selected or len(set(selected)) < len(selected) or files.exists(spark, target):
        raise RepairError("select each repair once, and a target that is free")
    content = files.read(spark, source)
    now = hashlib.sha256(content).hexdigest()
    found = scan(spark, source)
    planned = actions(found, now)
    chosen = {r.action_id: r.asDict() for r in planned.where(F.col("action_id").isin(selected)).collect()}  # those that a person named
    unknown = set(selected) - set(chosen)
    if unknown:
        raise RepairError(f"unknown or stale: {', '.join(sorted(unknown))}")
    if any(a["classification"] == "unsupported" for a in chosen.values()):
        raise RepairError("an unsupported finding cannot be repaired")
    copy, changes, allowed = applied(content, [chosen[k] for k in selected], baselines or {})
    beside = f"{target[: target.rfind('.')]}.part{target[target.rfind('.'):]}"
    files.write(spark, beside, copy)
    again = scan(spark, beside)
    picked = spark.createDataFrame([(a["finding_id"],) for a in chosen.values()], "finding_id string")
    wrong = [f"{r.problem}:{r.finding_id}" for r in failures(found, again, picked).collect()]
    may = spark.createDataFrame(sorted(allowed) or [("", "")], "sheet string, cell string")
    wrong += [f"unauthorized_change:{r.sheet}!{r.cell}" for r in unauthorized(workbook.cells(spark, source), workbook.cells(spark, beside), may).collect()]
    if hashlib.sha256(files.read(spark, source)).hexdigest() != now:
        wrong.append("source_changed")
    remaining = again.count()
    if wrong:
        files.delete(spark, beside)
        return Repair(None, tuple(changes), tuple(wrong), remaining)
    files.move(spark, beside, target)
    return Repair(target, tuple(changes), (), remaining)


__all__ = ["OPERATIONS", "APPLICABLE", "RepairError", "actions", "action_counts", "applied", "canonical", "covers", "detected", "digest", "failures", "identified", "layout_findings", "repair", "scan", "tables", "unauthorized"]
