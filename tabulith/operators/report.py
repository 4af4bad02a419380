"""Workbooks for people: the four-sheet report, review packs that come back, and exports of what was delivered."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import contract as C
from tabulith.functions import text as X
from tabulith.operators import profile, review, route
from tabulith.plans.targets import Exports
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import workbook

# Sheets and headers.
HEADERS = ["Location", "Event date", "Identifier", "Category", "Confidence", "Source", "Reasons"]
SHEETS = ("Accepted", "Review", "Audit", "Type Inference")
REVIEW, MANIFEST, HISTORY = "Review", "_manifest", "History"
PACK = ["record_id", "source_value", "source_location", "proposed_value", "review_reason", "confidence", "candidates", "decision", "corrected_value", "note"]


class ReportError(ValueError):
    pass


def report_tables(records: DataFrame, least: float = C.LEAST_CONFIDENCE) -> dict[str, DataFrame]:
    """The four sheets as tables: accepted and review records, their counts, and what is inferred of five fields."""
    told = route.reviewed(records, least).withColumn("reasons", F.array_join("reasons", ", "))
    columns = ["location", "event_date", "identifier", "category", "confidence", "source", "reasons"]
    audit = told.agg(F.count("*").alias("total"), F.count_if(F.col("reasons") == "").alias("accepted"), F.count_if(F.col("reasons") != "").alias("review"))
    fields = profile.field_report(profile.inferred(records, ["location", "event_date", "identifier", "category", "amount"], "row_index"))
    return {"Accepted": told.where("reasons = ''").select("row_index", *columns), "Review": told.where("reasons <> ''").select("row_index", *columns), "Audit": audit, "Type Inference": fields}


def write_report(records: DataFrame, path: str, least: float = C.LEAST_CONFIDENCE) -> dict[str, int]:
    """Write the report as a workbook and return its counts; more records than a sheet holds are refused before they are read."""
    spark, made = records.sparkSession, report_tables(records, least)
    counts = made["Audit"].first().asDict()
    if max(counts.values()) >= W.MOST_ROWS:
        raise ReportError("more records than a sheet holds: write the tables instead")
    rows = lambda df: [list(r)[1:] for r in df.orderBy("row_index").collect()]  # noqa: E731 (no more than a sheet holds)
    types = [["Field", "Inferred type", "Confidence", "Locale", "Unit", "Samples", "Low confidence", "Ambiguous", "Leading zero preserved"]]
    for r in made["Type Inference"].orderBy("field").collect():
        types.append([r.field, r.inferred_type, r.confidence, r.locale, r.unit, r.sample_count, r.low_confidence_count, r.ambiguous_count, r.leading_zero_preserved])
    audit = [["Metric", "Value"], ["Total records", counts["total"]], ["Accepted records", counts["accepted"]], ["Review records", counts["review"]]]
    files.replace(spark, path, W.built({"Accepted": [HEADERS, *rows(made["Accepted"])], "Review": [HEADERS, *rows(made["Review"])], "Audit": audit, "Type Inference": types}))
    verify_report(spark, path, counts["total"])
    return counts


def verify_report(spark: SparkSession, path: str, expected: int) -> None:
    """Read a report back: its sheets have to be there, and as many records as went in."""
    rows = {r.sheet: r.n for r in workbook.cells(spark, path).where("row > 1").groupBy("sheet").agg(F.count_distinct("row").alias("n")).collect()}
    sheets = {r.sheet for r in workbook.layout(spark, path).select("sheet").collect()}
    if not {"Accepted", "Review", "Audit"} <= sheets:
        raise ReportError("sheets are missing")
    if rows.get("Accepted", 0) + rows.get("Review", 0) != expected:
        raise ReportError(f"{expected} records went in, others came out")


def write_pack(rows: DataFrame, path: str, history: Iterable[tuple[str, ...]] = ()) -> None:
    """Write review.pack's rows as a workbook: what may be filled in, a hidden sheet of digests, and what was decided before."""
    spark = rows.sparkSession
    issued = rows.select("record_id", "source_value", "source_location", "proposed_value", "review_reason", F.col("confidence").cast("double").alias("confidence"), "candidates", "row_digest").orderBy("record_id")
    if issued.count() >= W.MOST_ROWS:
        raise ReportError("more rows than a sheet holds: write the table instead")
    held = issued.collect()  # no more than a sheet holds, for people to read
    pack = [PACK, *[[*list(r)[:7], None, None, None] for r in held]]
    seals = [["record_id", "row_digest", "confidence"], *[[r.record_id, r.row_digest, None if r.confidence is None else repr(r.confidence)] for r in held]]
    files.replace(spark, path, W.built({REVIEW: pack, HISTORY: [["recorded_at", "record_id", "decision", "corrected_value", "note"], *history], MANIFEST: seals}, hidden=[MANIFEST]))


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(issued, returned) of a pack that came back, for review.problems and review.confirmations."""
    cells = workbook.cells(spark, path)
    heads = {(r.sheet, r.col): r.value for r in cells.where("row = 1").collect()}  # the few headers
    if [heads.get((REVIEW, k)) for k in range(1, len(PACK) + 1)] != PACK or heads.get((MANIFEST, 2)) != "row_digest":
        raise ReportError("this is no review pack")
    at = lambda sheet, names: cells.where((F.col("sheet") == sheet) & (F.col("row") > 1)).groupBy("row").pivot("col", list(range(1, len(names) + 1))).agg(F.first("value")).select(*[F.col(str(k)).alias(n) for k, n in enumerate(names, 1)])
    seals = at(MANIFEST, ["record_id", "row_digest", "exact"])
    rows = at(REVIEW, PACK).withColumn("confidence", F.col("confidence").try_cast("double"))
    exact = seals.select("record_id", F.col("exact").try_cast("double").alias("exact"))
    rows = rows.join(exact, "record_id", "left").withColumn("confidence", F.when(F.abs(F.col("confidence") - F.col("exact")) < 1e-12, F.col("exact")).otherwise(F.col("confidence"))).drop("exact")
    return seals.select("record_id", "row_digest"), rows


def pack_history(decided: DataFrame, recorded_at: str) -> list[tuple[str, ...]]:
    """What a returned pack decided, as lines of the next one's history."""
    rows = decided.where("decision is not null").select("record_id", "decision", "corrected_value", "note").orderBy("record_id").collect()
    return [(recorded_at, r.record_id, r.decision, r.corrected_value or "", r.note or "") for r in rows]


def sheet_csv(rows: Iterable[Iterable[str]]) -> bytes:
    """CSV of a sheet with a byte order mark; no text in it starts a formula."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    for row in rows:
        writer.writerow([f"'{v}" if v[:1] in ("=", "+", "-", "@", "\t", "\r", "\n") and not _number(v) else v for v in row])
    return ("﻿" + out.getvalue()).encode()


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class Artifact:
    format: str
    output: str
    sheets: tuple[str, ...]
    digest: str
    warnings: tuple[str, ...] = ()


def export(spark: SparkSession, source: str, folder: str, asked: Exports) -> list[Artifact]:
    """A delivered workbook in the formats asked for, with what each holds and its digest.

    A csv is one named sheet or a file for each; a formula without a stored value is refused, since a
    csv would show nothing in its place. There is no renderer for pdf here: it is refused.
    """
    stem, content = source.rpartition("/")[2], files.read(spark, source)
    sheets = [r.sheet for r in workbook.layout(spark, source).orderBy("sheet_index").select("sheet").collect()]
    out = []
    for form in asked.formats:
        if form == "pdf":
            raise ReportError("format_export_failed: no renderer")
        if form == "xlsx":
            path = f"{folder}/{stem}"
            if path != source:
                files.replace(spark, path, content)
            out.append(Artifact(form, path, tuple(sheets), files.digest(spark, path)))
            continue
        cells = workbook.cells(spark, source)
        if workbook.uncached_formulas(cells).limit(1).count():
            raise ReportError("format_export_failed: a formula has no stored value")
        chosen = [asked.csv_sheet] if asked.csv_mode == "single-sheet" else sheets
        if not set(chosen) <= set(sheets):
            raise ReportError(f"missing sheet: {asked.csv_sheet}")
        names = {r.sheet: r.file for r in X.sheet_file_names(spark.createDataFrame(list(enumerate(chosen)), "sheet_index int, sheet string")).collect()}
        for sheet in chosen:
            path = f"{folder}/{names[sheet] if asked.csv_mode != 'single-sheet' else stem[: stem.rfind('.')] + '.csv'}"
            files.replace(spark, path, sheet_csv(_grid(cells, sheet)))
            out.append(Artifact(form, path, (sheet,), files.digest(spark, path), ("csv_drops_workbook_features",)))
    return out


def _grid(cells: DataFrame, sheet: str) -> Iterable[list[str]]:
    """A sheet's rows with blank ones in their places: no more than the format holds."""
    rows = cells.where(F.col("sheet") == sheet).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("v")).orderBy("row")
    at, wide = 0, cells.where(F.col("sheet") == sheet).agg(F.max("col")).first()[0] or 0
    for r in rows.toLocalIterator():
        while at < r.row - 1:
            at += 1
            yield [""] * wide
        at = r.row
        yield [r.v.get(c, "") for c in range(1, wide + 1)]


def plan_document(counts: Mapping[str, int], plan: Mapping[str, Mapping[str, int]], blockers: Iterable[str], questions: Iterable[str]) -> dict:
    """A plan as a document that a person can confirm."""
    return {"counts": dict(counts), "targets": {k: dict(v) for k, v in plan.items()}, "blockers": list(blockers), "questions": list(questions)}


def write_plan(spark: SparkSession, path: str, body: Mapping, seen: str | None) -> str:
    """Write a plan unless it changed since it was seen (its digest then, None if there was none); returns the new digest."""
    now = files.digest(spark, path) if files.exists(spark, path) else None
    if now != seen:
        raise ReportError("the plan changed since it was read")
    files.replace(spark, path, (json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
    return files.digest(spark, path)


def prepared(spark: SparkSession, payload: Mapping, base: str, root: str) -> list[str]:
    """What keeps a configuration from being planned: its shape, and paths outside of root."""
    from tabulith.plans import targets as T

    try:
        chosen, options = T.load(payload, base)
    except T.ConfigError as e:
        return [f"invalid_configuration: {e}"]
    out = []
    for path in (*options.inputs, *(t.template for t in chosen), options.staging, options.delivery, *([options.recipe] if options.recipe else [])):
        if not contained(path, root):
            out.append(f"outside_root: {path.rpartition('/')[2]}")
    out += [f"missing_input: {p.rpartition('/')[2]}" for p in options.inputs if contained(p, root) and not files.exists(spark, p)]
    out += [b for t in chosen if contained(t.template, root) for b in T.blockers(t, files.exists(spark, t.template))]
    return out


def contained(path: str, root: str) -> bool:
    """Whether a path, its dots followed, lies in a folder or is it."""
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not parts or parts == [""]:
                return False
            parts.pop()
        elif p not in ("", ".") or not parts:
            parts.append(p)
    plain, top = "/".join(parts), root.rstrip("/")
    return plain == top or plain.startswith(f"{top}/")


__all__ = ["ReportError", "contained", "export", "pack_history", "plan_document", "prepared", "read_pack", "report_tables", "review", "sheet_csv", "verify_report", "write_pack", "write_plan", "write_report"]
