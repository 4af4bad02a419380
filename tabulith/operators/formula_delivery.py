"""Formulas of a delivery: written where they are declared, calculated by an engine of one's own, compared with what Spark says."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import formulas, verify
from tabulith.operators.state import digest
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import workbook

#: Calculates a workbook and returns the path of the calculated copy; None where no engine is there.
Recalculator = Callable[[str], str | None]


def contract(rules: Iterable[Mapping[str, Any]]) -> str:
    """What a file's formulas follow from."""
    return digest([dict(r) for r in rules])


def region(spark: SparkSession, sheet: str, ref: str) -> DataFrame:
    """(sheet, row, col, cell) of a range."""
    from tabulith.operators.write import letters

    a, b, c, d = workbook.bounds(ref)
    rows = spark.range(a, c + 1).select(F.lit(sheet).alias("sheet"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(b), F.lit(d))).alias("col"))
    return rows.select("sheet", "row", "col", F.concat(letters(F.col("col")), F.col("row").cast("string")).alias("cell"))


def planned(spark: SparkSession, rule: Mapping[str, Any]) -> DataFrame:
    """(sheet, row, col, cell, formula) of a rule (sheet, range, formula as it reads in the range's first cell)."""
    if not str(rule.get("formula") or "").startswith("=") or not rule.get("sheet") or not rule.get("range"):
        raise formulas.FormulaError("a rule has a sheet, a range and a formula")
    try:
        row, col, *_ = workbook.bounds(str(rule["range"]))
    except ValueError as e:
        raise formulas.FormulaError(str(e)) from e
    return region(spark, rule["sheet"], rule["range"]).withColumn("formula", formulas.translated(F.lit(rule["formula"]), F.col("row") - row, F.col("col") - col))


def applied(spark: SparkSession, path: str, rules: Iterable[Mapping[str, Any]], recalculate: Recalculator | None = None) -> dict[str, Any]:
    """Write the rules' formulas into a workbook, and where values are expected (a rule's `expected`: cell to value), compare.

    The evidence says `verified` only if an engine calculated the file, kept every formula, and showed
    each expected value; rules without an engine are `not_calculated`, anything wrong is an error.
    """
    rules = [dict(r) for r in rules]
    cells = None
    for rule in rules:
        own = planned(spark, rule)
        cells = own if cells is None else cells.unionByName(own)
    rows = cells.collect()  # no more than a sheet holds
    writes: dict[str, list[W.Write]] = {}
    for r in rows:
        writes.setdefault(r.sheet, []).append(W.Write(r.row, r.col, r.formula))
    try:
        files.replace(spark, path, W.patched(files.read(spark, path), writes))
    except KeyError as e:
        raise formulas.FormulaError(str(e)) from e
    done = recalculate(path) if recalculate else None
    evidence = {"contract": contract(rules), "rules": len(rules), "cells": len(rows), "status": "not_calculated"}
    if done is None:
        return evidence
    wanted = [(r["sheet"], c, str(v), str(r.get("tolerance", 0))) for r in rules for c, v in (r.get("expected") or {}).items()]
    expected = spark.createDataFrame(wanted, "sheet string, cell string, value string, tolerance string")
    wrong = sorted({r.code for r in formulas.recalculation_findings(expected, workbook.cells(spark, done), cells.select("sheet", "cell", "formula")).collect()})
    if wrong:
        raise formulas.FormulaError(", ".join(wrong))
    return evidence | {"status": "verified"}


def verifier(regions: Iterable[tuple[str, str]] = (), expected_errors: tuple[tuple[str, str], ...] = (), not_calculated: bool = True) -> verify.Verifier:
    """A check of an output's formulas: their text, their cycles, and that declared regions (sheet, range) hold their first cell's formula."""

    def check(cells: DataFrame, about: verify.Contract) -> DataFrame:
        spark = cells.sparkSession
        sheets = [r.sheet for r in cells.select("sheet").distinct().collect()]
        found = formulas.findings(cells, sheets, expected_errors).select("sheet", "cell", "code")
        loops = formulas.on_cycles(formulas.dependencies(cells.withColumn("book", F.lit(0)))).select(F.regexp_extract("cell", "^(.*)!", 1).alias("sheet"), F.regexp_extract("cell", "([^!]*)$", 1).alias("cell"), F.lit("circular_reference").alias("code"))
        found = found.unionByName(loops)
        for sheet, ref in regions:
            if sheet not in sheets:
                found = found.unionByName(spark.createDataFrame([(sheet, ref, "missing_formula_region_sheet")], "sheet string, cell string, code string"))
                continue
            found = found.unionByName(formulas.region_findings(cells, ref.partition(":")[0], region(spark, sheet, ref)).select("sheet", "cell", "code"))
        out = found.withColumn("severity", F.lit("error"))
        if not_calculated:
            any_ = cells.where("formula is not null").limit(1).select(F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"), F.lit("recalculation_not_verified").alias("code"), F.lit("warning").alias("severity"))
            out = out.unionByName(any_)
        none = F.lit(None).cast("string")
        return out.select("code", "severity", "sheet", F.regexp_extract("cell", r"(\d+)$", 1).try_cast("int").alias("row"), none.alias("field"), "cell", none.alias("evidence"))

    return check
