"""What is wrong with an output, from the cells that were read back.

A finding is a row (code, severity, sheet, row, field, cell, evidence). Cells come from the file as it
is stored, never from the plan that wrote it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith.operators.write import letters
from tabulith.plans.targets import Target

FINDING = "code string, severity string, sheet string, row int, field string, cell string, evidence string"
#: A check of one's own: cells that were read back and the contract, to findings.
Verifier = Callable[[DataFrame, "Contract"], DataFrame]


@dataclass(frozen=True)
class Contract:
    """What an output has to hold."""

    target: Target
    input: int
    accepted: int
    review: int
    written: int
    empty_marker: tuple[str, str] | None = None
    verifiers: tuple[Verifier, ...] = field(default_factory=tuple)


def same_value(left: Column, right: Column) -> Column:
    """Whether two texts of cells say the same: numbers by their value, a moment and a day by the day."""
    a, b = left.try_cast("decimal(38,10)"), right.try_cast("decimal(38,10)")
    day = r"^\d{4}-\d{2}-\d{2}$"
    moment = r"^\d{4}-\d{2}-\d{2}[T ]"
    dated = F.when((left.rlike(day) & right.rlike(moment)) | (left.rlike(moment) & right.rlike(day)), F.substring(left, 1, 10) == F.substring(right, 1, 10))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.coalesce(dated, F.when(a.isNotNull() & b.isNotNull() & ~left.rlike(r"^0\d") & ~right.rlike(r"^0\d"), a == b), empty(left) == empty(right))


def _row(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], FINDING)


def _finding(df: DataFrame, code: str, sheet: Column, row: Column, field_: Column, cell: Column, evidence: Column, severity: str = "error") -> DataFrame:
    text = lambda c: c.cast("string")
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(sheet).alias("sheet"), row.cast("int").alias("row"), text(field_).alias("field"), text(cell).alias("cell"), text(evidence).alias("evidence"))


def header_findings(template: DataFrame, output: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped columns whose header is not the template's. template, output: (destination, sheet, row, col, value)."""
    at = lambda df, name: df.select("destination", "sheet", F.col("row").alias("header_row"), "col", F.col("value").alias(name))
    both = mapping.join(at(template, "want"), ["destination", "sheet", "header_row", "col"], "left").join(at(output, "have"), ["destination", "sheet", "header_row", "col"], "left")
    none = F.lit("")
    bad = both.where(F.coalesce("want", none) != F.coalesce("have", none))
    return _finding(bad, "column_shift", F.col("sheet"), F.col("header_row"), F.col("field"), F.concat(letters(F.col("col")), F.col("header_row").cast("string")), F.concat(F.coalesce("want", none), F.lit(" -> "), F.coalesce("have", none)))


def required_findings(output: DataFrame, rows: DataFrame, required: DataFrame) -> DataFrame:
    """Written rows without a required value. rows: (sheet, row) that were written; required: (sheet, field, col)."""
    need = rows.join(F.broadcast(required), "sheet")  # a few fields
    both = need.join(output.select("sheet", "row", "col", "value"), ["sheet", "row", "col"], "left")
    bad = both.where(F.trim(F.coalesce("value", F.lit(""))) == "")
    return _finding(bad, "missing_required_field", F.col("sheet"), F.col("row"), F.col("field"), F.concat(letters(F.col("col")), F.col("row").cast("string")), F.lit(None))


def duplicate_findings(ids: DataFrame, field_: str = "record_id") -> DataFrame:
    """Rows (sheet, row, cell, value) whose id an earlier row has, with that row."""
    w = Window.partitionBy("sheet", "id").orderBy("row")
    again = ids.withColumn("id", F.trim(F.coalesce("value", F.lit("")))).withColumns({"n": F.row_number().over(w), "first": F.first("row").over(w)}).where("n > 1")
    return _finding(again, "duplicate_record", F.col("sheet"), F.col("row"), F.lit(field_), F.col("cell"), F.concat(F.lit("first at row "), F.col("first").cast("string")))


def value_findings(changed: DataFrame, output: DataFrame) -> DataFrame:
    """Written cells (sheet, row, col, cell, field, new_value) that do not show what was written."""
    both = changed.join(output.select("sheet", "row", "col", F.col("value").alias("have")), ["sheet", "row", "col"], "left")
    bad = both.where(~same_value(F.col("new_value"), F.col("have")))
    return _finding(bad, "written_value_mismatch", F.col("sheet"), F.col("row"), F.col("field"), F.col("cell"), F.lit(None))


def count_findings(spark: SparkSession, c: Contract) -> DataFrame:
    """Stage counts that cannot be."""
    rows = [("invalid_count", "error")] if min(c.input, c.accepted, c.review, c.written) < 0 else []
    rows += [("stage_count_mismatch", "error")] if c.input != c.accepted + c.review else []
    rows += [("written_count_mismatch", "error")] if c.written != c.accepted else []
    return _row(spark, *rows) if rows else spark.createDataFrame([], FINDING)


def verified(output: DataFrame | None, template: DataFrame, changed: DataFrame, mapping: DataFrame, contract: Contract) -> DataFrame:
    """All findings of one target's output.

    output, template: cells (destination, sheet, row, col, cell, value, formula); None where the output
    could not be read. changed: the target's rows of write.changes.
    """
    spark, t = template.sparkSession, contract.target
    found = count_findings(spark, contract)
    if output is None:
        return found.unionByName(_row(spark, ("unreadable_workbook", "error")))
    shown = output.withColumn("value", F.coalesce("formula", "value"))
    if not shown.where(F.col("sheet") == t.sheet).limit(1).count():
        return found.unionByName(_row(spark, ("missing_sheet", "error", t.sheet)))
    mapping = mapping.where(F.col("destination") == t.key)
    own = shown.where(F.col("sheet") == t.sheet)
    done = changed.where("skip is null")
    rows = done.select("sheet", "row").distinct()
    lost = [("unmapped_required_field", "error", t.sheet, None, f) for f in t.required if f not in t.columns]
    if t.record_id_field not in t.columns:
        lost.append(("unmapped_record_id", "error", t.sheet, None, t.record_id_field))
    if lost:
        found = found.unionByName(_row(spark, *lost))
    found = found.unionByName(header_findings(template.withColumn("value", F.coalesce("formula", "value")), shown, mapping))
    known = [(t.sheet, f, t.columns[f]) for f in t.required if f in t.columns]
    if known:
        found = found.unionByName(required_findings(own, rows, spark.createDataFrame(known, "sheet string, field string, col int")))
    if t.record_id_field in t.columns:
        ids = own.where((F.col("col") == t.columns[t.record_id_field]) & (F.col("row") >= t.data_start_row))
        ids = ids.join(rows, ["sheet", "row"], "left_semi")
        found = found.unionByName(duplicate_findings(ids, t.record_id_field))
        want = done.where(F.col("field") == t.record_id_field).select("row", F.col("new_value").alias("want"))
        wrong = want.join(ids.select("row", "value"), "row", "full_outer").where(~F.coalesce(F.col("want") == F.col("value"), F.lit(False))).limit(1)
        found = found.unionByName(_finding(wrong, "record_id_mismatch", F.lit(t.sheet), F.lit(None), F.lit(t.record_id_field), F.lit(None), F.lit(None)))
    if contract.written == 0 and contract.empty_marker:
        name, text = contract.empty_marker
        marked = own.where((F.col("row") == t.data_start_row) & (F.col("col") == t.columns.get(name, 0)) & (F.col("value") == text)).limit(1).count()
        if not marked:
            found = found.unionByName(_row(spark, ("missing_empty_marker", "error", t.sheet, t.data_start_row, name)))
    if t.expected:
        slots = spark.createDataFrame([(e.sheet, e.cell, e.field, str(e.value)) for e in t.expected], "sheet string, cell string, field string, want string")
        found = found.unionByName(period_findings(shown, slots))
    found = found.unionByName(value_findings(done, own))
    for verifier in contract.verifiers:
        try:
            more = verifier(output, contract).select(*[c.split()[0] for c in FINDING.split(", ")])
            more.limit(1).count()  # a check that fails is a finding
        except Exception as e:  # noqa: BLE001
            more = _row(spark, ("verifier_error", "error", None, None, None, None, type(e).__name__))
        found = found.unionByName(more)
    return found


def period_findings(output: DataFrame, slots: DataFrame) -> DataFrame:
    """Declared cells (sheet, cell, field, want) that do not show their period, and those whose sheet is gone."""
    sheets = output.select("sheet").distinct().withColumn("there", F.lit(True))
    both = slots.join(sheets, "sheet", "left").join(output.select("sheet", "cell", F.col("value").alias("have")), ["sheet", "cell"], "left")
    gone = _finding(both.where("there is null"), "missing_period_sheet", F.col("sheet"), F.lit(None), F.col("field"), F.col("cell"), F.lit(None))
    bad = both.where(F.col("there") & ~same_value(F.col("want"), F.col("have")))
    return gone.unionByName(_finding(bad, "period_mismatch", F.col("sheet"), F.regexp_extract("cell", r"(\d+)$", 1), F.col("field"), F.col("cell"), F.lit(None)))


def blocking(findings: DataFrame) -> DataFrame:
    """(blocking): whether any finding is more than a warning; what is not known counts as more."""
    return findings.agg(F.coalesce(F.bool_or(~F.coalesce(F.col("severity") == "warning", F.lit(False))), F.lit(False)).alias("blocking"))


def summary(findings: DataFrame) -> DataFrame:
    """(findings, codes, severities): how many, which codes, how many of each severity. One row, no cell's value."""
    each = findings.groupBy("code", "severity").agg(F.count("*").alias("n"))
    by = each.groupBy("severity").agg(F.sum("n").alias("n"), F.collect_set("code").alias("codes"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"),
    )  # a row for each severity


def problems(findings: DataFrame) -> list[Mapping[str, object]]:
    """The findings as they are reported: as many as there are."""
    return [r.asDict() for r in findings.orderBy("code", "sheet", "row", "field").collect()]
