"""Workbook-health detectors over a long table of cells (sheet, row, col, value, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions import text as X

# Invisible characters, numbers as texts, gaps that end a working area.
INVISIBLE = r"[ \p{Cc}\p{Cf}&&[^\t\n\r]]"
NUMERIC = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?$"
ROW_GAP, COLUMN_GAP = 50, 10


def whitespace(value: Column) -> Column:
    """struct(leading, trailing, repeated, candidate) of a text's white space."""
    repeated = value.rlike(r"(?<=\S) {2,}(?=\S)")
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.struct(
        (F.length(value) - F.length(F.regexp_replace(value, r"^\s+", ""))).alias("leading"), (F.length(value) - F.length(F.regexp_replace(value, r"\s+$", ""))).alias("trailing"),
        repeated.alias("repeated"), F.regexp_replace(trimmed, r"(?<=\S) {2,}(?=\S)", " ").alias("candidate"),
    )


def whitespace_findings(cells: DataFrame) -> DataFrame:
    """cells whose text begins or ends with white space or repeats spaces within."""
    out = cells.where("value is not null and not startswith(value, '=')").withColumn("w", whitespace(F.col("value")))
    return out.where("w.leading > 0 or w.trailing > 0 or w.repeated").select(*cells.columns, "w.leading", "w.trailing", "w.repeated", "w.candidate")


def invisible_findings(cells: DataFrame) -> DataFrame:
    """cells that hold invisible characters, and the text without them."""
    return cells.where(F.col("value").rlike(INVISIBLE) & ~F.startswith("value", F.lit("="))).withColumn("candidate", F.regexp_replace("value", INVISIBLE, ""))


def numeric_text(value: Column) -> Column:
    """Whether a text is a number that no leading zero marks as a code."""
    plain = F.trim(value)
    return plain.rlike(NUMERIC) & ~plain.rlike(r"^[+-]*0\d")


def significant_digits(value: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.trim(value), r"[^0-9]", ""), "^0+", "")
    return F.greatest(F.length(digits), F.lit(1))


def canonical_decimal(value: Column) -> Column:
    """A decimal's text without an exponent or trailing zeros."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def numeric_findings(cells: DataFrame) -> DataFrame:
    """cells with a number as text, its significant digits, and what it would be: as an exact text and as a number.

    Beyond fifteen digits only the text is exact, so there is no candidate. A percentage is a hundredth of its number.
    """
    plain = F.regexp_replace(F.trim("value"), "[,%+]", "").try_cast("decimal(38,18)")
    share = F.when(F.endswith(F.trim("value"), F.lit("%")), (plain / 100).cast("decimal(38,18)")).otherwise(plain)
    out = cells.where(numeric_text(F.col("value"))).withColumn("digits", significant_digits(F.col("value")))
    out = out.withColumn("candidate_text", F.when(F.col("digits") <= 15, canonical_decimal(share)))
    return out.withColumn("candidate", F.col("candidate_text").cast("double"))


def same_number(left: Column, right: Column) -> Column:
    """Whether two numbers' texts are one number: whole numbers and fractions of the same value are; beyond fifteen digits none is sure."""
    a, b = left.try_cast("decimal(38,18)"), right.try_cast("decimal(38,18)")
    sure = (significant_digits(left) <= 15) & (significant_digits(right) <= 15)
    return F.coalesce((a == b) & sure, F.lit(False))


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """(sheet, col, header, first_col) of headers that an earlier column of the sheet has too."""
    keyed = headers.withColumn("k", X.header(F.col("value"))).where("k <> ''")
    w = Window.partitionBy("sheet", "k").orderBy("col")
    out = keyed.withColumns({"n": F.row_number().over(w), "first_col": F.first("col").over(w)})
    return out.where("n > 1").select("sheet", "col", F.col("k").alias("header"), "first_col")


def islands(rows: DataFrame, group: str, index: str) -> DataFrame:
    """(group, first, last) of runs of consecutive numbers."""
    w = Window.partitionBy(group).orderBy(index)
    return rows.select(group, index).distinct().withColumn("g", F.col(index) - F.row_number().over(w)).groupBy(group, "g").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("g")


def primary_limit(used: DataFrame, group: str, index: str, gap: int) -> DataFrame:
    """(group, limit): the last number before the first gap wider than `gap`, else the last."""
    w = Window.partitionBy(group).orderBy(index)
    out = used.select(group, index).distinct().withColumn("next", F.lead(index).over(w))
    return out.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("next") - F.col(index) > gap, F.col(index))), F.max(index)).alias("limit"))


def outliers(cells: DataFrame, gap: int = ROW_GAP) -> DataFrame:
    """cells beyond the sheet's working area."""
    limit = primary_limit(cells, "sheet", "row", gap)
    return cells.join(limit, "sheet").where(F.col("row") > F.col("limit"))


def blank_zero(cells: DataFrame) -> DataFrame:
    """(sheet, col, blanks, zeros) of columns that hold both."""
    text = F.trim("value")
    blank = F.col("value").isNull() | (text == "")
    zero = text.rlike(r"^[+-]?0+(\.0+)?$")
    return cells.groupBy("sheet", "col").agg(F.count_if(blank).alias("blanks"), F.count_if(zero).alias("zeros")).where("blanks > 0 and zeros > 0")


def mixed_formats(cells: DataFrame, form: str = "number_format") -> DataFrame:
    """(sheet, col, formats) of columns with more than one format."""
    return cells.groupBy("sheet", "col").agg(F.array_sort(F.collect_set(form)).alias("formats")).where(F.size("formats") > 1)


def merged_followers(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells inside a merged range (sheet, row1, col1, row2, col2) and not at its first place, by an equi-join on the rows that it covers."""
    spread = merges.withColumn("row", F.explode(F.sequence("row1", "row2")))
    hit = cells.join(spread, ["sheet", "row"]).where("col between col1 and col2 and not (row = row1 and col = col1)")
    return hit.select(*[cells[c] if c not in ("sheet", "row") else F.col(c) for c in cells.columns])


def reconciled(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """(finding_id, problem): selected findings have to be gone, the others to remain, and none to be new."""
    flags = [before.select("finding_id", F.lit(1).alias("b"), F.lit(0).alias("a"), F.lit(0).alias("s")), after.select("finding_id", F.lit(0), F.lit(1), F.lit(0)), selected.select("finding_id", F.lit(0), F.lit(0), F.lit(1))]
    all_ = flags[0].union(flags[1]).union(flags[2]).groupBy("finding_id").agg(F.max("b").alias("b"), F.max("a").alias("a"), F.max("s").alias("s"))
    problem = F.when((F.col("b") == 0) & (F.col("a") == 1), "new").when((F.col("s") == 1) & (F.col("a") == 1), "not_repaired").when((F.col("s") == 0) & (F.col("b") == 1) & (F.col("a") == 0), "vanished")
    return all_.withColumn("problem", problem).where("problem is not null").select("finding_id", "problem")
