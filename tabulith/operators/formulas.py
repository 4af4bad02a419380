"""What lookup, sum and date formulas compute, and checks of formula text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.operators.write import column_number, letters

# Error texts, calls to other workbooks, and what spills in some versions only.
ERRORS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NUM!", "#NULL!", "#SPILL!", "#CALC!")
EXTERNAL = r"\[[^\]]+\][^!]*!"
DYNAMIC = r"(?i)(?:^|[^A-Z_])(FILTER|UNIQUE|SORTBY?|SEQUENCE|RANDARRAY)\s*\(|[A-Z]+\d+#"
VERSIONS = ("2016", "2019", "2021", "365")
LEGACY = ("2016", "2019")
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384


class FormulaError(ValueError):
    pass


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """rows with the value of the first row of table that has their key, else an empty text."""
    first = table.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("")))


def sumifs(rows: DataFrame, by: list[str], value: str, where: Column) -> DataFrame:
    """Sums in decimals of the rows of each group that meet a condition."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(where, F.col(value).cast("decimal(38,4)"))), F.lit(0).cast("decimal(38,4)")).alias("total"))


def reconcile(detail: DataFrame, summary: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Keys whose detail does not add up to the summary's value within a tolerance; either side may lack them."""
    a = detail.groupBy(key).agg(F.sum(F.col(value).cast("decimal(38,4)")).alias("detail"))
    b = summary.select(key, F.col(value).cast("decimal(38,4)").alias("summary"))
    out = a.join(b, key, "full_outer")
    return out.where(F.col("detail").isNull() | F.col("summary").isNull() | (F.abs(F.col("detail") - F.col("summary")) > tolerance))


def references(formula: Column) -> Column:
    """Single-cell references of a formula to its own sheet; those that are part of a range are left out."""
    return F.array_distinct(F.transform(F.filter(referred(formula), lambda r: (r.sheet == "") & (r.last == "")), lambda r: r.first))


def referred(formula: Column) -> Column:
    """Every reference of a formula, as struct(sheet, first, last): sheet is empty for its own, last is empty for a single cell."""
    bare = F.regexp_replace(formula, r'"[^"]*"', "")
    whole = r"(?:'(?:[^']|'')+'!|[A-Za-z_][A-Za-z0-9_.]*!)?(?<![A-Za-z0-9_.])\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?(?![A-Za-z0-9_(])"

    def parts(r: Column) -> Column:
        sheet = F.regexp_replace(F.regexp_replace(F.regexp_extract(r, r"^(.*)!", 1), r"^'|'$", ""), "''", "'")
        cells = F.split(F.replace(F.regexp_replace(r, r"^.*!", ""), F.lit("$")), ":")
        return F.struct(sheet.alias("sheet"), cells[0].alias("first"), F.coalesce(F.get(cells, 1), F.lit("")).alias("last"))

    return F.transform(F.regexp_extract_all(bare, F.lit(f"({whole})"), F.lit(1)), parts)


def shape(ref: Column) -> Column:
    """struct(rows, cols) of a bounded range or cell; null where it is none."""
    pattern = r"^\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?$"
    text = F.upper(F.trim(ref))
    part = lambda k: F.regexp_extract(text, pattern, k)
    last = lambda k, first: F.when(part(k) != "", part(k)).otherwise(part(first))
    rows = F.abs(last(4, 2).try_cast("int") - part(2).try_cast("int")) + 1
    cols = F.abs(column_number(last(3, 1)) - column_number(part(1))) + 1
    return F.when(text.rlike(pattern), F.struct(rows.alias("rows"), cols.alias("cols")))


def findings(cells: DataFrame, sheets: list[str], expected_errors: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(sheet, cell, code) of what is wrong with formulas (column formula) and error texts (column value).

    sheets: those of the workbook; expected_errors: (sheet, cell) where an error is meant to stand.
    """
    f, names = F.coalesce("formula", F.lit("")), F.array(*map(F.lit, sheets)) if sheets else F.array().cast("array<string>")
    meant = F.array(*[F.lit(f"{s}!{c}") for s, c in expected_errors]) if expected_errors else F.array().cast("array<string>")
    refs = referred(f)
    lost = F.exists(refs, lambda r: (r.sheet != "") & ~F.array_contains(names, r.sheet))
    row = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    bad = lambda c: (row(c) < 1) | (row(c) > MOST_ROWS) | column_number(F.regexp_extract(c, r"^([A-Z]+)", 1)).isNull()
    outside = F.exists(refs, lambda r: bad(r.first) | ((r.last != "") & bad(r.last)))
    external = f.rlike(EXTERNAL)
    codes = F.array_compact(
        F.array(
            F.when(F.col("value").isin(*ERRORS) & ~F.array_contains(meant, F.concat("sheet", F.lit("!"), "cell")), "formula_error_literal"),
            F.when(external, "external_reference"),
            F.when(F.contains(F.upper(f), F.lit("#REF!")), "broken_reference"),
            F.when(F.regexp_replace(f, r'"[^"]*"', "").rlike(r"#(NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|SPILL!|CALC!)"), "formula_error_token"),
            F.when(f.rlike(DYNAMIC), "unsupported_dynamic_array"),
            F.when(~external & lost, "missing_formula_sheet"),
            F.when(outside, "invalid_formula_range"),
        )
    )
    return cells.select("sheet", "cell", F.explode(codes).alias("code"))


def dependencies(cells: DataFrame) -> DataFrame:
    """(book, cell, needs) of formulas (columns book, sheet, cell, formula): single cells only, both with their sheet."""
    each = cells.where("formula is not null").select("book", "sheet", "cell", F.explode(referred(F.col("formula"))).alias("r")).where("r.last = ''")
    name = lambda sheet, cell: F.concat(sheet, F.lit("!"), cell)
    return each.select("book", name(F.col("sheet"), F.col("cell")).alias("cell"), name(F.when(F.col("r.sheet") == "", F.col("sheet")).otherwise(F.col("r.sheet")), F.col("r.first")).alias("needs")).distinct()


def _cyclic(edges: Iterable[tuple[str, str]]) -> list[str]:
    """The nodes that reach themselves: strongly connected components in one pass, without recursion."""
    ahead: dict[str, list[str]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    out: list[str] = []
    for start in ahead:
        if start in number:
            continue
        todo = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        held.append(start)
        on.add(start)
        while todo:
            node, rest = todo[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    held.append(to)
                    on.add(to)
                    todo.append((to, iter(ahead.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], number[to])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(held.pop())
                        on.discard(group[-1])
                    if len(group) > 1 or node in ahead.get(node, ()):
                        out += group
    return out


def on_cycles(edges: DataFrame) -> DataFrame:
    """(book, cell): cells that depend on themselves, however many steps away. edges: (book, cell, needs).

    References do not leave a workbook, so each workbook is a graph of its own, no larger than the format
    lets it be; its components are found in one task in time that grows with its references.
    """

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        found = _cyclic(zip(rows["cell"].to_pylist(), rows["needs"].to_pylist(), strict=True))
        return pa.table({"book": pa.array([key[0].as_py()] * len(found), rows["book"].type), "cell": pa.array(found, pa.string())})

    kind = edges.schema["book"].dataType.simpleString()
    return edges.select("book", "cell", "needs").groupBy("book").applyInArrow(solve, f"book {kind}, cell string")


def region_findings(cells: DataFrame, anchor: str, region: DataFrame, last_row: int | None = MOST_ROWS) -> DataFrame:
    """(sheet, cell, code, expected) of a region's cells that are not the anchor's formula as it reads there.

    region: (sheet, row, col, cell); cells: (sheet, row, col, cell, value, formula). An anchor without a formula is one finding.
    last_row: of the sheet; None for a table of cells that no workbook bounds.
    """
    at_row, at_col = F.regexp_extract(F.lit(anchor), r"(\d+)$", 1).cast("int"), column_number(F.regexp_extract(F.lit(anchor), r"^([A-Z]+)", 1))
    first = region.select("sheet").distinct().join(cells.where(F.col("cell") == anchor).select("sheet", F.col("formula").alias("model")), "sheet", "left")
    none = first.where("model is null").select("sheet", F.lit(anchor).alias("cell"), F.lit("missing_formula_anchor").alias("code"), F.lit(None).cast("string").alias("expected"))
    both = region.join(first.where("model is not null"), "sheet").join(cells.select("sheet", "row", "col", "value", "formula"), ["sheet", "row", "col"], "left")
    both = both.withColumn("expected", translated(F.col("model"), F.col("row") - at_row, F.col("col") - at_col, last_row))
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    code = F.when(F.col("formula").isNull(), F.when(blank, "formula_fill_gap").otherwise("formula_overwritten_by_constant")).when(F.col("formula") != F.col("expected"), "formula_pattern_mismatch")
    return none.unionByName(both.withColumn("code", code).where("code is not null").select("sheet", "cell", "code", "expected"))


def translated(formula: Column, rows: Column, cols: Column, last_row: int | None = MOST_ROWS) -> Column:
    """A formula as it reads some rows and columns away: what a $ holds stays; texts stay; what falls off the sheet is #REF!.

    last_row: of the sheet; None where its rows have no end.
    """
    token = r"(\"[^\"]*\"|'(?:[^']|'')*'|[A-Za-z_\\.][A-Za-z0-9_\\.]*\(|(?<![A-Za-z0-9_.])\$?[A-Z]{1,3}\$?[0-9]+(?![A-Za-z0-9_(!])|[A-Za-z_][A-Za-z0-9_.]*|[^A-Za-z_\"'$]+|.)"
    cell = r"^(\$?)([A-Z]{1,3})(\$?)([0-9]+)$"

    def moved(p: Column) -> Column:
        part = lambda k: F.regexp_extract(p, cell, k)
        row, col = part(4).try_cast("long") + F.when(part(3) == "$", 0).otherwise(rows), column_number(part(2)) + F.when(part(1) == "$", 0).otherwise(cols)
        inside = (row >= 1) & (F.lit(True) if last_row is None else row <= last_row) & (col >= 1) & (col <= MOST_COLUMNS)
        there = F.concat(part(1), letters(col.cast("int")), part(3), row.cast("string"))
        return F.when(p.rlike(cell), F.when(inside, there).otherwise("#REF!")).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(formula, F.lit(token), F.lit(1)), moved), "")


def filled(anchor: str, row: int, formula: Column, at: Column) -> Column:
    """The anchor's formula as it reads in another row of its column."""
    return translated(formula, at - row, F.lit(0))


def edate(day: Column, months: Column | int) -> Column:
    """The same day some months on, or the last of a shorter month."""
    return F.add_months(day, months)


def runs(history: DataFrame) -> DataFrame:
    """history (task, run, fingerprint, status) with attempt: one more while the fingerprint stays."""
    w = Window.partitionBy("task").orderBy("run")
    new = F.coalesce((F.lag("fingerprint").over(w) != F.col("fingerprint")).cast("int"), F.lit(1))
    out = history.withColumn("streak", F.sum(new).over(w))
    return out.withColumn("attempt", F.row_number().over(Window.partitionBy("task", "streak").orderBy("run"))).drop("streak")


@dataclass(frozen=True)
class Plan:
    """A formula for a target version, and what it rests on."""

    rule: str
    operation: str
    formula: str
    function: str


def _cell(ref: str) -> str:
    import re

    out = ref.strip().upper()
    if not re.fullmatch(r"\$?[A-Z]{1,3}\$?[1-9]\d*", out):
        raise FormulaError(f"no cell: {ref}")
    return out


def _range(ref: str) -> tuple[str, int, int]:
    from tabulith.sources.workbook import bounds

    out = ref.strip().upper()
    try:
        a, b, c, d = bounds(out)
    except ValueError as e:
        raise FormulaError(str(e)) from e
    return out, c - a + 1, d - b + 1


def _sheet(name: str) -> str:
    if not name.strip() or any(c in name for c in "[]:/*?\\"):
        raise FormulaError(f"no sheet name: {name}")
    return "'" + name.strip().replace("'", "''") + "'"


def lookup_fits(looked: Column, returned: Column, legacy: Column) -> Column:
    """Whether two ranges fit a lookup: the first is one row or column, the second as long; for legacy versions it is one too."""

    a, b = shape(looked), shape(returned)
    along = ((a["rows"] == 1) & (a["cols"] == b["cols"])) | ((a["cols"] == 1) & (a["rows"] == b["rows"]))
    flat = (a["rows"] != 1) & (a["cols"] != 1)
    narrow = ~legacy | (((a["rows"] != 1) | (b["rows"] == 1)) & ((a["cols"] != 1) | (b["cols"] == 1)))
    uneven = ((a["rows"] == 1) & (a["cols"] != b["cols"])) | ((a["cols"] == 1) & (a["rows"] != b["rows"]))
    return F.coalesce(along & ~flat & ~uneven & narrow, F.lit(False))


def planned_lookup(rule: str, cell: str, sheet: str, looked: str, returned: str, version: str) -> Plan:
    """The lookup of a cell in a sheet, in the function that a version has; an empty text where nothing is found."""
    if version not in VERSIONS or not rule.strip():
        raise FormulaError("a rule and a known version are needed")
    cell, name = _cell(cell), _sheet(sheet)
    (a, rows, cols), (b, rows2, cols2) = _range(looked), _range(returned)
    if rows != 1 and cols != 1:
        raise FormulaError("the range looked in is one row or column")
    if (rows == 1 and cols2 != cols) or (cols == 1 and rows2 != rows):
        raise FormulaError("the ranges differ in length")
    if version in LEGACY and ((rows == 1 and rows2 != 1) or (cols == 1 and cols2 != 1)):
        raise FormulaError("the range returned is one row or column")
    if version not in LEGACY:
        return Plan(rule.strip(), "lookup", f'=XLOOKUP({cell},{name}!{a},{name}!{b},"",0)', "XLOOKUP")
    found = f"MATCH({cell},{name}!{a},0)"
    return Plan(rule.strip(), "lookup", f'=IFNA(INDEX({name}!{b},{"0," if rows == 1 else ""}{found}),"")', "INDEX/MATCH")


def planned_sum(rule: str, cell: str, sheet: str, criteria: str, summed: str) -> Plan:
    (a, *one), (b, *two) = _range(criteria), _range(summed)
    if one != two or not rule.strip():
        raise FormulaError("the ranges differ in shape")
    return Plan(rule.strip(), "conditional_sum", f"=SUMIFS({_sheet(sheet)}!{b},{_sheet(sheet)}!{a},{_cell(cell)})", "SUMIFS")


def planned_date(rule: str, cell: str, months: int) -> Plan:
    if isinstance(months, bool) or not isinstance(months, int) or not rule.strip():
        raise FormulaError("months are a whole number")
    return Plan(rule.strip(), "date_add", f"=EDATE({_cell(cell)},{months})", "EDATE")


def within(actual: Column, expected: Column, tolerance: Column) -> Column:
    """Whether a calculated value is the expected one: numbers within a tolerance, all else the same text."""
    a, b = actual.try_cast("decimal(38,10)"), expected.try_cast("decimal(38,10)")
    truth = actual.isin("TRUE", "FALSE", "true", "false") | expected.isin("TRUE", "FALSE", "true", "false")
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull() & ~truth, F.abs(a - b) <= tolerance).otherwise(actual == expected), F.lit(False))


def recalculation_findings(expected: DataFrame, calculated: DataFrame, formulas_before: DataFrame) -> DataFrame:
    """(sheet, cell, code) of a recalculated workbook that does not show what an independent calculation says.

    expected: (sheet, cell, value, tolerance); calculated: its cells (sheet, cell, value, formula);
    formulas_before: (sheet, cell, formula) that have to be there still.
    """
    sheets = calculated.select("sheet").distinct().withColumn("there", F.lit(True))
    own = expected.join(sheets, "sheet", "left").join(calculated.select("sheet", "cell", F.col("value").alias("have")), ["sheet", "cell"], "left")
    code = F.when(F.col("there").isNull(), "recalculation_sheet_missing").when(F.col("have").isin(*ERRORS), "recalculated_formula_error").when(~within(F.col("have"), F.col("value"), F.col("tolerance").cast("decimal(38,10)")), "recalculation_mismatch")
    kept = formulas_before.join(sheets, "sheet", "left").join(calculated.select("sheet", "cell", F.col("formula").alias("now")), ["sheet", "cell"], "left")
    lost = F.when(F.col("there").isNull(), "recalculated_formula_sheet_missing").when(~F.col("formula").eqNullSafe(F.col("now")), "recalculated_formula_not_preserved")
    wrong = lambda df, c: df.withColumn("code", c).where("code is not null").select("sheet", "cell", "code")
    found = wrong(own, code).unionByName(wrong(kept, lost))
    if not expected.limit(1).count() and formulas_before.limit(1).count():
        found = found.unionByName(formulas_before.limit(1).select("sheet", "cell", F.lit("recalculation_expectations_missing").alias("code")))
    return found


def summary_findings(detail: DataFrame, summary: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(key, code) of summaries that an independent sum does not confirm. detail: (key, value, formula); summary: the same, one row a key."""
    number = lambda c: c.try_cast("decimal(38,10)")
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    a = detail.groupBy("key").agg(F.sum(F.when(filled, number(F.col("value")))).alias("total"), F.max(F.when(filled & number(F.col("value")).isNull(), 1).otherwise(0)).alias("odd"), F.max(F.col("formula").isNotNull().cast("int")).alias("f"))
    b = summary.select("key", F.col("value").alias("s"), F.col("formula").isNotNull().alias("sf"))
    both = b.join(a, "key", "left")
    code = F.when((F.coalesce("f", F.lit(0)) > 0) | F.col("sf"), "reconciliation_not_computable").when((F.coalesce("odd", F.lit(0)) > 0) | number(F.col("s")).isNull(), "reconciliation_non_numeric").when(
        F.abs(F.coalesce("total", F.lit(0).cast("decimal(38,10)")) - number(F.col("s"))) > tolerance, "summary_reconciliation_mismatch"
    )
    return both.withColumn("code", code).where("code is not null").select("key", "code")
