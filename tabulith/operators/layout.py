"""From cell grids to records: the header row, the sheet, the mapped fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith import contract as C
from tabulith.functions import text as X
from tabulith.functions import values as V


def headers(grid: DataFrame) -> DataFrame:
    """(file, sheet_index, sheet, row, fields): of the first rows those that name all required fields; fields: name to place, the first column counts."""
    known = F.create_map(*[F.lit(x) for f, names in C.FIELD_ALIASES.items() for n in names for x in (n, f)])
    cells = grid.where(F.col("row").between(1, C.HEADER_ROWS)).select("file", "sheet_index", "sheet", "row", F.posexplode("values").alias("pos", "v"))
    named = cells.withColumn("field", F.try_element_at(known, X.header(F.col("v")))).where("field is not null")
    first = named.groupBy("file", "sheet_index", "sheet", "row", "field").agg(F.min("pos").alias("pos"))
    out = first.groupBy("file", "sheet_index", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("fields"))
    return out.where(F.forall(F.array(*map(F.lit, C.REQUIRED)), lambda f: F.map_contains_key("fields", f)))


def layouts(grid: DataFrame) -> DataFrame:
    """(file, sheet_index, sheet, header_row, fields): each file's best sheet and its header, by mapped fields, then records, then place."""
    found = headers(grid)
    best = Window.partitionBy("file", "sheet_index").orderBy(F.desc(F.size("fields")), "row")
    found = found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n").withColumnRenamed("row", "header_row")
    filled = grid.where(F.exists("values", lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    counts = filled.join(found.select("file", "sheet_index", "header_row"), ["file", "sheet_index"]).where("row > header_row").groupBy("file", "sheet_index").agg(F.count("*").alias("records"))
    sheets = found.join(counts, ["file", "sheet_index"], "left")
    pick = Window.partitionBy("file").orderBy(F.desc(F.size("fields")), F.desc(F.coalesce("records", F.lit(0))), "sheet_index")
    return sheets.withColumn("n", F.row_number().over(pick)).where("n = 1").drop("n", "records")


def failures(grid: DataFrame) -> DataFrame:
    """(file, reason) of files without a layout or that could not be read."""
    bad = grid.where("sheet_index < 0").select("file", F.col("values")[0].alias("reason"))
    lost = grid.where("sheet_index >= 0").select("file").distinct().join(layouts(grid), "file", "left_anti").select("file", F.lit("unknown_layout").alias("reason"))
    return bad.unionByName(lost)


def records(grid: DataFrame) -> DataFrame:
    """The records of each file's best sheet, in the contract's fields, with row_index in file order.

    Blank rows are left out; short rows lack the last fields; row numbers are those of the grid. A
    missing confidence column means 1, an unreadable or NaN confidence 0. A number in the date's column
    of a workbook is a day counted from the workbook's epoch.
    """
    rows = grid.join(layouts(grid), ["file", "sheet_index", "sheet"]).where("row > header_row")
    rows = rows.where(F.exists("values", lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    cell = lambda f: F.trim(F.coalesce(F.try_element_at("values", F.try_element_at("fields", F.lit(f)) + 1), F.lit("")))
    kind = F.try_element_at("kinds", F.try_element_at("fields", F.lit("event_date")) + 1)
    dated = F.coalesce(F.when(kind == "n", V.serial_date(cell("event_date"), F.col("epoch"))), V.ingest_date(cell("event_date")))
    name = F.regexp_extract("file", "([^/]*)$", 1)
    read = F.coalesce(cell("confidence").try_cast("double"), F.lit(0.0))
    confidence = F.when(F.map_contains_key("fields", "confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(read), 0.0).otherwise(read)))).otherwise(1.0)
    money = cell("amount")
    sheet = F.when(F.col("sheet") != "", F.concat(F.lit("#"), "sheet")).otherwise("")
    return rows.select(
        cell("location").alias("location"), dated.alias("event_date"), cell("identifier").alias("identifier"), cell("category").alias("category"), confidence.alias("confidence"),
        F.concat(name, sheet, F.lit(":"), F.col("row").cast("string")).alias("source"), name.alias("source_file"), F.col("sheet").alias("source_sheet"), F.col("row").alias("source_row"), F.lit("").alias("source_region"),
        V.amount(money).alias("amount"), V.resolved_currency(V.detected_currency(money), V.currency_evidence(cell("currency"))).alias("currency"), F.struct("file", "row").alias("row_index"),
    )
