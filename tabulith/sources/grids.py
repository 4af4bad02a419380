"""Cell grids from CSV files and workbooks, and records from extraction JSON.

A grid is a long table (file, sheet_index, sheet, row, values, kinds, epoch): rows keep their numbers,
blank and ragged ones too, which Spark's CSV reader would not. kinds tells numbers from texts; epoch is
the day from which a workbook counts its dates. Files are read by Spark, one task a file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions import values as V
from tabulith.sources.workbook import UNREADABLE, Book

SCHEMA = "file string, sheet_index int, sheet string, row int, values array<string>, kinds array<string>, epoch string"
#: What load() and grid() read.
GRIDS, JSON = (".csv", ".xlsx", ".xlsm"), ".json"


def _csv_rows(content: bytes) -> Iterator[tuple]:
    for n, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")), 1):
        yield 0, "", n, row, ["s"] * len(row), None


def _workbook_rows(content: bytes) -> Iterator[tuple]:
    book = Book(content)
    for sheet in book.sheets:
        at, values, kinds = None, [], []
        for r, c, value, kind, *_ in book.cells(sheet):
            if r != at and at is not None:
                yield sheet.index, sheet.name, at, values, kinds, book.epoch.isoformat()
                values, kinds = [], []
            at = r
            values += [""] * (c - len(values))
            kinds += [""] * (c - len(kinds))
            values[c - 1], kinds[c - 1] = value, kind
        if at is not None:
            yield sheet.index, sheet.name, at, values, kinds, book.epoch.isoformat()


def grid(spark: SparkSession, path: str) -> DataFrame:
    """The grids of every .csv, .xlsx and .xlsm below a path; other suffixes are refused.

    A file that cannot be read gives one row with sheet_index -1 and the reason as its value.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                low = name.lower()
                try:
                    if low.endswith(".csv"):
                        rows = list(_csv_rows(content))
                    elif low.endswith((".xlsx", ".xlsm")):
                        rows = list(_workbook_rows(content))
                    else:
                        rows = [(-1, "", 0, ["unsupported_extension"], [""], None)]
                except (csv.Error, *UNREADABLE) as e:
                    rows = [(-1, "", 0, [f"unreadable_input: {type(e).__name__}"], [""], None)]
                yield pd.DataFrame([(name, *r) for r in rows], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return raw.select("path", "content").mapInPandas(read, SCHEMA)


_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("location", "event_date", "identifier", "category", "confidence", "source_region", "source_file", "amount", "currency")])
_EXTRACTION = T.StructType([T.StructField("source", T.StringType()), T.StructField("records", T.ArrayType(_RECORD))])


def extraction(spark: SparkSession, path: str) -> DataFrame:
    """Records of extraction JSON files in the contract's fields, with their file and place.

    One without a confidence has 0; items that are no objects are skipped; dates stay as they are
    written. A money text gives amount and currency as in a table; currencies that exclude each other
    are `conflict`.
    """
    raw = spark.read.schema(_EXTRACTION).option("multiLine", "true").json(path)
    named = F.col("_metadata.file_path")
    rows = raw.select(named.alias("file"), F.coalesce("source", F.regexp_extract(named, "([^/]*)$", 1)).alias("from"), F.posexplode("records").alias("pos", "r")).where("r is not null")
    file = F.coalesce("r.source_file", "from")
    region = F.when(F.coalesce("r.source_region", F.lit("")) != "", F.concat(F.lit("@"), "r.source_region")).otherwise("")
    read = F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(read), 0.0).otherwise(read)))
    clean = [F.trim(F.coalesce(f"r.{f}", F.lit(""))).alias(f) for f in ("location", "event_date", "identifier", "category")]
    money = F.col("r.amount")
    return rows.select(
        *clean, confidence.alias("confidence"), F.concat(file, region).alias("source"), file.alias("source_file"), F.lit("").alias("source_sheet"), F.lit(None).cast("int").alias("source_row"), F.coalesce("r.source_region", F.lit("")).alias("source_region"),
        V.amount(money).alias("amount"), V.resolved_currency(V.detected_currency(money), V.currency_evidence(F.col("r.currency"))).alias("currency"), "file", "pos",
    )


def input_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of several inputs, each a file or a folder: by suffix tables or extraction JSON.

    records: the contract's fields, input (the path as given), and row_index (number of the input, file,
    sheet row or place), so that their order is that of the inputs. failures: (input, file, code). An input
    of another suffix is refused before anything is read.
    """
    from tabulith.operators import layout

    every, failed = None, spark.createDataFrame([], "input string, file string, code string")
    for k, path in enumerate(paths):
        low = path.lower()
        if low.endswith(JSON):
            own = extraction(spark, path)
            own = own.withColumn("row_index", F.struct(F.lit(k).alias("input"), F.col("file"), F.col("pos").alias("row"))).drop("file", "pos")
        elif low.endswith(GRIDS) or "." not in low.rstrip("/").rpartition("/")[2]:
            table = grid(spark, path)
            own = layout.records(table)
            own = own.withColumn("row_index", F.struct(F.lit(k).alias("input"), F.col("row_index.file").alias("file"), F.col("row_index.row").alias("row")))
            failed = failed.unionByName(layout.failures(table).select(F.lit(path).alias("input"), "file", F.col("reason").alias("code")))
        else:
            raise ValueError(f"unsupported input: {path}")
        own = own.withColumn("input", F.lit(path))
        every = own if every is None else every.unionByName(own)
    if every is None:
        raise ValueError("no inputs")
    return every, failed
