"""Accepted records as cells of their targets: what is planned, what a template protects, what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith import contract as C

NUMBERS = ("confidence", "amount", "source_row")
#: Why a mapped cell is not written.
MISSING, MERGED, PROTECTED = "missing_field", "merged_non_anchor", "protected_formula"


def letters(col: Column) -> Column:
    """A column's letters from its number."""
    one = lambda k: F.char(F.lit(64) + k)
    a, b, c = F.pmod(col - 1, F.lit(26)) + 1, F.pmod(F.floor((col - 27) / 26), F.lit(26)) + 1, F.floor((col - 703) / 676) + 1
    return F.concat(F.when(col > 702, one(c)).otherwise(""), F.when(col > 26, one(b)).otherwise(""), one(a))


def column_number(ref: Column) -> Column:
    """A column's number from its letters; null where they are none."""
    text = F.upper(F.trim(ref))
    n = F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(text.rlike("^[A-Z]{1,3}$"), F.when(n <= 16_384, n))


def delivered(outcomes: DataFrame) -> DataFrame:
    """outcomes with fields: each deliverable field's name, value and kind (n or s)."""
    value = lambda f: F.col(f).cast("double").cast("string") if f == "confidence" else F.regexp_replace(F.col(f).cast("string"), r"(\.\d*?)0+$", "$1") if f == "amount" else F.col(f).cast("string")
    have = [f for f in ("record_id", *C.RECORD.names) if f in outcomes.columns]
    each = [F.struct(F.lit(f).alias("field"), F.regexp_replace(value(f), r"\.$", "").alias("value"), F.lit("n" if f in NUMBERS else "s").alias("kind")) for f in have]
    return outcomes.withColumn("fields", F.array(*each))


def changes(placed: DataFrame, mapping: DataFrame, template: DataFrame, merges: DataFrame) -> DataFrame:
    """A row for each mapped cell of each placed record, with what stood there and why it may not be written.

    placed: route.write_order's records; mapping: plans.targets.mapping; template: (destination, sheet, row,
    col, value, formula); merges: (destination, sheet, row1, col1, row2, col2). Columns: destination, sheet,
    row, col, cell, field, record_id, source, row_index, previous_value, new_value, kind, skip.
    """
    rows = delivered(placed).select("destination", "record_id", "source", "row_index", "target_row", "fields")
    mapped = rows.join(F.broadcast(mapping), "destination")  # a row for each field of each target
    found = F.get(F.filter("fields", lambda x: x.field == F.col("field")), 0)
    out = mapped.select("destination", "sheet", F.col("target_row").cast("int").alias("row"), "col", "field", "record_id", "source", "row_index", "overwrite", found.alias("x"))
    there = template.select("destination", "sheet", "row", "col", F.coalesce("formula", "value").alias("previous_value"), F.col("formula").isNotNull().alias("is_formula"))
    out = out.join(there, ["destination", "sheet", "row", "col"], "left")
    covered = merges.select("destination", "sheet", F.explode(F.sequence("row1", "row2")).alias("row"), "row1", "col1", "col2")
    followers = covered.select("destination", "sheet", "row", "row1", "col1", F.explode(F.sequence("col1", "col2")).alias("col")).where("not (row = row1 and col = col1)").select("destination", "sheet", "row", "col", F.lit(True).alias("follows")).distinct()
    out = out.join(followers, ["destination", "sheet", "row", "col"], "left")
    skip = F.when(F.col("x").isNull(), MISSING).when(F.col("follows"), MERGED).when(F.col("is_formula") & ~F.col("overwrite"), PROTECTED)
    return out.select(
        "destination", "sheet", "row", "col", F.concat(letters(F.col("col")), F.col("row").cast("string")).alias("cell"), "field", "record_id", "source", "row_index", "previous_value",
        F.col("x.value").alias("new_value"), F.coalesce("x.kind", F.lit("s")).alias("kind"), skip.alias("skip"),
    )


def planned(outcomes: DataFrame, changed: DataFrame, destinations: DataFrame) -> DataFrame:
    """What a run is expected to do to each target: (destination, expected_written, _review, _skipped_existing, _skipped_protected).

    A record with one protected cell is not written at all. Review counts a record for each of its candidates.
    """
    keys = destinations.select(F.col("key").alias("destination"))
    own = outcomes.where("status in ('accepted', 'skipped_existing')").groupBy("destination").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "skipped_existing").alias("expected_skipped_existing"))
    held = outcomes.where("status = 'review'").select(F.explode(F.array_distinct("candidates")).alias("destination")).groupBy("destination").agg(F.count("*").alias("expected_review"))
    stopped = changed.where(F.col("skip").isin(MERGED, PROTECTED)).groupBy("destination").agg(F.count_distinct("row").alias("expected_skipped_protected"))
    out = keys.join(own, "destination", "left").join(held, "destination", "left").join(stopped, "destination", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("destination", zero("accepted"), zero("expected_review"), zero("expected_skipped_existing"), zero("expected_skipped_protected"))
    return out.select("destination", (F.col("accepted") - F.col("expected_skipped_protected")).alias("expected_written"), "expected_review", "expected_skipped_existing", "expected_skipped_protected")


def protected_cells(changed: DataFrame) -> DataFrame:
    """(destination, cell, skip) of the mapped cells that the template does not give up."""
    return changed.where(F.col("skip").isin(MERGED, PROTECTED)).select("destination", "cell", "skip")


def lineage(changed: DataFrame) -> DataFrame:
    """(record_id, destination, sheet, cell, field, value, source) of every cell that is written."""
    return changed.where("skip is null").select("record_id", "destination", "sheet", "cell", "field", F.col("new_value").alias("value"), "source")


def written(outcomes: DataFrame, delivered_to: DataFrame) -> DataFrame:
    """outcomes in which the accepted records of the targets that were delivered (destination) are written."""
    done = delivered_to.select("destination", F.lit(True).alias("_done")).distinct()
    out = outcomes.join(F.broadcast(done), "destination", "left")  # as many as there are targets
    return out.withColumn("status", F.when((F.col("status") == "accepted") & F.coalesce("_done", F.lit(False)), "written").otherwise(F.col("status"))).select(*outcomes.columns)
