"""One terminal state for every record, and the counts that show it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import contract as C
from tabulith.functions.values import review_reasons
from tabulith.operators import match

REJECTS = "^(missing|invalid):"


def reviewed(records: DataFrame, least: float = C.LEAST_CONFIDENCE) -> DataFrame:
    """records with reasons and rejected (a field is missing or invalid)."""
    out = records.withColumn("reasons", review_reasons(least))
    return out.withColumn("rejected", F.exists("reasons", lambda r: r.rlike(REJECTS)))


def routed(records: DataFrame, destinations: DataFrame, confirmations: DataFrame | None = None, existing: DataFrame | None = None, use_fuzzy: bool = True, least: float = C.LEAST_CONFIDENCE) -> DataFrame:
    """records with status, reasons and destination.

    Rejected records are set aside before dedup, so that they never claim a record_id. Accepted are
    those matched without any reason; of these the ones in existing (destination, record_id) are
    skipped_existing.
    """
    told = match.with_record_id(reviewed(records, least))
    good = match.matched(match.first_seen(told.where("not rejected")), destinations, confirmations, use_fuzzy, records)
    good = good.withColumn("reasons", F.array_union("reasons", F.array_compact(F.array("match_reason"))))
    good = good.withColumn("status", F.when((F.col("match_status") == "matched") & (F.size("reasons") == 0), "accepted").otherwise("review"))
    if existing is not None:
        there = existing.select("destination", "record_id", F.lit(True).alias("there")).distinct()
        good = good.join(there, ["destination", "record_id"], "left")
        known = (F.col("status") == "accepted") & F.col("there")
        good = good.withColumn("reasons", F.when(known, F.array(F.lit("already_in_target"))).otherwise(F.col("reasons"))).withColumn("status", F.when(known, "skipped_existing").otherwise(F.col("status"))).drop("there")
    bad = told.where("rejected").withColumns({"status": F.lit("rejected"), "match_status": F.lit("not_matched")})
    return good.unionByName(bad, allowMissingColumns=True)


def status_counts(outcomes: DataFrame) -> DataFrame:
    """One row: the input and each terminal state, 0 where there is none."""
    return outcomes.agg(F.count("*").alias("input"), *[F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES])


def target_counts(outcomes: DataFrame) -> DataFrame:
    """(target, status, n): review counts for each candidate, the rest for the destination."""
    review = outcomes.where("status = 'review'").select(F.explode("candidates").alias("target"), "status")
    rest = outcomes.where("status <> 'review' and destination is not null").select(F.col("destination").alias("target"), "status")
    return review.unionByName(rest).groupBy("target", "status").agg(F.count("*").alias("n"))


def source_counts(outcomes: DataFrame, source: str = "source") -> DataFrame:
    """(source, records, each status)."""
    return outcomes.groupBy(source).agg(F.count("*").alias("records"), *[F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES])


def source_origins(outcomes: DataFrame, source: str, origin: str = "source_file", order: str = "row_index") -> DataFrame:
    """(source, origins): the files that the records of each input name, in the order in which they come first."""
    first = outcomes.where(F.col(origin) != "").groupBy(source, origin).agg(F.min(order).alias("o"))
    return first.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("o", F.col(origin).alias("x")))).alias("l")).select(source, F.transform("l", lambda x: x.x).alias("origins"))


def tab_counts(written: DataFrame, persisted: DataFrame) -> DataFrame:
    """(destination, sheet, written, rows, sources): what the run wrote to each sheet, by input, and what is there.

    written: (destination, sheet, input); persisted: (destination, sheet, rows), counted in what was read back.
    """
    each = written.groupBy("destination", "sheet", "input").agg(F.count("*").alias("n"))
    own = each.groupBy("destination", "sheet").agg(F.sum("n").alias("written"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("input", "n")))).alias("sources"))
    out = own.join(persisted, ["destination", "sheet"], "left")
    return out.select("destination", "sheet", "written", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "sources")


#: Rows of an input, or numbers of an order, that are counted together before they are placed.
PLACED_ROWS = 65_536


def numbered(rows: DataFrame, by: str, order: str, name: str = "n") -> DataFrame:
    """rows with their number (from 1) within by, in the order of a column: a number, or a struct that ends in one.

    Rows are first dealt to stretches of the order and numbered there; the stretches' counts, summed up,
    give where each begins. So a key with a third of all rows is as many tasks' work as it has stretches.
    """
    kind = rows.schema[order].dataType
    if not isinstance(kind.fields[-1].dataType if hasattr(kind, "fields") else kind, T.NumericType):
        raise ValueError(f"{order} is neither a number nor a struct that ends in one")
    if hasattr(kind, "names"):
        *head, last = kind.names
        stretch = F.struct(*[F.col(f"{order}.{h}").alias(h) for h in head], F.floor(F.col(f"{order}.{last}") / PLACED_ROWS).alias(last))
    else:
        stretch = F.floor(F.col(order) / PLACED_ROWS)
    dealt = rows.withColumn("_s", stretch)
    sizes = dealt.groupBy(by, "_s").agg(F.count("*").alias("_n"))
    before = sizes.select(by, "_s", (F.sum("_n").over(Window.partitionBy(by).orderBy("_s")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_s").orderBy(order)))
    same = own[by].eqNullSafe(before[by]) & own["_s"].eqNullSafe(before["_s"])
    return own.join(before, same).select(*[own[c] for c in rows.columns], (F.col("_before") + F.col("_own")).alias(name))


def write_order(outcomes: DataFrame, data_start_row: int = 2) -> DataFrame:
    """Accepted records with the row that each takes in its destination."""
    placed = numbered(outcomes.where("status = 'accepted'"), "destination", "row_index", "target_row")
    return placed.withColumn("target_row", F.col("target_row") + (data_start_row - 1))


def new_records(outcomes: DataFrame, existing: DataFrame) -> DataFrame:
    """Accepted records that existing (destination, record_id) does not hold."""
    return outcomes.where("status = 'accepted'").join(existing.select("destination", "record_id"), ["destination", "record_id"], "left_anti")


def discrepancies(expected: DataFrame, persisted: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Keys whose counts differ, either side missing included."""
    a, b = expected.select(key, F.col(count).alias("expected")), persisted.select(key, F.col(count).alias("persisted"))
    zero = F.lit(0)
    out = a.join(b, key, "full_outer").select(key, F.coalesce("expected", zero).alias("expected"), F.coalesce("persisted", zero).alias("persisted"))
    return out.where("expected <> persisted")
