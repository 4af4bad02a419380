"""Evidence of a delivery: counts and digests of what went in, what came out and what is really there."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import contract as C
from tabulith.operators import route
from tabulith.plans.targets import Target
from tabulith.sinks import files

FORMAT = "tabulith-manifest-v1"


def persisted_rows(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """(destination, sheet, rows): rows of an output whose id cell is not blank, from what was read back.

    cells: (destination, sheet, row, col, value); ids: (destination, sheet, col, data_start_row).
    """
    own = cells.join(F.broadcast(ids.withColumnRenamed("col", "id_col")), ["destination", "sheet"])  # a row for each target
    own = own.where((F.col("col") == F.col("id_col")) & (F.col("row") >= F.col("data_start_row")) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    return own.groupBy("destination", "sheet").agg(F.count("*").alias("rows"))


def discrepancies(tabs: DataFrame, target_written: DataFrame) -> DataFrame:
    """(destination, problem): sheets whose rows are not those that were written, and targets whose sum is not.

    tabs: (destination, sheet, written, rows); target_written: (destination, written).
    """
    by_sheet = tabs.where("written <> rows").select("destination", F.concat(F.lit("row_count_mismatch:"), "sheet").alias("problem"))
    total = tabs.groupBy("destination").agg(F.sum("rows").alias("rows"))
    both = target_written.join(total, "destination", "left").where("written <> coalesce(rows, 0)")
    return by_sheet.unionByName(both.select("destination", F.lit("written_count_mismatch").alias("problem")))


def document(
    spark: SparkSession, target: Target, output: str, outcomes: DataFrame, tabs: DataFrame, verification: Mapping[str, Any], digests: Mapping[str, str], period: tuple[str, str] | None = None, recipe_version: str | None = None, fingerprint: str | None = None,
) -> dict[str, Any]:
    """The manifest of one delivered file: names, digests, counts; no cell's value, no record's id."""
    counts = route.status_counts(outcomes).first().asDict()
    own = {r.status: r.n for r in route.target_counts(outcomes).where(F.col("target") == target.key).collect()}
    by_input = route.source_counts(outcomes, "input").collect()  # as many as there are inputs
    origins = {r.input: r.origins for r in route.source_origins(outcomes, "input").collect()}
    mine = {r.input: r.n for r in outcomes.where((F.col("status") == "written") & (F.col("destination") == target.key)).groupBy("input").agg(F.count("*").alias("n")).collect()}
    listed = [r.asDict() for r in tabs.where(F.col("destination") == target.key).orderBy("sheet").collect()]
    wrong = [r.problem for r in discrepancies(tabs.where(F.col("destination") == target.key), spark.createDataFrame([(target.key, own.get("written", 0))], "destination string, written long")).orderBy("problem").collect()]
    return {
        "destination": target.key, "output": output, "output_name": output.rpartition("/")[2], "output_hash": files.digest(spark, output), "template": target.template.rpartition("/")[2], "template_version": files.digest(spark, target.template),
        "recipe_version": recipe_version, "run_fingerprint": fingerprint, "period_start": period[0] if period else None, "period_end": period[1] if period else None, "run_counts": counts,
        "target_counts": {s: own.get(s, 0) for s in C.STATUSES if s != "rejected"}, "tabs": listed, "verification": dict(verification), "discrepancies": wrong, "reconciled": not wrong,
        "sources": [{"file": r.input.rpartition("/")[2], "hash": digests.get(r.input), "records": r.records, "written": mine.get(r.input, 0), "statuses": {s: r[s] for s in C.STATUSES}, "origins": origins.get(r.input, [])} for r in by_input],
    }


def path_of(output: str) -> str:
    return f"{output}.manifest.json"


def save(spark: SparkSession, body: Mapping[str, Any]) -> None:
    """Write the manifest beside its output, and the same as lines to read."""
    files.save(spark, path_of(body["output"]), FORMAT, dict(body))
    files.replace(spark, f"{body['output']}.manifest.txt", (text(body) + "\n").encode())


def recovered(spark: SparkSession, output: str) -> dict[str, Any] | None:
    """The manifest beside an output, if it is that of the file which is there now; else None."""
    try:
        body = files.load(spark, path_of(output), FORMAT)
    except files.FormatError:
        return None
    if body is None or body.get("output_name") != output.rpartition("/")[2] or body.get("output_hash") != files.digest(spark, output):
        return None
    return body


def text(body: Mapping[str, Any]) -> str:
    """A manifest as lines."""
    counts = ", ".join(f"{k}={v}" for k, v in body["run_counts"].items())
    span = f"{body['period_start']} to {body['period_end']}" if body.get("period_start") else "none"
    lines = [
        f"Delivery of {body['output_name']} to {body['destination']}", f"  content: {body['output_hash']}", f"  template: {body['template']} ({body['template_version']})", f"  period: {span}", f"  decisions: {body.get('recipe_version') or 'none'}",
        f"  checks: {body['verification'].get('findings', 0)} findings {', '.join(body['verification'].get('codes', []))}".rstrip(), f"  run: {counts}",
    ]
    lines += [f"  from {s['file']}: {s['records']} records, {s['written']} written here ({s['hash']})" for s in body["sources"]]
    lines += [f"  sheet {t['sheet']}: {t['written']} written, {t['rows']} there" for t in body["tabs"]]
    return "\n".join([*lines, "  counts agree with the file" if body["reconciled"] else f"  DIFFERS: {', '.join(body['discrepancies'])}"])
