"""Staged writes that are read back before they count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabulith.functions.text import csv_safe
from tabulith.sinks import files


class VerificationError(ValueError):
    def __init__(self, findings: list[str]):
        super().__init__(", ".join(findings))
        self.findings = findings


def findings(expected: DataFrame, persisted: DataFrame, key: str = "record_id") -> list[str]:
    """What is wrong with what was persisted: its count, repeated or changed rows."""
    out = []
    n, m = expected.count(), persisted.count()
    if n != m:
        out.append("written_count_mismatch")
    if persisted.groupBy(key).count().where("count > 1").limit(1).count():
        out.append("duplicate_record")
    lost = expected.select(*expected.columns).exceptAll(persisted.select(*expected.columns)).limit(1).count()
    return [*out, "written_value_mismatch"] if lost else out


def publish(rows: DataFrame, target: str, key: str = "record_id") -> None:
    """Write rows beside the target, read them back, and only then put them in its place.

    The rows are evaluated once: what is compared is the written table and a fingerprint taken of the
    rows while they were written (their count, and the sum of their hashes).
    """
    spark = rows.sparkSession
    staged = f"{target.rstrip('/')}.{uuid.uuid4().hex}.staged"
    seen = Observation()
    rows.observe(seen, *_sums(rows.columns)).write.parquet(staged)
    persisted = spark.read.parquet(staged)
    now = persisted.agg(*_sums(rows.columns)).first().asDict()
    wrong = ["written_count_mismatch"] if now["n"] != seen.get["n"] else []
    wrong += ["duplicate_record"] if persisted.groupBy(key).count().where("count > 1").limit(1).count() else []
    wrong += ["written_value_mismatch"] if now["n"] == seen.get["n"] and now["h"] != seen.get["h"] else []
    if wrong:
        files.delete(spark, staged)
        raise VerificationError(wrong)
    files.swap(spark, staged, target)


def _sums(columns: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias("h")]


def export_csv(rows: DataFrame, target: str) -> None:
    """CSV with a header in which no text starts a formula."""
    text = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    rows.select(*[csv_safe(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(target)


def manifest(outcomes: DataFrame) -> DataFrame:
    """One JSON document for each source: its counts, no cell values."""
    counts = outcomes.groupBy("source_file", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("source_file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("statuses"), F.sum("n").alias("records"))
