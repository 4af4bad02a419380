"""Review packs: rows for people to decide, sealed by digests, and what they decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("accept", "correct", "reject", "cannot determine")
SEALED = ("record_id", "source_value", "source_location", "proposed_value", "review_reason", "confidence", "candidates")


def sealed(rows: DataFrame) -> DataFrame:
    """rows with row_digest over the fields that nobody may change."""
    return rows.withColumn("row_digest", F.sha2(F.to_json(F.struct(*SEALED), {"ignoreNullFields": "false"}), 256))


def candidate_list(text: F.Column) -> F.Column:
    """The candidates of a row as they are written: a JSON list of texts; null where it is none."""
    return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})


def pack(outcomes: DataFrame) -> DataFrame:
    """A sealed row for each outcome in review, without a decision yet."""
    open_ = outcomes.where("status = 'review'")
    rows = open_.select(
        "record_id", F.col("location").alias("source_value"), F.col("source").alias("source_location"), F.get("candidates", 0).alias("proposed_value"),
        F.array_join("reasons", ";").alias("review_reason"), F.col("match_confidence").alias("confidence"), F.to_json(F.coalesce("candidates", F.array().cast("array<string>"))).alias("candidates"),
    )
    empty = F.lit(None).cast("string")
    return sealed(rows).select("*", empty.alias("decision"), empty.alias("corrected_value"), empty.alias("note"))


def problems(issued: DataFrame, returned: DataFrame) -> DataFrame:
    """(record_id, problem): rows that are lost, new, repeated or changed, and decisions that are none."""
    again = returned.groupBy("record_id").agg(F.count("*").alias("n"))
    fresh = sealed(returned.drop("row_digest")).select("record_id", F.col("row_digest").alias("now"), "decision", "corrected_value").dropDuplicates(["record_id"])
    both = issued.select("record_id", "row_digest").join(fresh, "record_id", "full_outer").join(again, "record_id", "left")
    what = F.array_compact(
        F.array(
            F.when(F.col("now").isNull(), "missing_row"),
            F.when(F.col("row_digest").isNull(), "unknown_row"),
            F.when(F.col("n") > 1, "repeated_row"),
            F.when(F.col("row_digest") != F.col("now"), "changed_row"),
            F.when(F.col("decision").isNotNull() & ~F.col("decision").isin(*DECISIONS), "unknown_decision"),
            F.when((F.col("decision") == "correct") & (F.coalesce(F.trim("corrected_value"), F.lit("")) == ""), "missing_correction"),
        )
    )
    return both.select("record_id", F.explode(what).alias("problem"))


def confirmations(issued: DataFrame, returned: DataFrame) -> DataFrame:
    """(record_id, target) of accepted and corrected rows; those with a problem confirm nothing."""
    fine = returned.join(problems(issued, returned), "record_id", "left_anti")
    target = F.when(F.col("decision") == "accept", F.col("proposed_value")).when(F.col("decision") == "correct", F.col("corrected_value"))
    return fine.select("record_id", target.alias("target")).where("target is not null")
