"""Fingerprints of what a run depends on, and whether it has to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component(digests: Column) -> Column:
    """Aggregate: a digest of digests (hexadecimal) that does not depend on their order.

    Their four quarters are added up on their own, with partial sums, and the sums and the count are hashed.
    """
    quarters = [F.sum(F.conv(F.substring(digests, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", F.count(digests).cast("string"), *[q.cast("string") for q in quarters]), 256))


def fingerprints(content: DataFrame, task: str, part: str, digest: str) -> DataFrame:
    """(task, component, digest): of each task's parts."""
    return content.groupBy(F.col(task).alias("task"), F.col(part).alias("component")).agg(component(F.col(digest)).alias("digest"))


def decided(now: DataFrame, last: DataFrame) -> DataFrame:
    """(task, decision): now (task, fingerprint, conflict) against the last run (task, fingerprint, status).

    A connector conflict counts as changed, and so does a task without a run; what is the same but did
    not succeed is tried again.
    """
    b = last.select("task", F.col("fingerprint").alias("before"), "status")
    how = F.when(F.col("conflict"), "changed").when(F.col("before").isNull() | (F.col("before") != F.col("fingerprint")), "changed").when(F.col("status") != "succeeded", "retry").otherwise("no_op")
    return now.join(b, "task", "left").select("task", how.alias("decision"))


def changed_components(now: DataFrame, before: DataFrame) -> DataFrame:
    """(task, component) whose digest differs or that one side lacks."""
    b = before.select("task", "component", F.col("digest").alias("old"))
    return now.join(b, ["task", "component"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("old"))).select("task", "component")
