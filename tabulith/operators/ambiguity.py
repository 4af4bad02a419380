"""Open questions grouped, and saved decisions applied to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith import contract as C


def _first(items: DataFrame, what: str, most: int | None = None) -> DataFrame:
    """(key, values, n): the distinct values of arrays in the order in which they came, the first `most` of them, and how many there are.

    Repeated values are one before anything is gathered, and a group sends no more than `most` of them.
    """
    each = items.select("key", "seq", F.posexplode(what).alias("p", "x")).groupBy("key", "x").agg(F.min(F.struct("seq", "p")).alias("o"))
    n = each.groupBy("key").agg(F.count("*").alias("n"))
    if most is not None:
        each = each.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("o"))).where(F.col("r") <= most)
    rows = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("l"))
    return rows.join(n, "key").select("key", F.transform("l", lambda r: r.x).alias("values"), "n")


def grouped(items: DataFrame) -> DataFrame:
    """items (key, candidates, samples, affected, confidence, recommendation, seq) as one row for each key.

    Candidates join in order; of the samples the first five distinct stay, with their number; affected
    adds up; the least confidence counts; a recommendation stays only if all give the same.
    """
    same = F.when((F.count("recommendation") == F.count("*")) & (F.count_distinct("recommendation") == 1), F.min("recommendation"))
    out = items.groupBy("key").agg(F.sum("affected").alias("affected"), F.min("confidence").alias("confidence"), same.alias("recommendation"))
    candidates = _first(items, "candidates").select("key", F.col("values").alias("candidates"))
    samples = _first(items, "samples", C.SAMPLES).select("key", F.col("values").alias("samples"), F.col("n").alias("n_samples"))
    none = F.array().cast("array<string>")
    out = out.join(candidates, "key", "left").join(samples, "key", "left")
    return out.select("key", F.coalesce("candidates", none).alias("candidates"), F.coalesce("samples", none).alias("samples"), F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), "affected", "confidence", "recommendation")


def question(status: Column, candidates: Column) -> Column:
    """The key of an open question: its kind and what competes, not the row's value, so that rows and runs share it."""
    return F.concat_ws("|", status, F.array_join(candidates, ","))


def from_outcomes(outcomes: DataFrame) -> DataFrame:
    """One item for each outcome that candidates leave open; its key names them, not the row's value."""
    open_ = outcomes.where("match_status in ('review', 'conflict') and size(candidates) > 0")
    names = F.array_sort("candidates")
    return open_.select(
        question(F.col("match_status"), names).alias("key"), names.alias("candidates"), F.array("location").alias("samples"), F.lit(1).alias("affected"),
        F.col("match_confidence").alias("confidence"), F.when((F.col("match_status") == "review") & (F.size("candidates") == 1), F.col("candidates")[0]).alias("recommendation"), F.col("row_index").alias("seq"),
    )


def decided(groups: DataFrame, run: DataFrame, project: DataFrame) -> DataFrame:
    """groups with decision and state; run and project: (key, decision, candidates).

    A decision of this run comes before a saved one. It holds if it was made over the same candidates
    and something was recommended; else the state is conflict. Without one the state is pending; the
    decision `unknown` stays unknown.
    """
    a = run.select("key", F.struct("decision", "candidates").alias("now"))
    b = project.select("key", F.struct("decision", "candidates").alias("saved"))
    out = groups.join(a, "key", "left").join(b, "key", "left").withColumn("d", F.coalesce("now", "saved"))
    same = F.array_sort("d.candidates") == F.array_sort("candidates")
    state = F.when(F.col("d").isNull(), "pending").when(F.col("d.decision") == "unknown", "unknown").when(~same | F.col("recommendation").isNull(), "conflict").otherwise("resolved")
    return out.select("key", "candidates", "samples", "affected", "confidence", "recommendation", F.col("d.decision").alias("decision"), state.alias("state"))


def _open(outcomes: DataFrame) -> DataFrame:
    asked = F.col("match_status").isin("review", "conflict") & (F.size("candidates") > 0)
    return outcomes.withColumn("question", F.when(asked, question(F.col("match_status"), F.array_sort("candidates"))))


def confirmations(outcomes: DataFrame, batch: DataFrame, destinations: DataFrame) -> DataFrame:
    """(record_id, target) of the records whose question a decision resolved to a destination that there is."""
    told = batch.where("state = 'resolved' and decision <> 'unknown'").select(F.col("key").alias("question"), F.col("decision").alias("target"))
    told = told.join(destinations.select(F.col("key").alias("target")), "target", "left_semi")
    return _open(outcomes).join(told, "question").select("record_id", "target").distinct()


def blocked(outcomes: DataFrame, batch: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """outcomes in which no record with an open question is accepted: it is in review, without a destination, and says so.

    asked: the outcomes in which the questions were put, where decisions have been applied to these since.
    """
    still = batch.where("state in ('pending', 'unknown', 'conflict')").select(F.col("key").alias("question"))
    ids = _open(asked if asked is not None else outcomes).join(still, "question", "left_semi").select("record_id").distinct().withColumn("_open", F.lit(True))
    out = outcomes.join(ids, "record_id", "left")
    hit = F.coalesce("_open", F.lit(False)) & (F.col("status") != "rejected")
    changed = {"reasons": F.when(hit, F.array_union("reasons", F.array(F.lit("unresolved_ambiguity")))).otherwise(F.col("reasons")), "destination": F.when(~hit, F.col("destination")), "status": F.when(hit, "review").otherwise(F.col("status"))}
    return out.withColumns(changed).select(*outcomes.columns)


#: Answers that are none.
UNKNOWN = ("", "unknown", "cannot determine", "不知道")


def decision(selected: str | None, candidates: list[str], allow_custom: bool = False) -> str:
    """What an answer says: one of the candidates, `unknown`, or where it is allowed another text; else it is refused."""
    text = (selected or "").strip()
    if text.casefold() in UNKNOWN:
        return "unknown"
    if text not in candidates and not allow_custom:
        raise ValueError(f"{text} is none of the candidates")
    return text


def review_rows(groups: DataFrame) -> DataFrame:
    """Rows for a review pack, one for each open question."""
    empty = F.lit(None).cast("string")
    rows = groups.select(
        F.concat(F.lit("ambiguity:"), "key").alias("record_id"), F.array_join("samples", ", ").alias("source_value"), F.concat(F.lit("field:destination")).alias("source_location"), F.col("recommendation").alias("proposed_value"),
        F.concat(F.col("key"), F.lit("; affected="), F.col("affected").cast("string")).alias("review_reason"), "confidence", F.to_json("candidates").alias("candidates"),
    )
    return rows.select("*", empty.alias("decision"), empty.alias("corrected_value"), empty.alias("note"))
