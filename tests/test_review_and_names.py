from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tabulith.operators import review
from tabulith.plans import naming


def test_review_pack(spark):
    schema = "record_id string, location string, source string, candidates array<string>, reasons array<string>, match_confidence double, status string"
    rows = [("a", "Nrth", "f:1", ["North"], ["fuzzy_requires_review"], 0.9, "review"), ("b", "S?", "f:2", ["South", "Sound"], ["multiple_destinations"], 0.99, "review"), ("c", "X", "f:3", None, ["no_match"], None, "review"), ("d", "N", "f:4", None, [], None, "accepted")]
    issued = review.pack(spark.createDataFrame(rows, schema)).cache()
    assert issued.count() == 3
    decide = F.when(F.col("record_id") == "a", "accept").when(F.col("record_id") == "b", "correct").otherwise("maybe")
    returned = issued.withColumn("decision", decide).withColumn("corrected_value", F.when(F.col("record_id") == "b", "South"))
    assert [tuple(r) for r in review.problems(issued, returned).collect()] == [("c", "unknown_decision")]
    assert {tuple(r) for r in review.confirmations(issued, returned).collect()} == {("a", "North"), ("b", "South")}
    forged = returned.withColumn("proposed_value", F.lit("Elsewhere"))
    assert {r.problem for r in review.problems(issued, forged).collect()} == {"changed_row", "unknown_decision"}
    assert review.confirmations(issued, forged).count() == 0
    assert {tuple(r) for r in review.problems(issued, returned.where("record_id = 'a'")).collect()} == {("b", "missing_row"), ("c", "missing_row")}


def test_names():
    values = naming.tokens(date(2026, 9, 1), date(2026, 9, 30), date(2026, 10, 2), customer=" Acme/Co ")
    name = naming.rendered("{client}-YYYY-MM_{period_end}.xlsx", {**values, "client": naming.component(values["client"])})
    assert name == "Acme-Co-2026-10_2026-09-30.xlsx"
    assert naming.resolved(name, "x", {}) == naming.Output(name, "new")
    assert naming.resolved(name, "x", {name: "x"}) == naming.Output(name, "identical_noop")
    assert naming.resolved("a.csv", "x", {"a.csv": "y", "a-r2.csv": "z"}) == naming.Output("a-r3.csv", "revision")
    assert naming.verified("a-2026-r2.csv", "a-YYYY.csv", values) and not naming.verified("a-2025.csv", "a-YYYY.csv", values)
    with pytest.raises(naming.NamingError):
        naming.rendered("{nobody}", values)
