"""Files to outcomes, end to end."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulith.operators import ambiguity, catalog, health, layout, match, publish, route
from tabulith.sources import grids

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    def cell(v):
        return f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS} {REL}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(map(cell, row)) + "</row>" for r, row in rows.items())
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture
def inputs(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    workbook(d / "a.xlsx", {"Instructions": {1: ["read me"]}, "Data": {1: ["Title"], 3: ["Site", "Inspection Date", "Asset ID", "Inspection Type", "Confidence"], 4: ["North Site", "2026-09-08", "A-1", "routine", 1], 5: ["Nrth Site", "2026-09-08", "A-2", "routine", 1]}})
    (d / "b.csv").write_text("preamble\n\nCategory,Code,Address,Date,Score\nroutine,B-1,South Yard,2026/09/08,0.95\nroutine,,South Yard,2026-09-08,0.9\n", encoding="utf-8-sig")
    (d / "bad.csv").write_text("x,y\n1,2\n")
    return d


def test_grids_to_records(spark, inputs):
    grid = grids.grid(spark, str(inputs)).cache()
    rows = {r.source: r for r in layout.records(grid).collect()}
    assert set(rows) == {"a.xlsx#Data:4", "a.xlsx#Data:5", "b.csv:4", "b.csv:5"}
    assert (rows["b.csv:4"].event_date, rows["b.csv:4"].identifier, rows["b.csv:4"].confidence, rows["b.csv:5"].identifier) == ("2026-09-08", "B-1", 0.95, "")
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in layout.failures(grid).collect()] == [("bad.csv", "unknown_layout")]


def test_unreadable_and_unsupported(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"no zip")
    (tmp_path / "y.pdf").write_bytes(b"%PDF")
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in layout.failures(grids.grid(spark, str(tmp_path))).collect()}
    assert got == {"x.xlsx": "unreadable_input: BadZipFile", "y.pdf": "unsupported_extension"}


def test_end_to_end(spark, inputs, tmp_path):
    doc = {"source": "scan.png", "records": [{"location": "North Site", "event_date": "2026-09-09", "identifier": "C-1", "category": "routine", "confidence": 0.99, "source_region": "page=1"}] + 2 * [{"location": "South Yard", "event_date": "2026-09-09", "identifier": "C-2", "category": "routine", "confidence": 0.97}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    tables = layout.records(grids.grid(spark, str(inputs))).withColumn("row_index", F.struct(F.lit(0).alias("input"), F.col("source_file").alias("file"), F.col("source_row").alias("row")))
    scanned = grids.extraction(spark, str(tmp_path / "c.json")).withColumn("row_index", F.struct(F.lit(1).alias("input"), F.col("source_file").alias("file"), F.col("pos").alias("row")))
    records = tables.unionByName(scanned.drop("pos", "file"), allowMissingColumns=True)
    targets = spark.createDataFrame([("North Site", ["N"]), ("South Yard", ["S"])], "key string, aliases array<string>")
    out = route.routed(records, targets).cache()
    counts = route.status_counts(out).first().asDict()
    assert counts == {"input": 7, "written": 0, "accepted": 4, "review": 2, "rejected": 1, "skipped_existing": 0}
    assert sum(v for k, v in counts.items() if k != "input") == counts["input"]
    told = {r.source: (r.status, r.match_status, r.reasons) for r in out.collect() if r.status != "accepted"}
    assert told["a.xlsx#Data:5"] == ("review", "review", ["fuzzy_requires_review"])
    assert told["b.csv:5"] == ("rejected", "not_matched", ["missing:identifier"])
    again = route.routed(records, targets, existing=out.where("status = 'accepted'").select("destination", "record_id"))
    assert route.status_counts(again).first().skipped_existing == 4
    assert out.select("record_id").distinct().count() == 6
    accepted = route.write_order(out).select("record_id", "location", "target_row")
    publish.publish(accepted, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    with pytest.raises(publish.VerificationError):
        publish.publish(accepted.union(accepted.limit(1)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_confirmation_and_fuzzy_never_accepts(spark):
    rows = [(1, "A", "Nrth", "s", False), (2, "B", "Nowhere", "s", False), (3, "C", "North", "s", True)]
    records = spark.createDataFrame(rows, "row_index int, record_id string, location string, source string, duplicate boolean")
    targets = spark.createDataFrame([("North", None), ("South", ["S"])], "key string, aliases array<string>")
    told = spark.createDataFrame([("B", "South")], "record_id string, target string")
    got = {r.record_id: (r.match_status, r.rule, r.destination) for r in match.matched(records, targets, told).collect()}
    assert got == {"A": ("review", "fuzzy_candidate", None), "B": ("matched", "human_confirmation", "South"), "C": ("duplicate", None, None)}


def test_multi_candidate_decisions_never_resolve(spark):
    schema = "key string, candidates array<string>, samples array<string>, affected int, confidence double, recommendation string, seq int"
    items = spark.createDataFrame([("k", ["a", "b"], ["x"], 2, 0.9, None, 1), ("k", ["b", "c"], ["y"], 3, 0.8, None, 2)], schema)
    group = ambiguity.grouped(items)
    row = group.first()
    assert (row.candidates, row.samples, row.affected, row.confidence) == (["a", "b", "c"], ["x", "y"], 5, 0.8)
    run = spark.createDataFrame([("k", "accept", ["a", "b", "c"])], "key string, decision string, candidates array<string>")
    assert ambiguity.decided(group, run, run.limit(0)).first().state == "conflict"


def test_catalog(spark, tmp_path):
    for name, text in {"a.csv": "1", "sub.csv": "1", "pay final.csv": "2", "pay.csv": "3"}.items():
        (tmp_path / name).write_text(text)
    files = catalog.files(spark, str(tmp_path)).cache()
    assert [(r.n, r.representative.rsplit("/", 1)[1]) for r in catalog.duplicate_groups(files).collect()] == [(2, "a.csv")]
    assert [tuple(r) for r in catalog.version_groups(files).collect()] == [("pay", 2, 2)]
    rules = spark.createDataFrame([(1, "pay*", "template"), (2, "*", "input")], "pos int, pattern string, classification string")
    told = catalog.classified(files.withColumn("stable", F.lit(True)), F.lit(None).cast("date"), F.lit(None).cast("date"))
    assert {r.name: r.classification for r in catalog.overridden(told, rules).collect()}["pay.csv"] == "template"


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "sheet string, row int, col int, value string")
    assert health.whitespace_findings(cells).count() == health.blank_zero(cells).count() == health.outliers(cells).count() == 0
