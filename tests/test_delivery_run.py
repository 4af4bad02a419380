"""A whole delivery: inputs to verified workbooks, evidence, and runs that have nothing to do."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabulith.operators import deliver, formula_delivery, manifest, report, state, verify, write
from tabulith.plans import targets as T
from tabulith.sinks import files
from tabulith.sinks import workbook as W
from tabulith.sources import workbook

FIELDS = ["record_id", "location", "event_date", "identifier", "category", "source"]


def template(path, header=("ID", "Location", "Date", "Identifier", "Category", "Source"), sheet="Data", extra=None):
    path.write_bytes(W.built({"Cover": [["Report"]], sheet: [list(header), *(extra or [])]}))


@pytest.fixture
def config(tmp_path):
    d = tmp_path
    (d / "a.xlsx").write_bytes(W.built({"Instructions": [["read me"]], "Data": [["Title"], [], ["Site", "Inspection Date", "Asset ID", "Inspection Type", "Confidence"], ["North Site", "2026-09-08", "A-1", "routine", 1], ["Nrth Site", "2026-09-08", "A-2", "routine", 1]]}))
    (d / "b.csv").write_text("preamble\n\nCategory,Code,Address,Date,Score\nroutine,B-1,South Yard,2026/09/08,0.95\nroutine,,South Yard,2026-09-08,0.9\n", encoding="utf-8-sig")
    rows = [{"location": "North Site", "event_date": "2026-09-09", "identifier": "C-1", "category": "routine", "confidence": 0.99, "source_region": "page=1"}] + 2 * [{"location": "South Yard", "event_date": "2026-09-09", "identifier": "C-2", "category": "routine", "confidence": 0.97}]
    (d / "c.json").write_text(json.dumps({"source": "scan.png", "records": rows}))
    template(d / "north.xlsx")
    template(d / "south.xlsx", ("Source", "Category", "Identifier", "Date", "Location", "ID"))
    return {
        "inputs": ["a.xlsx", "b.csv", "c.json"], "staging_dir": "staging", "delivery_dir": "out", "recipe": "recipe.json",
        "targets": [
            {"key": "North Site", "aliases": ["N"], "template": "north.xlsx", "sheet": "Data", "field_columns": dict(zip(FIELDS, "ABCDEF", strict=True)), "required_fields": ["location", "identifier"]},
            {"key": "South Yard", "aliases": ["S"], "template": "south.xlsx", "sheet": "Data", "field_columns": dict(zip(FIELDS, "FEDCBA", strict=True)), "required_fields": ["location", "identifier"]},
        ],
    }


def shown(spark, path, sheet="Data"):
    return {r.cell: r.value for r in workbook.cells(spark, str(path)).where(F.col("sheet") == sheet).collect()}


def test_seven_records_four_written(spark, config, tmp_path):
    base, kept = str(tmp_path), str(tmp_path / "state/runs.json")
    plan = deliver.deliver(spark, config, base, dry_run=True, state_path=kept)
    assert plan.status == "dry_run" and not (tmp_path / "out").exists() and not (tmp_path / "state").exists()
    assert plan.plan["North Site"] == {"expected_written": 2, "expected_review": 1, "expected_skipped_existing": 0, "expected_skipped_protected": 0}
    run = deliver.deliver(spark, config, base, state_path=kept, period=("2026-09-01", "2026-09-30"))
    assert run.status == "delivered" and run.targets == {"North Site": "delivered", "South Yard": "delivered"}
    assert run.counts == {"input": 7, "written": 4, "accepted": 0, "review": 2, "rejected": 1, "skipped_existing": 0}
    north, south = shown(spark, tmp_path / "out/North Site.xlsx"), shown(spark, tmp_path / "out/South Yard.xlsx")
    assert (north["B2"], north["D2"], north["D3"], north["A1"]) == ("North Site", "A-1", "C-1", "ID") and "A4" not in north
    assert (south["E2"], south["D2"], south["C2"]) == ("South Yard", "2026-09-08", "B-1")
    body = manifest.recovered(spark, str(tmp_path / "out/North Site.xlsx"))
    assert body["reconciled"] and body["target_counts"] == {"written": 2, "accepted": 0, "review": 1, "skipped_existing": 0} and body["tabs"][0]["rows"] == 2
    assert {s["file"]: (s["records"], s["written"]) for s in body["sources"]} == {"a.xlsx": (2, 1), "b.csv": (2, 0), "c.json": (3, 1)}
    assert body["verification"]["codes"] == [] and "A-1" not in json.dumps(body) and "counts agree" in (tmp_path / "out/North Site.xlsx.manifest.txt").read_text()
    again = deliver.deliver(spark, config, base, state_path=kept, period=("2026-09-01", "2026-09-30"))
    assert again.status == "no_op" and again.verdict.reason == "unchanged_since_successful_run"
    (tmp_path / "b.csv").rename(tmp_path / "b2.csv")
    config["inputs"][1] = "b2.csv"
    assert deliver.deliver(spark, config, base, state_path=kept, period=("2026-09-01", "2026-09-30")).status == "no_op"
    (tmp_path / "b2.csv").write_text("Category,Code,Address,Date,Score\nroutine,B-9,South Yard,2026/09/10,0.95\n")
    more = deliver.deliver(spark, config, base, state_path=kept, period=("2026-09-01", "2026-09-30"))
    assert more.verdict.changed == ("inputs",) and more.counts["skipped_existing"] == 3 and more.counts["written"] == 1


def test_answers_and_what_stays_open(spark, config, tmp_path):
    first = deliver.deliver(spark, config, str(tmp_path), dry_run=True)
    (key,) = first.questions
    told = state.Decision(key, "North Site", "project", ("North Site",))
    run = deliver.deliver(spark, config, str(tmp_path), decisions={key: told})
    assert run.counts["written"] == 5 and run.questions == () and state.load_recipe(spark, str(tmp_path / "recipe.json"))[key].selected == "North Site"
    assert {r.rule for r in run.outcomes.where("identifier = 'A-2'").collect()} == {"human_confirmation"}


def test_nothing_is_delivered_that_is_not_right(spark, config, tmp_path):
    base = str(tmp_path)

    def damage(path):
        if "North" in path:
            files.write(spark, path, W.patched(files.read(spark, path), {"Data": [W.Write(2, 2, "Elsewhere"), W.Write(1, 3, "Day")]}))

    run = deliver.deliver(spark, config, base, post_stage=damage)
    assert run.targets == {"North Site": "verification_failed", "South Yard": "delivered"} and run.counts["written"] == 2 and run.counts["accepted"] == 2
    assert run.failures[0].message == "column_shift, written_value_mismatch" and not (tmp_path / "out/North Site.xlsx").exists()

    def check(cells, contract):
        return cells.limit(1).select(F.lit("no_go").alias("code"), F.lit("warning" if contract.target.key == "North Site" else "error").alias("severity"), "sheet", "row", F.lit(None).cast("string").alias("field"), "cell", F.lit(None).cast("string").alias("evidence"))

    (tmp_path / "out/South Yard.xlsx").unlink()
    run = deliver.deliver(spark, config, base, verifiers=(check,))
    assert run.targets == {"North Site": "delivered", "South Yard": "verification_failed"}
    (tmp_path / "out/North Site.xlsx").unlink()

    def broken(cells, contract):
        raise KeyError("x")

    assert deliver.deliver(spark, config, base, verifiers=(broken,)).failures[0].message == "verifier_error"


def test_protected_cells_and_blockers(spark, config, tmp_path):
    template(tmp_path / "north.xlsx", extra=[[None, None, None, None, None, None], [None, None, None, None, None, None]])
    raw = W.patched((tmp_path / "north.xlsx").read_bytes(), {"Data": [W.Write(3, 4, "=1+1")]})
    (tmp_path / "north.xlsx").write_bytes(raw)
    run = deliver.deliver(spark, config, str(tmp_path))
    assert run.plan["North Site"]["expected_skipped_protected"] == 1 and run.plan["North Site"]["expected_written"] == 1
    assert run.targets["North Site"] == "incomplete_write" and run.targets["South Yard"] == "delivered" and run.status == "failed"
    config["targets"][0] |= {"field_columns": {"location": "A", "nobody": "B"}, "template": "gone.xlsx", "max_rows": 0, "required_fields": ["category"]}
    run = deliver.deliver(spark, config, str(tmp_path))
    assert run.status == "blocked" and [b.split(": ")[-1] for b in run.blockers] == ["missing_template:gone.xlsx", "unmapped_contract_field:nobody", "record_id_not_mapped:record_id", "required_field_not_mapped:category", "template_accepts_no_rows", "too_many_rows:2"]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert [(f.code, f.message) for f in deliver.deliver(spark, config, str(tmp_path)).failures] == [("unknown_layout", "b.csv")]


@pytest.mark.parametrize(("change", "code"), [
    ({"targets": []}, "needs targets"), ({"inputs": []}, "needs targets"), ({"delivery": {"formats": ["doc"]}}, "formats are"), ({"delivery": {"formats": ["csv"]}}, "csv takes a mode"),
    ({"delivery": {"formats": ["csv"], "csv": {"mode": "single-sheet"}}}, "named"), ({"delivery": {"formats": ["pdf"]}}, "pdf takes"), ({"delivery": {"formats": ["xlsx"], "csv": {"mode": "single-sheet"}}}, "csv takes"),
])
def test_configurations_that_are_refused(config, change, code):
    with pytest.raises(T.ConfigError, match=code):
        T.load(config | change)


def test_configuration_paths_stay_in_their_folder(spark, config, tmp_path):
    assert report.prepared(spark, config, str(tmp_path), str(tmp_path)) == []
    assert report.prepared(spark, config | {"inputs": ["../x.csv", "no.csv"]}, str(tmp_path), str(tmp_path)) == ["outside_root: x.csv", "missing_input: no.csv"]
    seen = report.write_plan(spark, str(tmp_path / "plan.json"), {"a": 1}, None)
    with pytest.raises(report.ReportError):
        report.write_plan(spark, str(tmp_path / "plan.json"), {"a": 2}, None)
    assert report.write_plan(spark, str(tmp_path / "plan.json"), {"a": 2}, seen) != seen


def test_findings_of_cells(spark):
    t = T.Target("k", "t.xlsx", "S", {"record_id": 1, "location": 2}, required=("location", "category"), expected=(T.Expected("S", "D1", "2026-09-01"), T.Expected("Gone", "A1", "x")))
    schema = "destination string, sheet string, row int, col int, cell string, value string, formula string"
    cell = lambda c, v, f=None: ("k", "S", int(c[1:]), ord(c[0]) - 64, c, v, f)
    tpl = spark.createDataFrame([cell("A1", "ID"), cell("B1", "Where")], schema)
    out = spark.createDataFrame([cell("A1", "ID"), cell("B1", "Here"), cell("A2", "r1"), cell("B2", "x"), cell("A3", "r1"), cell("B3", " "), cell("D1", "2026-09-01T00:00:00")], schema)
    changed = spark.createDataFrame([("k", "S", 2, 1, "A2", "record_id", "r1", None), ("k", "S", 2, 2, "B2", "location", "x", None), ("k", "S", 3, 1, "A3", "record_id", "r2", None), ("k", "S", 3, 2, "B3", "location", "y", None)], "destination string, sheet string, row int, col int, cell string, field string, new_value string, skip string")
    found = verify.verified(out, tpl, changed, T.mapping(spark, [t]), verify.Contract(t, 3, 2, 0, 1))
    got = sorted((r.code, r.cell, r.evidence) for r in found.collect())
    assert got == [("column_shift", "B1", "Where -> Here"), ("duplicate_record", "A3", "first at row 2"), ("missing_period_sheet", "A1", None), ("missing_required_field", "B3", None), ("record_id_mismatch", None, None), ("stage_count_mismatch", None, None), ("unmapped_required_field", None, None), ("written_count_mismatch", None, None), ("written_value_mismatch", "A3", None), ("written_value_mismatch", "B3", None)]
    one = verify.summary(found).first()
    assert one.findings == 10 and one.severities == {"error": 10} and len(one.codes) == 9 and verify.blocking(found).first().blocking
    assert not verify.blocking(found.where("false")).first().blocking and verify.summary(found.where("false")).first().findings == 0
    assert [r.code for r in verify.verified(None, tpl, changed, T.mapping(spark, [t]), verify.Contract(t, 2, 2, 0, 2)).collect()] == ["unreadable_workbook"]
    lost = verify.verified(out.withColumn("sheet", F.lit("T")), tpl, changed, T.mapping(spark, [t]), verify.Contract(t, 2, 2, 0, 2))
    assert [r.code for r in lost.collect()] == ["missing_sheet"]


def test_columns_and_values(spark):
    rows = spark.createDataFrame([(k,) for k in (1, 26, 27, 52, 702, 703, 16384)], "n int").select("n", write.letters(F.col("n")).alias("a"))
    got = {r.n: r.a for r in rows.collect()}
    assert got == {1: "A", 26: "Z", 27: "AA", 52: "AZ", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    back = spark.createDataFrame([(v,) for v in [*got.values(), "XFE", "A1", ""]], "a string").select(write.column_number(F.col("a")).alias("n")).collect()
    assert [r.n for r in back] == [*got, None, None, None]
    cases = [("1", "1.0", True), ("01", "1", False), ("2026-09-01", "2026-09-01T08:00:00", True), ("2026-09-01", "2026-09-02 00:00:00", False), ("a", "a ", False), (None, "", True)]
    df = spark.createDataFrame(cases, "l string, r string, w boolean")
    assert all(r.got == r.w for r in df.select("w", verify.same_value(F.col("l"), F.col("r")).alias("got")).collect())


def test_formulas_of_a_delivery(spark, config, tmp_path):
    rule = {"sheet": "Data", "range": "H2:H3", "formula": "=B2&D2", "expected": {"H2": "North SiteA-1"}}
    config["targets"][0]["formulas"] = [rule]

    def engine(shown):
        def calculate(path):
            raw = files.read(spark, path)
            beside = str(tmp_path / "calculated.xlsx")
            values = {"H2": shown, "H3": "North SiteC-1"}
            text = W.patched(raw, {})
            for cell, value in values.items():
                text = _with_value(text, cell, value)
            files.write(spark, beside, text)
            return beside

        return calculate

    run = deliver.deliver(spark, config, str(tmp_path), recalculate=engine("else"))
    assert run.targets["North Site"] == "formula_delivery_failed" and run.failures[0].message == "recalculation_mismatch"
    run = deliver.deliver(spark, config, str(tmp_path), recalculate=engine("North SiteA-1"), verifiers=(formula_delivery.verifier([]),))
    assert run.targets["North Site"] == "delivered" and run.manifests["North Site"]["formulas"]["status"] == "verified"
    assert run.manifests["North Site"]["verification"]["codes"] == ["recalculation_not_verified"]
    cells = {r.cell: r.formula for r in workbook.cells(spark, str(tmp_path / "out/North Site.xlsx")).where("formula is not null").collect()}
    assert cells == {"H2": "=B2&D2", "H3": "=B3&D3"}
    assert deliver.deliver(spark, config, str(tmp_path)).targets["North Site"] == "no_new_records"
    rule["formula"] = "=B2"
    assert deliver.deliver(spark, config, str(tmp_path)).failures[0].code == "formula_delivery_requires_records"


def _with_value(content, cell, value):
    """A copy in which a formula's cell has a stored text."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            raw = old.read(info.filename).decode()
            raw = __import__("re").sub(rf'<c r="{cell}"(?: t="str")?><f>([^<]*)</f>(?:<v>[^<]*</v>)?</c>', rf'<c r="{cell}" t="str"><f>\1</f><v>{value}</v></c>', raw)
            new.writestr(info.filename, raw)
    return out.getvalue()


def test_run_state(spark, tmp_path):
    path = str(tmp_path / "s/runs.json")
    g = state.Guard(spark, path, "t", {"inputs": ["b", "a"], "period": None}, lambda: "rev1")
    assert g.verdict == state.Verdict("changed", "no_previous_run")
    assert g.start().attempt == 1 and state.Guard(spark, path, "t", {"inputs": ["a", "b"], "period": None}, lambda: "rev1").verdict.reason == "previous_run_started"
    assert g.finish("failed", False, {"api_token": "x", "note": "n" * 300}).attempt == 1
    kept = state.load_runs(spark, path)["t"]
    assert kept.detail["api_token"].startswith("sha256:") and len(kept.detail["note"]) == 200
    g = state.Guard(spark, path, "t", {"inputs": ["a", "b"], "period": None}, lambda: "rev1")
    assert g.verdict.decision == "retry" and g.finish("succeeded", True).attempt == 2
    assert state.Guard(spark, path, "t", {"inputs": ["a", "b"], "period": None}, lambda: "rev1").verdict.decision == "no_op"
    moved = state.Guard(spark, path, "t", {"inputs": ["a", "b"], "period": None}, lambda: None).verdict
    assert (moved.decision, moved.reason, moved.changed) == ("changed", "remote_revision_changed", ("remote_revision",))
    assert state.Guard(spark, path, "t", {"inputs": ["a"], "period": None}, lambda: "rev1").verdict.changed == ("inputs",)
    state.save_run(spark, path, state.Run("other", "f", "succeeded"))
    assert set(state.load_runs(spark, path)) == {"t", "other"}
    (tmp_path / "s/runs.json").write_text('{"format": "else"}')
    with pytest.raises(files.FormatError):
        state.load_runs(spark, path)


def test_saved_answers(spark, tmp_path):
    a, b = state.Decision("k", "x", "project", ("x", "y"), decided_at="1"), state.Decision("l", "x", "run")
    path = str(tmp_path / "r.json")
    state.save_recipe(spark, path, [a, b])
    assert state.load_recipe(spark, path) == {"k": a} and state.load_recipe(spark, str(tmp_path / "none")) == {}
    again = state.Decision("k", "x", "project", ("y", "x"), source="other", decided_at="2")
    assert state.recipe_version([a]) == state.recipe_version([again]) != state.recipe_version([b])
    assert state.save_mapping(spark, str(tmp_path / "m.json"), "Staff No.", " Employee ") | state.save_mapping(spark, str(tmp_path / "m.json"), "Date", "Day") == {"staffno": "Employee", "date": "Day"}
    rules = [state.Override("*.csv", "input"), state.Override("a.csv", "template"), state.Override("*.csv", "unknown", "review")]
    state.save_overrides(spark, str(tmp_path / "w.json"), rules)
    assert [(r.pattern, r.classification) for r in state.overrides_frame(spark, state.load_overrides(spark, str(tmp_path / "w.json"))).collect()] == [("*.csv", "unknown"), ("a.csv", "template")]
