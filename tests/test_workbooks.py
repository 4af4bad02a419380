"""Workbooks: cells, health, repairs, reports, periods, formulas; directories and streams."""

from __future__ import annotations

import csv
import io
import os
import time
from datetime import date, datetime, timedelta, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tabulith.functions import text as X
from tabulith.operators import catalog, formulas, match, repair, report, review, state
from tabulith.plans import expressions as P
from tabulith.plans.targets import Exports
from tabulith.sinks import workbook as W
from tabulith.sources import grids, workbook
from tabulith.streaming import deliveries

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {NS}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><cellXfs count="3"><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="164" fontId="0" fillId="0"/><xf numFmtId="14" fontId="0" fillId="0"/></cellXfs></styleSheet>'


def book(rows, tail="", head="", date1904=False, names=""):
    """A workbook of one sheet given as XML rows."""
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(W.built({"Data": []}))) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            raw = old.read(info.filename)
            if info.filename.endswith("sheet1.xml"):
                raw = f"<worksheet {NS}>{head}<sheetData>{rows}</sheetData>{tail}</worksheet>".encode()
            if info.filename == "xl/workbook.xml":
                raw = raw.replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>' if date1904 else b"<sheets>").replace(b"</sheets>", f"</sheets>{names}".encode())
            new.writestr(info.filename, raw)
        new.writestr("xl/styles.xml", STYLES)
        new.writestr("docProps/core.xml", "<c><title>Pay template</title><subject>s</subject></c>")
    return out.getvalue()


def t(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def n(ref, value, style=0):
    return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'


SICK = book(
    f'<row r="1">{t("A1", "Name")}{t("B1", "Amount")}{t("C1", " amount ")}{t("D1", "Day")}</row><row r="2">{t("A2", "x ")}{t("B2", "1,234")}{n("C2", 0)}{n("D2", 46023, 1)}</row>'
    f'<row r="3">{t("A3", "a​b")}{t("B3", "12.5%")}{n("D3", 46024, 2)}<c r="E3"><f>B2+1</f></c></row><row r="5">{t("A5", "y")}{t("B5", "0071")}{n("C5", 7)}</row><row r="200">{t("Z200", "stray")}</row>',
    tail='<autoFilter ref="A1:B3"/><mergeCells count="1"><mergeCell ref="A2:B2"/></mergeCells>', head='<sheetViews><sheetView workbookViewId="0"><pane ySplit="3" topLeftCell="A4" state="frozen"/></sheetView></sheetViews>',
    names='<definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">\'Data\'!$A$1:$B$2</definedName></definedNames>',
)


def test_cells_layout_and_metadata(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(SICK)
    (tmp_path / "bad.xlsx").write_bytes(b"no")
    path = str(tmp_path)
    cells = {r.cell: r for r in workbook.cells(spark, path).collect()}
    assert (cells["D2"].value, cells["D2"].kind, cells["D2"].number_format, cells["C2"].kind, cells["A2"].value) == ("2026-01-01", "d", "yyyy-mm-dd", "n", "x ")
    assert cells["D2"].style != cells["D3"].style and [r.cell for r in workbook.uncached_formulas(workbook.cells(spark, path)).collect()] == ["E3"]
    assert [tuple(r)[2:] for r in workbook.merges(spark, path).collect()] == [(2, 1, 2, 2)]
    lay = workbook.layout(spark, path).first()
    assert (lay.filter_ref, lay.freeze, lay.print_refs, lay.max_row, lay.max_col) == ("A1:B3", "A4", ["'Data'!$A$1:$B$2"], 200, 26)
    meta = {r.file.rpartition("/")[2]: (r.titles, r.title, r.reason) for r in workbook.metadata(spark, path).collect()}
    assert meta == {"s.xlsx": (["Data"], "Pay template", None), "bad.xlsx": ([], "", "BadZipFile")}


@pytest.mark.parametrize("since", [False, True])
def test_numbers_in_a_date_column_are_days(spark, tmp_path, since):
    rows = f'<row r="1">{t("A1", "preamble")}</row><row r="3">{t("A3", "Address")}{t("B3", "Date")}{t("C3", "Code")}{t("D3", "Event Type")}</row><row r="4">{t("A4", "x")}{n("B4", 45543 - 1462 * since)}{n("C4", 45543)}{t("D4", "k")}</row>'
    (tmp_path / "a.xlsx").write_bytes(book(rows, date1904=since))
    records, failed = grids.input_records(spark, [str(tmp_path / "a.xlsx")])
    row = records.first()
    assert (row.event_date, row.identifier, row.source) == ("2024-09-08", "45543", "a.xlsx#Data:4") and failed.count() == 0
    with pytest.raises(ValueError, match="unsupported input"):
        grids.input_records(spark, [str(tmp_path / "a.pdf")])


def test_health_scan(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(SICK)
    found = {}
    for r in repair.scan(spark, str(tmp_path / "s.xlsx")).collect():
        found.setdefault(r.code, []).append(r.location)
    assert {k: sorted(v) for k, v in found.items()} == {
        "extra_whitespace": ["A2", "C1"], "invisible_characters": ["A3"], "numeric_text": ["B2", "B3"], "duplicate_header": ["C1"], "blank_data_rows": ["A4:E4"], "content_beyond_working_area": ["Z200"], "abnormal_merged_cells": ["A2:B2"],
        "mixed_date_formats": ["D2:D5"], "inconsistent_cell_style": ["D2:D5"], "filter_range_mismatch": ["A1:B3"], "freeze_panes_mismatch": ["A4"], "print_area_mismatch": ["'Data'!$A$1:$B$2"], "blank_zero_semantics": ["C2:C5"],
    }
    (tmp_path / "e.xlsx").write_bytes(W.built({"Sheet1": [], "Other": []}))
    assert sorted(r.code for r in repair.scan(spark, str(tmp_path / "e.xlsx")).collect()) == ["default_empty_sheet", "empty_workbook"]
    with pytest.raises(repair.RepairError):
        repair.scan(spark, str(tmp_path / "none.xlsx"))


def test_repair_of_selected_findings(spark, tmp_path):
    source, target = str(tmp_path / "s.xlsx"), str(tmp_path / "fixed.xlsx")
    (tmp_path / "s.xlsx").write_bytes(SICK)
    planned = repair.actions(repair.scan(spark, source), __import__("hashlib").sha256(SICK).hexdigest())
    ids = {(r.code, r.location): (r.action_id, r.status) for r in planned.collect()}
    assert ids["duplicate_header", "C1"][1] == "requires_declared_baseline" and ids["content_beyond_working_area", "Z200"][1] == "report_only" and ids["numeric_text", "B2"][1] == "ready"
    pick = [ids[k][0] for k in (("invisible_characters", "A3"), ("numeric_text", "B3"), ("freeze_panes_mismatch", "A4"))]
    done = repair.repair(spark, source, target, pick)
    assert done.failures == () and done.output == target and {c["after"] for c in done.changes} == {"ab", 0.125, "A2"}
    cells = {r.cell: (r.value, r.kind, r.formula) for r in workbook.cells(spark, target).collect()}
    assert cells["A3"] == ("ab", "s", None) and cells["B3"][:2] == ("0.125", "n") and cells["E3"][2] == "=B2+1" and cells["A2"][0] == "x "
    with pytest.raises(repair.RepairError, match="free"):
        repair.repair(spark, source, target, pick)
    with pytest.raises(repair.RepairError, match="stale"):
        repair.repair(spark, source, str(tmp_path / "o.xlsx"), ["health-none"])
    with pytest.raises(repair.RepairError, match="unsupported"):
        repair.repair(spark, source, str(tmp_path / "o.xlsx"), [ids["content_beyond_working_area", "Z200"][0]])
    head = ids["duplicate_header", "C1"][0]
    with pytest.raises(repair.RepairError, match="baseline"):
        repair.repair(spark, source, str(tmp_path / "o.xlsx"), [head])
    dates, zeros = ids["mixed_date_formats", "D2:D5"][0], ids["blank_zero_semantics", "C2:C5"][0]
    told = {dates: {"target_number_format": "dd.mm.yyyy", "locale": "de-DE"}, zeros: {"blank_action": "convert_to_zero", "zero_action": "preserve"}}
    more = repair.repair(spark, source, str(tmp_path / "p.xlsx"), [dates, zeros], told)
    assert more.output is None and any(f.startswith("unauthorized_finding_changed") for f in more.failures)  # styles and blank rows were findings of their own


def test_report_and_review_pack(spark, tmp_path):
    rows = [(k, "North" if k % 3 else "", "2026-09-08", f"{k:04d}", "routine", 0.9, "f:1", None) for k in range(9)]
    records = spark.createDataFrame(rows, "row_index int, location string, event_date string, identifier string, category string, confidence double, source string, amount string")
    path = str(tmp_path / "r.xlsx")
    assert report.write_report(records, path) == {"total": 9, "accepted": 6, "review": 3}
    with pytest.raises(report.ReportError):
        report.verify_report(spark, path, 8)
    types = {r.cell: r.value for r in workbook.cells(spark, path).where("sheet = 'Type Inference'").collect()}
    assert types["A1"] == "Field" and "text_identifier" in types.values()
    schema = "record_id string, location string, source string, candidates array<string>, reasons array<string>, match_confidence double, status string"
    issued = review.pack(spark.createDataFrame([("a", "Nrth", "f:1", ["North"], ["fuzzy_requires_review"], 0.1 + 0.2, "review"), ("b", "S", "f:2", None, ["no_match"], None, "review")], schema))
    report.write_pack(issued, str(tmp_path / "p.xlsx"), [("2026-09-01", "z", "accept", "", "")])
    blank = report.read_pack(spark, str(tmp_path / "p.xlsx"))
    assert review.problems(*blank).count() == 0 and review.confirmations(*blank).count() == 0
    raw = (tmp_path / "p.xlsx").read_bytes()
    (tmp_path / "back.xlsx").write_bytes(W.patched(raw, {"Review": [W.Write(2, 8, "accept"), W.Write(3, 8, "correct"), W.Write(3, 9, "South")]}))
    seals, back = report.read_pack(spark, str(tmp_path / "back.xlsx"))
    assert {tuple(r) for r in review.confirmations(seals, back).collect()} == {("a", "North"), ("b", "South")}
    assert report.pack_history(back, "now") == [("now", "a", "accept", "", ""), ("now", "b", "correct", "South", "")]
    (tmp_path / "forged.xlsx").write_bytes(W.patched(raw, {"Review": [W.Write(2, 4, "Elsewhere"), W.Write(2, 8, "accept")]}))
    seals, back = report.read_pack(spark, str(tmp_path / "forged.xlsx"))
    assert [tuple(r) for r in review.problems(seals, back).collect()] == [("a", "changed_row")]
    (tmp_path / "else.xlsx").write_bytes(W.built({"Review": [["x"]]}))
    with pytest.raises(report.ReportError):
        report.read_pack(spark, str(tmp_path / "else.xlsx"))


def test_exports(spark, tmp_path):
    source = tmp_path / "in.xlsx"
    source.write_bytes(W.built({"A/B": [["x", "=1+1"], [], ["-5", "-x", 'q"r']], "a?b": [["z"]]}))
    got = report.export(spark, str(source), str(tmp_path / "out"), Exports(("xlsx", "csv"), "one-file-per-sheet"))
    assert [(a.format, a.output.rpartition("/")[2], a.sheets) for a in got] == [("xlsx", "in.xlsx", ("A/B", "a?b")), ("csv", "A_B.csv", ("A/B",)), ("csv", "a_b-2.csv", ("a?b",))]
    raw = (tmp_path / "out/A_B.csv").read_bytes().decode("utf-8-sig")
    assert list(csv.reader(io.StringIO(raw))) == [["x", "'=1+1", ""], ["", "", ""], ["-5", "'-x", 'q"r']]
    (tmp_path / "f.xlsx").write_bytes(W.patched(source.read_bytes(), {"a?b": [W.Write(1, 1, "=2")]}))
    with pytest.raises(report.ReportError, match="stored value"):
        report.export(spark, str(tmp_path / "f.xlsx"), str(tmp_path / "out2"), Exports(("csv",), "single-sheet", "a?b"))
    with pytest.raises(report.ReportError, match="renderer"):
        report.export(spark, str(source), str(tmp_path / "out2"), Exports(("pdf",)))


def test_periods_of_expressions():
    got = P.resolved(" This  Quarter ", "2026-03-01T23:30:00-05:00", "Asia/Shanghai")
    assert (got.start, got.end, got.on, got.moved) == (date(2026, 1, 1), date(2026, 3, 31), date(2026, 3, 2), True)
    assert P.resolved("上周", date(2026, 3, 1)).text == "2026-02-16 至 2026-02-22"
    assert P.resolved("last fiscal quarter", date(2026, 3, 1), fiscal_start=4).start == date(2025, 10, 1)
    assert P.resolved("custom", date(2026, 3, 1), first="2026-01-02", last="2026-01-03").rule["custom_end"] == "2026-01-03"
    for wrong, kind in (("last week", P.AmbiguousPeriod), ("someday", P.PeriodError), ("", P.PeriodError)):
        with pytest.raises(kind):
            P.resolved(wrong, date(2026, 3, 1))
    for bad in ({"first": "2026-02-01", "last": "2026-01-01"}, {"first": "x", "last": "2026-01-01"}):
        with pytest.raises(P.PeriodError):
            P.resolved("custom", date(2026, 3, 1), **bad)
    with pytest.raises(P.PeriodError):
        P.resolved("this week", date(2026, 3, 1), zone="Nowhere/None")
    with pytest.raises(P.PeriodError):
        P.resolved("this week", date(2026, 3, 1), week_start=7)
    assert P.as_of(datetime(2026, 3, 1, 23, 0), "Asia/Shanghai") == (date(2026, 3, 1), False)


def test_refresh_of_declared_cells(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(W.built({"March": [["Report of", "old"], ["Start", "2026-03-01"], ["Event", "2020-01-01"]], "Empty": [["Due", "old"]]}))
    period = P.resolved("this month", date(2026, 4, 9))
    slots = [P.Slot("March", "period", "B1"), P.Slot("March", "period_start", "B2"), P.Slot("March", P.PROTECTED, "B3"), P.Slot("Empty", "deadline", "B1", when_empty=False), P.Slot("March", "period_start", None, "{value:%B}")]
    source, target = str(tmp_path / "m.xlsx"), str(tmp_path / "n.xlsx")
    dry = P.refresh(spark, source, target, period, slots, deadline=date(2026, 4, 30), dry_run=True)
    assert not os.path.exists(target)
    want = [(0, "updated"), (1, "updated"), (2, "protected"), (3, "empty_skipped"), (4, "updated")]
    assert [(r.pos, r.status) for r in dry.orderBy("pos").collect()] == want
    P.refresh(spark, source, target, period, slots, deadline=date(2026, 4, 30))
    cells = {(r.sheet, r.cell): r.value for r in workbook.cells(spark, target).collect()}
    assert cells["April", "B1"] == "2026-04-01 至 2026-04-30" and cells["April", "B2"] == "2026-04-01" and cells["April", "B3"] == "2020-01-01" and cells["Empty", "B1"] == "old"
    with pytest.raises(P.PeriodError):
        P.refresh(spark, source, source, period, slots)
    with pytest.raises(P.PeriodError):
        P.refresh(spark, source, target, period, [P.Slot("Gone", "period", "A1")])


def test_formula_plans():
    assert formulas.planned_lookup("r", "a2", "It's", "A2:A9", "C2:C9", "2016").formula == "=IFNA(INDEX('It''s'!C2:C9,MATCH(A2,'It''s'!A2:A9,0)),\"\")"
    assert formulas.planned_lookup("r", "A2", "S", "A2:A9", "C2:D9", "365").formula == "=XLOOKUP(A2,'S'!A2:A9,'S'!C2:D9,\"\",0)"
    assert formulas.planned_sum("r", "A2", "S", "A2:A9", "B2:B9").formula == "=SUMIFS('S'!B2:B9,'S'!A2:A9,A2)" and formulas.planned_date("r", "A2", -1).formula == "=EDATE(A2,-1)"
    for bad in (("A2:B9", "C2:C9", "365"), ("A2:A9", "C2:C8", "365"), ("A2:A9", "C2:D9", "2019"), ("A2:A", "C2:C9", "365"), ("A2:A9", "C2:C9", "2013")):
        with pytest.raises(formulas.FormulaError):
            formulas.planned_lookup("r", "A2", "S", *bad)
    with pytest.raises(formulas.FormulaError):
        formulas.planned_date("r", "A2", True)


def test_formulas_move_and_cycles_have_no_length(spark):
    cases = {'=A1&"B1"&Sheet2!C$3': '=B3&"B1"&Sheet2!D$3', "=LOG10(A1)+$A1": "=LOG10(B3)+$A3", "=SUM(A1:B2)": "=SUM(B3:C4)", "='A1 x'!A1": "='A1 x'!B3", "=A1048576": "=#REF!"}
    df = spark.createDataFrame([(k,) for k in cases], "f string").select("f", formulas.translated(F.col("f"), F.lit(2), F.lit(1)).alias("g"))
    assert {r.f: r.g for r in df.collect()} == cases
    ring = [("b", f"A{k}", f"A{(k + 1) % 5000}") for k in range(5000)] + [("c", f"A{k}", f"A{k + 1}") for k in range(20000)] + [("d", "A1", "A1"), ("d", "A2", "A1"), ("d", "A3", "A4"), ("d", "A4", "A3"), ("d", "A4", "A1")]
    got = {}
    for r in formulas.on_cycles(spark.createDataFrame(ring, "book string, cell string, needs string")).collect():
        got.setdefault(r.book, set()).add(r.cell)
    assert {k: len(v) for k, v in got.items()} == {"b": 5000, "d": 3} and got["d"] == {"A1", "A3", "A4"}
    name = "plan" + " final (1) - copy v2_rev 3 draft" * 12 + ".xlsx"
    assert spark.createDataFrame([(name,)], "n string").select(X.version_key(F.col("n"))).first()[0] == "plan"


def test_fuzzy_finds_every_pair(spark):
    import random

    rng = random.Random(2)
    base = ["northern harbour", "south yard", "east gate", "old mill", "central depot 12", "straße am see", "a", "zz"]
    change = lambda s: "".join(rng.choice([c, c, c, c, c, c, "", c + rng.choice("aeioz"), rng.choice("aeioz")]) for c in s)
    places = sorted({change(b) for b in base for _ in range(40)} | {"", "!!", "harbour northern", "tide", "diet"})
    targets = [(f"T{k}", [b, change(b)]) for k, b in enumerate(base)] + [("T9", ["diet"])]
    plain = lambda s: "".join(c for c in __import__("unicodedata").normalize("NFKC", s).casefold() if c.isalnum())
    want = {}
    for p in places:
        for key, names in targets:
            scored = [(SequenceMatcher(None, plain(p), plain(a)).ratio(), a) for a in [key, *names] if plain(p) and plain(a)]
            if scored and max(scored)[0] >= 0.78:
                want[p, key] = max(scored)
    got = match.fuzzy(spark.createDataFrame([(p,) for p in places], "location string"), spark.createDataFrame(targets, "key string, aliases array<string>"))
    assert {(r.location, r.destination): (r.ratio, r.alias) for r in got.collect()} == want and len(want) > 100


def test_directory_scan(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    now = datetime(2026, 10, 5, 12, tzinfo=timezone.utc)
    for name, content, day in [("hours.csv", b"1", 10), ("copy of hours.csv", b"1", 10), ("old.csv", b"2", -40), ("later.csv", b"3", 33), ("pay final.csv", b"4", 11), ("pay.csv", b"5", 11), ("~$x.xlsx", b"0", 10), ("notes.txt", b"0", 10), ("fresh.csv", b"7", 21), ("sub/b.xlsx", book(""), 10), ("delivered.csv", b"8", 10)]:
        path = root / name
        path.write_bytes(content)
        at = (datetime(2026, 9, 1, tzinfo=timezone.utc) + timedelta(days=day - 1)).timestamp() if name != "fresh.csv" else now.timestamp() - 1
        os.utime(path, (at, at))
    rules = state.overrides_frame(spark, [state.Override("later.csv", "input", "include"), state.Override("fres?.csv", "input", "include")])
    day = lambda d: F.to_date(F.lit(d))
    found, skipped = catalog.scan(spark, [str(root)], day("2026-09-01"), day("2026-09-30"), F.lit(now.replace(tzinfo=None)).cast("timestamp"), overrides=rules)
    got = {r.relative: (r.classification, r.disposition, r.reason) for r in found.collect()}
    assert got == {
        "hours.csv": ("input", "include", "current_period_input"), "copy of hours.csv": ("input", "exclude", "duplicate_content"), "old.csv": ("prior_delivery", "exclude", "historical_outside_current_period"),
        "later.csv": ("input", "include", "override:user"), "pay final.csv": ("input", "review", "version_candidates_require_confirmation"), "pay.csv": ("input", "review", "version_candidates_require_confirmation"),
        "~$x.xlsx": ("unknown", "exclude", "sync_artifact_lock_file"), "notes.txt": ("unknown", "exclude", "unsupported_extension"), "fresh.csv": ("input", "review", "override_refused_unstable_file"),
        "sub/b.xlsx": ("template", "review", "classified_as_template"), "delivered.csv": ("prior_delivery", "exclude", "classified_as_prior_delivery"),
    }
    assert {r.disposition: r.n for r in catalog.disposition_counts(found).collect()} == {"include": 2, "review": 4, "exclude": 5} and skipped.count() == 0


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams(spark, tmp_path):
    schema = "record_id string, v int"
    for k, rows in enumerate([[("a", 1), ("b", 2), ("a", 3), (None, 4)], [("b", 5), ("c", 6), (None, 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/r{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        (part,) = [f for f in os.listdir(f"{tmp_path}/r{k}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/r{k}/{part}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    for _ in range(2):  # the second run finds nothing new
        deliveries.deliver(_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.record_id or "" for r in got) == ["", "", "a", "b", "c"] and {r.v for r in got if r.record_id == "b"} == {2}
    at = datetime(2026, 9, 1, 12)
    sample = "path string, mtime timestamp, size long, now timestamp"
    later = [(at, 10, at + timedelta(seconds=2)), (at, 10, at + timedelta(seconds=9)), (at, 12, at + timedelta(seconds=12)), (at, 12, at + timedelta(seconds=15))]
    os.makedirs(f"{tmp_path}/l")
    for k, (m, s, now) in enumerate(later):
        spark.createDataFrame([("p", m, s, now)], sample).coalesce(1).write.parquet(f"{tmp_path}/l{k}")
        (part,) = [f for f in os.listdir(f"{tmp_path}/l{k}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/l{k}/{part}", f"{tmp_path}/l/{k}.parquet")
        os.utime(f"{tmp_path}/l/{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    seen = []
    query = deliveries.settled_files(_stream(spark, f"{tmp_path}/l", sample)).writeStream.foreachBatch(lambda df, _: seen.extend(r.stable for r in df.collect())).option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [False, True, False, True]
