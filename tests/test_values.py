"""Exact values of the rule ladders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulith.functions import text as X
from tabulith.functions import values as V
from tabulith.plans import formats, periods

CASES = [
    ("employee_id", "00123", None, ("text_identifier", "leading_zero_identifier", "00123", False)),
    ("phone", "+1 (416) 555-0100", None, ("text_identifier", "phone_identifier", "+1 (416) 555-0100", False)),
    ("postal_code", "M5V 2T6", None, ("text_identifier", "identifier_field", "M5V 2T6", False)),
    ("start_date", "03/04/2026", None, ("date", "ambiguous_day_month", None, True)),
    ("start_date", "03/04/2026", "en-US", ("date", None, "2026-03-04", False)),
    ("start_date", "03/04/2026", "en-GB", ("date", None, "2026-04-03", False)),
    ("start_date", "25/12/2026", None, ("date", None, "2026-12-25", False)),
    ("start_date", "2026年9月8日", None, ("date", None, "2026-09-08", False)),
    ("start_date", "2026-02-30", None, ("date", "invalid_date", None, True)),
    ("start_date", "46023", None, ("excel_serial_date", None, "2026-01-01", False)),
    ("reading", "46023", None, ("integer", "text_number", "46023", False)),
    ("reading", "0071", None, ("text_identifier", "leading_zero_candidate", "0071", False)),
    ("share", "12.5%", None, ("percentage", None, "0.125", False)),
    ("tax_rate", "13", None, ("percentage", None, "13", False)),
    ("gross_pay", "1.234,56", None, ("decimal", None, "1234.56", False)),
    ("gross_pay", "$1,234.50", None, ("decimal", None, "1234.5", False)),
    ("reading", "1,234", None, ("integer", "text_number", "1234", True)),
    ("reading", "1,5", "de-DE", ("decimal", "text_number", "1.5", False)),
    ("note", "plain words", None, ("text", None, "plain words", False)),
    ("note", "   ", None, ("empty", None, None, False)),
    ("note", None, None, ("empty", None, None, False)),
]


def test_inference_ladder(spark):
    df = spark.range(1).select(*[V.infer(f, F.lit(v).cast("string"), loc).alias(f"c{k}") for k, (f, v, loc, _) in enumerate(CASES)])
    row = df.first()
    got = [(r["type"], r["reason"], r["value"], r["ambiguous"]) for r in row]
    assert got == [want for *_, want in CASES]


@pytest.mark.parametrize(("text", "declared", "amount", "currency"), [
    ("US$1,234.50", "USD", 1234.5, "USD"), ("CA$100", "", 100, "CAD"), ("$100", "CAD", 100, "CAD"), ("US$100", "CAD", 100, "conflict"),
    ("$100", "EUR", 100, "conflict"), ("n/a", "", None, ""), ("NaN", "", None, ""), ("¥5", "cny", 5, "CNY"), (None, None, None, ""),
])
def test_money(spark, text, declared, amount, currency):
    t, d = F.lit(text).cast("string"), F.lit(declared).cast("string")
    got = spark.range(1).select(V.amount(t).cast("double").alias("a"), V.resolved_currency(V.detected_currency(t), V.currency_evidence(d)).alias("c")).first()
    assert (got.a, got.c) == (amount, currency)


def test_ingest_dates(spark):
    cases = {"2026/09/08 08:30": "2026-09-08", "2026-09-08": "2026-09-08", "03/04/2026": "2026-03-04", "25/12/2026": "2026-12-25", "soon": "soon", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", V.ingest_date(F.col("d")).alias("iso"))
    assert {r.d: r.iso for r in df.collect()} == cases


def test_unicode_keys(spark):
    rows = spark.createDataFrame([("Straße 5",), ("STRASSE-5",), ("Ｓｉｔｅ  1",)], "v string")
    got = [tuple(r) for r in rows.select(X.match_key(F.col("v")), X.identity_key(F.col("v"))).collect()]
    assert got == [("strasse5", "strasse 5"), ("strasse5", "strasse-5"), ("site1", "site 1")]


def test_names(spark):
    names = {"final (1).xlsx": "final", "Pay_Run-v2.xlsx": "pay run", "report - Copy (2).xlsx": "report", "total final final.xlsx": "total", "draft.xlsx": "draft"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.version_key(F.col("n")).alias("k"))
    assert {r.n: r.k for r in df.collect()} == names
    safe = spark.createDataFrame([("=1+1",), ("@x",), ("fine",), (None,)], "v string").select(X.csv_safe(F.col("v"))).collect()
    assert [r[0] for r in safe] == ["'=1+1", "'@x", "fine", None]
    clean = spark.createDataFrame([("a/b:c.",), ("CON",)], "v string").select(X.file_component(F.col("v"))).collect()
    assert [r[0] for r in clean] == ["a-b-c", "_CON"]


def test_periods(spark):
    day = F.to_date(F.lit("2026-03-01"))
    want = {
        "current_week": ("2026-02-23", "2026-03-01"), "previous_complete_week": ("2026-02-16", "2026-02-22"), "current_month": ("2026-03-01", "2026-03-31"), "previous_month": ("2026-02-01", "2026-02-28"),
        "current_quarter": ("2026-01-01", "2026-03-31"), "previous_quarter": ("2025-10-01", "2025-12-31"), "current_fiscal_year": ("2025-04-01", "2026-03-31"), "previous_fiscal_year": ("2024-04-01", "2025-03-31"),
        "current_fiscal_quarter": ("2026-01-01", "2026-03-31"), "previous_fiscal_quarter": ("2025-10-01", "2025-12-31"),
    }
    row = spark.range(1).select(*[F.concat_ws(" ", *periods.period(k, day, fiscal_start=4)).alias(k) for k in want]).first()
    assert row.asDict() == {k: " ".join(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        periods.period("last_week", day)


def test_format_codes():
    assert formats.code("amount", currency="CAD") == '"CA$"#,##0.00;-"CA$"#,##0.00;"CA$"#,##0.00'
    assert formats.code("headcount") == "#,##0;-#,##0;#,##0"
    assert formats.code("percentage", 1, negative="red") == "0.0%;[Red]-0.0%;0.0%"
    assert formats.code("hours", negative="accounting") == '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)'
    assert [formats.kind_of(n) for n in ("fx_rate", "pct_done", "tax rate", "total_pay")] == ["exchange_rate", "percentage", "tax_rate", "amount"]
    with pytest.raises(formats.FormatError) as e:
        formats.code("amount", currency="$")
    assert e.value.code == "ambiguous_currency_symbol"
