"""Dates, amounts, currencies, numbers and the inference ladder, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith import contract as C

DECIMAL = "decimal(38,10)"
_EPOCH = "1899-12-30"


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, null where there is none."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row, however often f names it: nested rules stay small plans."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def ingest_date(value: Column) -> Column:
    """ISO date of a cell's text: ISO 8601 (with a time, an offset, as a week, or without dashes), else month first, else day first, else unchanged."""
    text = F.trim(F.coalesce(value, F.lit("")))
    clock = r"(.\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
    iso, basic, week = r"^(\d{4})-(\d{2})-(\d{2})" + clock, r"^(\d{4})(\d{2})(\d{2})" + clock, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?" + clock
    us = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"

    def read(dashed: Column) -> Column:
        found = [F.when(dashed.rlike(p), _date(*[_part(dashed, p, k) for k in order])) for p, order in ((iso, (1, 2, 3)), (basic, (1, 2, 3)), (us, (3, 1, 2)), (us, (3, 2, 1)))]
        year, number, day = (_part(dashed, week, k) for k in (1, 2, 3))
        monday = F.date_trunc("week", _date(year, F.lit("1"), F.lit("4"))).cast("date")
        at = F.date_add(monday, (number.try_cast("int") - 1) * 7 + F.coalesce(day.try_cast("int"), F.lit(1)) - 1)
        within = number.try_cast("int").between(1, 53) & (F.date_trunc("week", _date((year.try_cast("int") + 1).cast("string"), F.lit("1"), F.lit("4"))).cast("date") > at)
        weekly = F.when(dashed.rlike(week) & within, at)
        return F.date_format(F.coalesce(found[0], found[1], weekly, found[2], found[3]), "yyyy-MM-dd")

    return F.when(text == "", "").otherwise(F.coalesce(let(F.replace(text, F.lit("/"), F.lit("-")), read), text))


def serial_date(value: Column, epoch: Column) -> Column:
    """ISO date of a number of days since an epoch, its time left out; null where it is none."""
    n = value.try_cast("double")
    days = F.when(n.between(1, 2958465), F.floor(n)).cast("int")
    return F.date_format(F.date_add(F.to_date(F.coalesce(epoch, F.lit(_EPOCH))), days), "yyyy-MM-dd")


def detected_currency(value: Column) -> Column:
    """The first currency token in order that the text holds."""
    text, out = F.replace(F.upper(F.trim(value)), F.lit(",")), None
    for token, code in C.CURRENCY_TOKENS:
        out = F.when(F.contains(text, F.lit(token)), F.lit(code)) if out is None else out.when(F.contains(text, F.lit(token)), F.lit(code))
    return out


def amount(value: Column) -> Column:
    """The number of a money text; null where there is none."""
    text, out = F.replace(F.upper(F.trim(value)), F.lit(",")), None
    for token, _ in C.CURRENCY_TOKENS:
        cut = F.replace(text, F.lit(token))
        out = F.when(F.contains(text, F.lit(token)), cut) if out is None else out.when(F.contains(text, F.lit(token)), cut)
    return F.trim(out.otherwise(text)).try_cast(DECIMAL)


def currency_evidence(value: Column) -> Column:
    """A declared currency: its code, or the text in upper case; null if empty."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    codes = F.create_map(*[F.lit(x) for pair in C.CURRENCY_TOKENS for x in pair])
    return F.when(text != "", F.coalesce(F.try_element_at(codes, text), text))


def resolved_currency(detected: Column, declared: Column) -> Column:
    """One currency of both; `conflict` where they exclude each other; empty if none is known."""
    fits = F.lit(False)
    for symbol, codes in C.CURRENCY_MAY_BE.items():
        fits = fits | ((detected == symbol) & declared.isin(*codes))
    both = F.when(fits | (detected == declared), declared).otherwise(F.lit("conflict"))
    return F.when(detected.isNotNull() & declared.isNotNull(), both).otherwise(F.coalesce(declared, detected, F.lit("")))


def number(text: Column, locale: str | None = None) -> Column:
    """struct(value, locale, ambiguous) of a number written in some locale."""
    if locale in ("de-DE", "fr-FR"):
        only = lambda p: F.lit(",")
    elif locale in ("en-US", "en-CA", "en-GB", "zh-CN"):
        only = lambda p: F.lit(".")
    else:
        only = lambda p: F.when(p["comma"] == 4, ".").otherwise(",")

    def read(p: Column) -> Column:
        mark = F.when((p["comma"] > 0) & (p["dot"] > 0), F.when(p["comma"] < p["dot"], ",").otherwise(".")).when(p["comma"] > 0, only(p)).otherwise(".")
        plain = F.when(mark == ",", F.replace(F.replace(p["s"], F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(p["s"], F.lit(",")))
        alone = (p["comma"] > 0) & (p["dot"] == 0)
        guessed = F.lit(locale) if locale else F.when(alone & (p["comma"] != 4), F.lit("de-DE"))
        return let(plain, lambda t: told(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), t.try_cast(DECIMAL)), guessed, alone & (p["comma"] == 4)))

    def told(value: Column, guessed: Column, doubt: Column) -> Column:
        return let(value, lambda v: F.struct(v.alias("value"), guessed.cast("string").alias("locale"), (F.lit(False) if locale else doubt & v.isNotNull()).alias("ambiguous")))

    compact = F.regexp_replace(F.regexp_replace(text, "[\u00a0 $¥￥€£]", ""), "%+$", "")
    return let(compact, lambda s: let(F.struct(s.alias("s"), F.locate(",", F.reverse(s)).alias("comma"), F.locate(".", F.reverse(s)).alias("dot")), read))


def plain_decimal(value: Column) -> Column:
    """A decimal's text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast(DECIMAL).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def infer(field: str, value: Column, locale: str | None = None) -> Column:
    """struct(type, confidence, locale, unit, value, ambiguous, reason): the first rule that holds of a text.

    The field's name is known when the plan is made, so its tests cost nothing for a row.
    """

    def out(kind: str, confidence: float, where: object = locale, unit: str | None = None, val: Column | None = None, ambiguous: object = False, reason: str | None = None) -> Column:
        col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), col(where).cast("string").alias("locale"), F.lit(unit).cast("string").alias("unit"),
            col(val).cast("string").alias("value"), col(ambiguous).cast("boolean").alias("ambiguous"), F.lit(reason).cast("string").alias("reason"),
        )

    text = F.trim(value)
    zeros = text.rlike(r"^0\d+$")
    empty = F.when(value.isNull() | (text == ""), out("empty", 1.0))
    if re.search(C.IDENTIFIER_NAME, field.replace(".", "_")):
        phone = text.rlike(r"^\+?[\d() .-]{7,}$") if "phone" in field.lower() or "电话" in field else F.lit(False)
        return (
            empty.when(zeros, out("text_identifier", 0.99, val=text, reason="leading_zero_identifier"))
            .when(phone, out("text_identifier", 0.99, val=text, reason="phone_identifier"))
            .otherwise(out("text_identifier", 0.99, val=text, reason="identifier_field"))
        )
    ymd = r"^(\d{4})\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})\s*日?$"
    slash = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    shown = lambda d: F.date_format(d, "yyyy-MM-dd")
    named = {k: bool(re.search(p, field)) for k, p in (("date", C.DATE_NAME), ("percent", C.PERCENT_NAME), ("money", C.CURRENCY_NAME))}

    def slashed(t: Column) -> Column:
        a, b, y = (_part(t, slash, k) for k in (1, 2, 3))
        month_first = F.lit(locale in ("en-US", "en-CA")) | ((a.cast("int") <= 12) & (b.cast("int") > 12))
        small = (a.cast("int") <= 12) & (b.cast("int") <= 12)
        return F.when(t.rlike(slash), F.struct(small.alias("small"), shown(F.when(month_first, _date(y, a, b)).otherwise(_date(y, b, a))).alias("day")))

    def ladder(p: Column) -> Column:
        t, v, where, doubt = p["t"], p["n"]["value"], p["n"]["locale"], p["n"]["ambiguous"]
        integral = v == F.floor(v)
        rule = F.when(t.isNull() | (t == ""), out("empty", 1.0)).when(p["ymd"] & p["whole"].isNotNull(), out("date", 0.99, "zh-CN", val=p["whole"])).when(p["ymd"], out("date", 0.2, "zh-CN", ambiguous=True, reason="invalid_date"))
        if locale not in ("en-US", "en-CA", "en-GB", "zh-CN"):
            rule = rule.when(p["slash"]["small"], out("date", 0.4, None, ambiguous=True, reason="ambiguous_day_month"))
        rule = rule.when(p["slash"]["day"].isNotNull(), out("date", 0.95 if locale else 0.9, val=p["slash"]["day"])).when(p["slash"].isNotNull(), out("date", 0.2, ambiguous=True, reason="invalid_date"))
        if named["date"]:
            day = shown(F.date_add(F.to_date(F.lit(_EPOCH)), F.when(v.between(1, 2958465), v).cast("int")))
            rule = rule.when(v.between(1, 2958465) & integral, out("excel_serial_date", 0.94, val=day))
        rule = rule.when(v.isNotNull() & t.rlike(r"^0\d+$"), out("text_identifier", 0.7, val=t, reason="leading_zero_candidate"))
        percent = F.endswith(t, F.lit("%"))
        share = plain_decimal(F.when(percent, v / 100).otherwise(v))
        rule = rule.when(v.isNotNull() & (F.lit(named["percent"]) | percent), out("percentage", 0.96, where, "percent", share, doubt))
        rule = rule.when(v.isNotNull() & (F.lit(named["money"]) | t.rlike("[$¥￥€£]")), out("decimal", 0.94, where, "currency", plain_decimal(v), doubt))
        rule = rule.when(v.isNotNull() & integral, out("integer", 0.88, where, None, plain_decimal(v), doubt, "text_number"))
        rule = rule.when(v.isNotNull(), out("decimal", 0.88, where, None, plain_decimal(v), doubt, "text_number"))
        return rule.otherwise(out("text", 0.9, val=t))

    def prepared(t: Column) -> Column:
        whole = F.when(t.rlike(ymd), shown(_date(*[_part(t, ymd, k) for k in (1, 2, 3)])))
        return F.struct(t.alias("t"), F.coalesce(t.rlike(ymd), F.lit(False)).alias("ymd"), whole.alias("whole"), slashed(t).alias("slash"), number(t, locale).alias("n"))

    return let(text, lambda t: let(prepared(t), ladder))


def review_reasons(least: float = C.LEAST_CONFIDENCE) -> Column:
    """Why a record needs review: missing fields in order, then the date, then its confidence; NaN counts as none."""
    missing = [F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", F.lit(f"missing:{f}")) for f in C.REQUIRED]
    wrong = lambda d: F.when(d["ambiguous"], F.concat(F.lit("ambiguous:event_date:"), d["reason"])).when(~d["type"].isin("date", "datetime", "excel_serial_date"), F.lit("invalid:event_date"))
    dated = let(infer("event_date", F.col("event_date")), wrong)
    confidence = F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return F.array_compact(F.array(*missing, dated, F.when(confidence < least, F.lit("low_confidence"))))
