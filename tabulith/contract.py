"""The record contract and the closed vocabularies that results are made of."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("location", "event_date", "identifier", "category")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "source_file", "source_sheet")]
    + [T.StructField("source_row", T.IntegerType()), T.StructField("source_region", T.StringType()), T.StructField("amount", T.DecimalType(38, 10)), T.StructField("currency", T.StringType())]
)

# Header words of each field, what is required, the order in which currencies are looked for, what names say of a
# field, words that mean the same, states, rules and thresholds.
FIELD_ALIASES = {
    "location": ("location", "site", "facility", "address"),
    "event_date": ("event date", "date", "inspection date", "date time", "datetime", "timestamp", "period", "cycle date", "reporting period"),
    "identifier": ("identifier", "id", "asset id", "record id", "code"),
    "category": ("category", "type", "inspection type", "event type"),
    "confidence": ("confidence", "score"),
    "amount": ("amount", "gross pay", "pay", "price", "cost", "total"),
    "currency": ("currency", "currency code", "iso currency"),
}
REQUIRED = ("location", "event_date", "identifier", "category")
CURRENCY_TOKENS = (("CA$", "CAD"), ("US$", "USD"), ("CAD", "CAD"), ("USD", "USD"), ("CNY", "CNY"), ("EUR", "EUR"), ("€", "EUR"), ("¥", "¥"), ("￥", "￥"), ("$", "$"))
CURRENCY_MAY_BE = {"$": ("CAD", "USD", "$"), "¥": ("CNY", "¥"), "￥": ("CNY", "￥")}
IDENTIFIER_NAME = r"(?i)(^|[_\s-])(id|identifier|code|postal|postcode|zip|phone|telephone|mobile|employee|customer|client)([_\s-]|$)"
DATE_NAME = r"(?i)(^|[_\s-])(date|datetime|timestamp|日期|时间)([_\s-]|$)"
PERCENT_NAME = r"(?i)(^|[_\s-])(percent|percentage|rate|pct|百分比|比例)([_\s-]|$)"
CURRENCY_NAME = r"(?i)(^|[_\s-])(amount|price|cost|salary|pay|revenue|total|金额|价格|工资)([_\s-]|$)"
SYNONYMS = {"staff": "employee", "personnel": "employee", "worker": "employee", "number": "id", "no": "id", "code": "id"}

STATUSES = ("written", "accepted", "review", "rejected", "skipped_existing")
RULES = {"configured_exact": 1.0, "casefold_exact": 0.99, "normalized_exact": 0.97}
LEAST_CONFIDENCE, LEAST_RATIO = 0.85, 0.78
HEADER_ROWS, ENUM_CAP, SAMPLES, SAMPLE_ROWS = 20, 20, 5, 20
