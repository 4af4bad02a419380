"""Display formats: they name how a value is shown and never change it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DECIMALS = {"amount": 2, "exchange_rate": 6, "hours": 2, "headcount": 0, "percentage": 2, "tax_rate": 2}
SYMBOLS = {"CAD": "CA$", "USD": "US$", "CNY": "¥", "EUR": "€"}


class FormatError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def kind_of(name: str) -> str:
    """What a field's name says that its numbers are."""
    low = name.strip().lower()
    for kind, words in (("exchange_rate", ("exchange", "fx_rate", "currency_rate")), ("percentage", ("percent", "pct"))):
        if any(w in low for w in words):
            return kind
    if "tax" in low and "rate" in low:
        return "tax_rate"
    for kind, words in (("hours", ("hour",)), ("headcount", ("headcount", "people", "persons")), ("amount", ("amount", "pay", "price", "cost", "total", "revenue"))):
        if any(w in low for w in words):
            return kind
    raise FormatError("format_kind_confirmation_required", f"declare what {name} is")


def code(kind: str, decimals: int | None = None, currency: str | None = None, negative: str = "standard", as_code: bool = False) -> str:
    """The format code of a kind of number."""
    zeros = "0" + ("." + "0" * n if (n := DECIMALS[kind] if decimals is None else decimals) else "")
    share = kind in ("percentage", "tax_rate")
    body, token = (zeros + "%", "") if share else ("#,##" + zeros, "")
    if kind == "amount":
        if currency is None:
            raise FormatError("currency_confirmation_required", "an amount needs its currency")
        if currency not in SYMBOLS:
            raise FormatError("ambiguous_currency_symbol" if currency in ("$", "¥", "￥") else "unsupported_currency", currency)
        token = f'"{currency if as_code else SYMBOLS[currency]}"'
    shown = token + body
    if negative == "accounting":
        return f'_({token}* {body}_);_({token}* \\({body}\\);_({token}* "-"??_);_(@_)'
    below = {"standard": f"-{shown}", "red": f"[Red]-{shown}"}.get(negative, f"({shown})")
    return f"{shown};{below};{shown}"


def shown(value: Column, kind: str, decimals: int | None = None, currency: str | None = None) -> Column:
    """The text that the standard code shows."""
    n = DECIMALS[kind] if decimals is None else decimals
    scaled = F.abs(value) * 100 if kind in ("percentage", "tax_rate") else F.abs(value)
    text = F.format_number(scaled.cast("decimal(38,10)"), n)
    if kind in ("percentage", "tax_rate"):
        text = F.concat(F.replace(text, F.lit(",")), F.lit("%"))
    if kind == "amount" and currency:
        text = F.concat(F.lit(SYMBOLS[currency]), text)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def one_currency(column: str, declared: str | None = None) -> Column:
    """Aggregate: the currency of all rows, or the code of why there is none."""
    seen = F.collect_set(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)))
    told = F.lit(declared)
    return F.when(F.size(seen) > 1, "mixed_currency_confirmation_required").when((F.size(seen) == 1) & told.isNotNull() & (seen[0] != told), "currency_conflict_confirmation_required").when(F.size(seen) == 1, seen[0]).otherwise(F.coalesce(told, F.lit("currency_confirmation_required")))
