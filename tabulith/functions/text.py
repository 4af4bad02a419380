"""Text normalizers as Column expressions; Unicode folding falls back to Arrow only off ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.contract import SYNONYMS

_ASCII = r"^[\x00-\x7F]*$"
#: Names of devices.
_RESERVED = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def header(value: Column) -> Column:
    """Trimmed, lower case, underscores as spaces, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(value, F.lit("")), F.lit("_"), F.lit(" "))), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _fold_alnum(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKC", v).casefold() if c.isalnum()))


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def match_key(value: Column, unicode: bool = True) -> Column:
    """Compatibility form, case folded, letters and digits only."""
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return F.when(value.rlike(_ASCII), plain).otherwise(_fold_alnum(value)) if unicode else plain


def identity_key(value: Column, unicode: bool = True) -> Column:
    """Compatibility form, case folded, trimmed, white space collapsed."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.when(value.rlike(_ASCII), plain).otherwise(_fold(value)) if unicode else plain


def record_id(*parts: Column) -> Column:
    """rec_ and twenty hex digits of the parts' identity."""
    return F.concat(F.lit("rec_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 20))


def canonical_field(name: Column) -> Column:
    """Letters and digits of any script, lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def semantic_tokens(name: Column) -> Column:
    """Distinct words of a field name, synonyms as one."""
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"([a-z0-9]+)")), lambda t: F.coalesce(F.try_element_at(known, t), t)))


# What people append to a file name for one more version.
_DECORATIONS = (
    r"\s*\(\d+\)",
    r"\s*-\s*copy(?:\s*\(\d+\))?",
    r"[\s_-]*(?:final|latest|new|old|draft)",
    r"[\s_-]*(?<![A-Za-z])v\d+(?:\.\d+)*",
    r"[\s_-]*(?:rev|version|ver)[\s_-]*\d+(?:\.\d+)*",
    r"[\s_-]*(?:最终版?|最新版?|终版|定稿|副本|修订版?)",
)


def version_key(name: Column) -> Column:
    """The stem without version decorations, however many there are, separators as one space, lower case.

    Decorations go while something is left before them, so that a name of decorations alone keeps one.
    """
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    tail = r"(?i)(?<=[^\s_-])(?:" + "|".join(f"(?:{d}[\\s_-]*)" for d in _DECORATIONS) + ")+$"
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(stem, tail, ""), r"[\s_-]+", " ")))


def csv_safe(value: Column) -> Column:
    """Text that a spreadsheet would run gets a leading apostrophe."""
    return F.when(value.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def sheet_file_names(sheets: DataFrame, suffix: str = ".csv") -> DataFrame:
    """sheets (sheet_index, sheet) with file: portable names, told apart by -2, -3, .. where they agree but for case."""
    clean = F.regexp_replace(F.regexp_replace("sheet", r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    clean = F.when(F.trim(clean) == "", "sheet").otherwise(clean)
    clean = F.when(F.upper(clean).rlike(_RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    n = F.row_number().over(Window.partitionBy(F.lower("c")).orderBy("sheet_index"))
    named = sheets.withColumn("c", clean).withColumn("n", n)
    return named.withColumn("file", F.concat("c", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(suffix))).drop("c", "n")


def file_component(value: Column) -> Column:
    """A portable file name: illegal characters and runs of dashes as one dash, no trailing dot or space, reserved names marked."""
    clean = F.regexp_replace(F.rtrim(F.trim(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', "-"))), r"[. ]+$", "")
    clean = F.regexp_replace(clean, "-+", "-")
    return F.when(F.upper(clean).rlike(_RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
