"""Column profiles, field reports and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith import contract as C
from tabulith.functions import text as X
from tabulith.functions.values import infer


def cells(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(field, position, seq, value): one row for each cell, a single pass over the input."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("position"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return rows.select(F.col(order).alias("seq"), F.explode(each).alias("c")).select("c.field", "c.position", "seq", "c.value")


def inferred(rows: DataFrame, fields: list[str], order: str, locale: str | None = None) -> DataFrame:
    """(field, position, seq, value, inf): each cell with what is inferred of it."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("position"), F.col(f).cast("string").alias("value"), infer(f, F.col(f).cast("string"), locale).alias("inf")) for i, f in enumerate(fields)])
    return rows.select(F.col(order).alias("seq"), F.explode(each).alias("c")).select("c.field", "c.position", "seq", "c.value", "c.inf")


def field_report(cells_: DataFrame) -> DataFrame:
    """The dominant type of each field (the first seen of equals), its confidence times purity, unit, locale and counts.

    Empty values are left out.
    """
    cells_ = cells_.where("value is not null and value <> ''")

    zeros = F.coalesce(F.col("inf.reason").isin("leading_zero_identifier", "leading_zero_candidate"), F.lit(False))
    kinds = cells_.groupBy("field", "inf.type", "inf.unit", "inf.locale").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.sum("inf.confidence").alias("c"), F.count_if(F.col("inf.confidence") < 0.8).alias("low"), F.count_if("inf.ambiguous").alias("amb"), F.max(zeros).alias("zeros"),
    )
    each = kinds.groupBy("field").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("amb").alias("amb"), F.max("zeros").alias("zeros"), F.collect_list(F.struct("type", "unit", "locale", "n", "first")).alias("k"),
    )  # a few kinds for each field

    def mode(what: str) -> tuple[Column, Column]:
        """The value that most cells have, the first seen of equals, and its count."""
        values = F.array_distinct(F.filter(F.transform("k", lambda x: x[what]), lambda v: v.isNotNull()))
        summed = F.transform(values, lambda v: F.struct(F.aggregate(F.filter("k", lambda x: x[what] == v), F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n"), (-F.array_min(F.transform(F.filter("k", lambda x: x[what] == v), lambda x: x.first))).alias("first"), v.alias("v")))
        best = F.array_max(summed)
        return best["v"], best["n"]

    kind, most = mode("type")
    return each.select(
        "field", kind.alias("inferred_type"), F.round(F.col("c") / F.col("n") * most / F.col("n"), 3).alias("confidence"), F.col("n").alias("sample_count"), F.col("low").alias("low_confidence_count"),
        F.col("amb").alias("ambiguous_count"), F.col("zeros").alias("leading_zero_preserved"), mode("unit")[0].alias("unit"), mode("locale")[0].alias("locale"),
    )


def column_profile(cells_: DataFrame) -> DataFrame:
    """(field, position, types, required, distinct_values, samples, enum): samples are the first five distinct of the first twenty populated values."""
    has = F.coalesce(F.trim("value"), F.lit("")) != ""
    out = cells_.groupBy("field", "position").agg(
        F.array_sort(F.collect_set(F.when(has, F.col("inf.type")))).alias("types"), F.count_if(~has).alias("blank"), F.count_distinct(F.when(has, F.col("value"))).alias("distinct_values"),
    )
    filled = cells_.where(has)
    early = filled.select("field", "seq", "value", F.row_number().over(Window.partitionBy("field").orderBy("seq")).alias("n")).where(F.col("n") <= C.SAMPLE_ROWS)  # each task sends so many rows of a field
    samples = early.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("s")).select("field", F.slice(F.array_distinct(F.transform("s", lambda x: x.value)), 1, C.SAMPLES).alias("samples"))
    values = filled.select("field", "value").distinct().select("field", "value", F.row_number().over(Window.partitionBy("field").orderBy("value")).alias("n")).where(F.col("n") <= C.ENUM_CAP + 1)
    few = values.groupBy("field").agg(F.count("*").alias("k"), F.array_sort(F.collect_list("value")).alias("enum")).where(F.col("k") <= C.ENUM_CAP).select("field", "enum")
    out = out.join(samples, "field", "left").join(few, "field", "left")
    return out.select("field", "position", "types", (F.col("blank") == 0).alias("required"), "distinct_values", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "enum")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, kind): what changed between two profiles, joined in full on the canonical names."""
    a = old.select(X.canonical_field(F.col("field")).alias("k"), F.struct("field", "position", "types", "required", "enum").alias("a"))
    b = new.select(X.canonical_field(F.col("field")).alias("k"), F.struct("field", "position", "types", "required", "enum").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    text = F.array(F.lit("text"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("b").isNull(), "field_removed"),
            F.when(F.col("a").isNull(), "field_added"),
            F.when(both & (F.col("a.field") != F.col("b.field")), "field_renamed"),
            F.when(both & (F.col("a.position") != F.col("b.position")), "field_reordered"),
            F.when(both & (F.col("a.types") != F.col("b.types")), "field_type_changed"),
            F.when(both & (F.col("a.required") != F.col("b.required")), "field_required_changed"),
            F.when(both & (F.col("a.types") == text) & (F.col("b.types") == text) & (F.col("a.enum") != F.col("b.enum")), "field_enum_changed"),
        )
    )
    return a.join(b, "k", "full_outer").select(F.col("k").alias("field"), F.explode(kinds).alias("kind"))


def sheet_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sheet, kind) of sheets that only one of two workbooks has."""
    a, b = old.select("sheet").distinct().withColumn("a", F.lit(True)), new.select("sheet").distinct().withColumn("b", F.lit(True))
    kind = F.when(F.col("a").isNull(), "sheet_added").when(F.col("b").isNull(), "sheet_removed")
    return a.join(b, "sheet", "full_outer").select("sheet", kind.alias("kind")).where("kind is not null")


def grain_drift(old: DataFrame, new: DataFrame, by: str, key: Column, least: float = 0.01) -> DataFrame:
    """(by, before, after) where the rows for each distinct key changed by more than `least`."""
    ratio = lambda df, name: df.groupBy(by).agg((F.count("*") / F.greatest(F.count_distinct(key), F.lit(1))).alias(name))
    return ratio(old, "before").join(ratio(new, "after"), by).where(F.abs(F.col("after") - F.col("before")) > least)


#: Changes that stop a delivery until somebody has looked at them.
BLOCKING = ("sheet_added", "sheet_removed", "field_added", "field_removed", "grain_changed")


def drift_blocked(changes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(blocked): whether any change is a blocking one or any rename is suggested. One row."""
    a = changes.agg(F.coalesce(F.bool_or(F.col("kind").isin(*BLOCKING)), F.lit(False)).alias("a"))
    b = suggestions.agg((F.count("*") > 0).alias("b"))
    return a.join(b, F.lit(True)).select((F.col("a") | F.col("b")).alias("blocked"))  # one row each


def drift_report(changes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(document): the changes by field, possible renames and whether they block, as one JSON text."""
    listed = changes.groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).agg(F.array_sort(F.collect_list(F.struct("field", "kinds"))).alias("changes"))  # as many as there are fields
    renamed = suggestions.agg(F.array_sort(F.collect_list(F.struct("old", "new", "overlap"))).alias("suggestions"))
    rows = listed.join(renamed, F.lit(True)).join(drift_blocked(changes, suggestions), F.lit(True))
    return rows.select(F.to_json(F.struct("changes", "suggestions", "blocked")).alias("document"))


def workbook_cells(cells: DataFrame) -> DataFrame:
    """Cells of workbooks (sources.workbook.cells) as (sheet, field, position, seq, value, inf): row 1 names the fields."""
    head = cells.where("row = 1 and value <> ''").select("file", "sheet", "col", F.col("value").alias("field"))
    body = cells.where("row > 1").join(head, ["file", "sheet", "col"])
    plain = F.when(F.col("kind") == "n", F.regexp_replace(F.col("value"), r"\.0$", "")).otherwise(F.col("value"))
    kind = F.when(F.trim("value") == "", "empty").when(F.col("kind") == "d", "date").when(F.col("kind") == "n", F.when(F.col("value").rlike(r"^-?\d+(\.0+)?$"), "integer").otherwise("decimal")).when(F.col("kind") == "b", "boolean").otherwise("text")
    return body.select("file", "sheet", "field", (F.col("col") - 1).alias("position"), F.col("row").alias("seq"), plain.alias("value"), F.struct(kind.alias("type")).alias("inf"))


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(old, new, overlap): possible renames among fields (field, position, types): half of the words, or place and a type, in common.

    Fields meet on a word or a place that they share, never all with all.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        tokens = X.semantic_tokens(F.col("field"))
        keys = F.concat(tokens, F.array(F.concat(F.lit("#"), F.col("position").cast("string"))))
        return df.select(F.col("field").alias(name), tokens.alias(f"{name}_tokens"), F.col("position").alias(f"{name}_position"), F.col("types").alias(f"{name}_types"), F.explode(keys).alias("k"))

    pairs = keyed(removed, "old").join(keyed(added, "new"), "k").drop("k").distinct()
    overlap = F.size(F.array_intersect("old_tokens", "new_tokens")) / F.greatest(F.size(F.array_union("old_tokens", "new_tokens")), F.lit(1))
    placed = (F.col("old_position") == F.col("new_position")) & F.arrays_overlap("old_types", "new_types")
    return pairs.withColumn("overlap", overlap).where((F.col("overlap") >= 0.5) | placed).select("old", "new", "overlap")


def grain(rows: DataFrame, key: Column) -> DataFrame:
    """Rows for each distinct key."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.count("*") / F.greatest(F.count_distinct(key), F.lit(1))).alias("ratio"))
