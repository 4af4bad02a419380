"""Identity, first-seen dedup and tiered matching of records to destinations."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import contract as C
from tabulith.functions import text as X

def with_record_id(records: DataFrame, row_independent: bool = False) -> DataFrame:
    """record_id from source, identifier, date, location and category; row_independent leaves the source out."""
    fields = ["identifier", "event_date", "location", "category"]
    return records.withColumn("record_id", X.record_id(*[X.identity_key(F.col(f)) for f in (fields if row_independent else ["source", *fields])]))


def first_seen(records: DataFrame, order: str = "row_index") -> DataFrame:
    """duplicate: whether an earlier record has the same record_id."""
    at = F.row_number().over(Window.partitionBy("record_id").orderBy(order))
    return records.withColumn("duplicate", at > 1)


def aliases(destinations: DataFrame) -> DataFrame:
    """(destination, alias, pos): the key first, then the aliases in order."""
    names = F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))
    return destinations.select(F.col("key").alias("destination"), F.posexplode(names).alias("pos", "alias"))


KINDS = ((0, "configured_exact", lambda c: c), (1, "casefold_exact", X.identity_key), (2, "normalized_exact", X.match_key))


def _keyed(destinations: DataFrame) -> DataFrame:
    """(rank, k, hits): for each rule and key the destinations whose aliases have it, of each the first alias."""
    keys = F.array(*[F.struct(F.lit(rank).alias("rank"), key(F.col("alias")).alias("k")) for rank, _, key in KINDS])
    each = aliases(destinations).select("destination", "pos", "alias", F.explode(keys).alias("x")).select("destination", "pos", "alias", "x.*").where("k <> ''")
    one = each.groupBy("rank", "k", "destination").agg(F.min_by("alias", "pos").alias("alias"))
    return one.groupBy("rank", "k").agg(F.array_sort(F.collect_list(F.struct("destination", "alias"))).alias("hits"))


def tiered(rows: DataFrame, destinations: DataFrame) -> DataFrame:
    """rows (location and more) with rule, rule_rank and candidates: of the first rule that any alias meets.

    A key has one row of destinations, so each rule is a lookup that multiplies nothing: where the
    destinations are few, Spark broadcasts them and the records stay where they are. Of a destination's
    aliases the first counts. Empty keys match nothing.
    """
    named, out = _keyed(destinations), rows
    for rank, _, key in KINDS:
        side = named.where(F.col("rank") == rank).select(F.col("k").alias(f"_k{rank}"), F.col("hits").alias(f"_h{rank}"))
        out = out.withColumn("_key", key(F.col("location"))).join(side, F.col("_key") == F.col(f"_k{rank}"), "left").drop("_key", f"_k{rank}")
    first = lambda value: F.coalesce(*[F.when(F.col(f"_h{rank}").isNotNull(), value(rank, rule)) for rank, rule, _ in KINDS])
    columns = [first(lambda rank, rule: F.lit(rule)).alias("rule"), first(lambda rank, rule: F.lit(rank)).alias("rule_rank"), first(lambda rank, rule: F.col(f"_h{rank}")).alias("candidates")]
    return out.select(*rows.columns, *columns)


def tiers(values: DataFrame, destinations: DataFrame) -> DataFrame:
    """(location, rule, rule_rank, candidates) of the distinct locations that a rule matches."""
    return tiered(values.select("location").distinct(), destinations).where("rule is not null")


@F.pandas_udf(T.DoubleType())
def _ratio(values: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(values, names, strict=True)], dtype="float64")


#: Letters from rare to frequent in names; what is not listed is rarer still. Any order gives the same result.
RARE = "zqxjkvbpygfwmucldrhsnioate"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(keys: pd.Series) -> pd.Series:
    """The letters of each key, each with how often it came before, from rare to frequent."""

    def one(k: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for c in k:
            seen[c] = seen.get(c, 0) + 1
            out.append((-seen[c], RARE.find(c), c))
        return [f"{c}{-n}" for n, _, c in sorted(out)]

    return keys.map(one)


def fuzzy(values: DataFrame, destinations: DataFrame, least: float = C.LEAST_RATIO) -> DataFrame:
    """(location, destination, alias, ratio): the best similarity of at least `least` for each destination.

    The ratio of two names of a and b letters is at most 2 c / (a + b) for c letters in common, each
    counted as often as both have it. So lengths are within a factor of (2 - least) / least, c is at
    least `least` / 2 * (a + b), and the first letters of either, from rare to frequent, as many as it
    can lack and one more, hold one of the other's: names are joined on length and such a letter, the
    letters in common are counted, and only what is left is compared.
    """
    lack = lambda n: F.size(n) - F.ceil(F.size(n) * (least / (2 - least)) - 1e-9).cast("int") + 1
    left = values.select("location", X.match_key(F.col("location")).alias("k")).where("k <> ''").distinct().withColumn("a", _letters("k"))
    right = aliases(destinations).select("destination", "pos", "alias", X.match_key(F.col("alias")).alias("n")).where("n <> ''").distinct().withColumn("b", _letters("n"))
    low, high = F.ceil(F.size("a") * (least / (2 - least)) - 1e-9), F.floor(F.size("a") * ((2 - least) / least) + 1e-9)
    probes = left.withColumn("len", F.explode(F.sequence(low.cast("int"), F.greatest(high, low).cast("int")))).withColumn("letter", F.explode(F.slice("a", F.lit(1), lack("a"))))
    index = right.withColumn("len", F.size("b")).withColumn("letter", F.explode(F.slice("b", F.lit(1), lack("b"))))
    near = probes.join(index, ["len", "letter"]).drop("len", "letter").distinct()
    near = near.where(F.size(F.array_intersect("a", "b")) >= (F.size("a") + F.size("b")) * (least / 2) - 1e-9)
    scored = near.withColumn("ratio", _ratio("k", "n")).where(F.col("ratio") >= least)
    return scored.groupBy("location", "destination").agg(F.max(F.struct("ratio", "alias")).alias("m")).select("location", "destination", "m.alias", "m.ratio")


def matched(records: DataFrame, destinations: DataFrame, confirmations: DataFrame | None = None, use_fuzzy: bool = True, places: DataFrame | None = None) -> DataFrame:
    """records (record_id, duplicate, location) with match_status, rule, destination, candidates, match_confidence, match_reason.

    Duplicates have none; a confirmation (record_id, target) comes before the rules; a fuzzy hit is a
    suggestion and never accepted. places: rows whose locations are those of records at least, where
    these are cheaper to read (names that no record has in the end cost a comparison, no result).
    """
    out = tiered(records, destinations)
    if use_fuzzy:
        near = fuzzy(tiered((records if places is None else places).select("location").distinct(), destinations).where("rule is null"), destinations)
        near = near.groupBy("location").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("s"), "destination", "alias"))).alias("near"))
        out = out.join(near, "location", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("array<struct<s:double,destination:string,alias:string>>"))
    if confirmations is not None:
        known = destinations.select(F.col("key").alias("target"), F.lit(True).alias("known"))
        out = out.join(confirmations.select("record_id", "target").dropDuplicates(["record_id"]).join(known, "target", "left"), "record_id", "left")
    else:
        out = out.withColumn("target", F.lit(None).cast("string")).withColumn("known", F.lit(None).cast("boolean"))
    one = F.size("candidates") == 1
    status = (
        F.when(F.col("duplicate"), "duplicate")
        .when(F.col("target").isNotNull(), F.when(F.col("known"), "matched").otherwise("review"))
        .when(F.col("rule").isNotNull(), F.when(one, "matched").otherwise("conflict"))
        .when(F.col("near").isNotNull(), "review")
        .otherwise("unmatched")
    )
    reason = (
        F.when(F.col("duplicate"), "duplicate_record_id")
        .when(F.col("target").isNotNull(), F.when(F.col("known").isNull(), "confirmation_target_missing"))
        .when(F.col("rule").isNotNull(), F.when(~one, "multiple_destinations"))
        .when(F.col("near").isNotNull(), "fuzzy_requires_review")
        .otherwise("no_match")
    )
    sure = F.create_map(*[F.lit(x) for pair in C.RULES.items() for x in pair])
    confirmed = F.col("target").isNotNull() & F.coalesce("known", F.lit(False))
    return out.select(
        *records.columns,
        status.alias("match_status"),
        F.when(confirmed & ~F.col("duplicate"), "human_confirmation").when(~F.col("duplicate"), F.coalesce("rule", F.when(F.col("near").isNotNull(), "fuzzy_candidate"))).alias("rule"),
        F.when(status == "matched", F.when(confirmed, F.col("target")).otherwise(F.col("candidates")[0]["destination"])).alias("destination"),
        F.when(~F.col("duplicate"), F.coalesce(F.transform("candidates", lambda c: c.destination), F.transform("near", lambda c: c.destination))).alias("candidates"),
        F.when(confirmed, 1.0).when(F.col("rule").isNotNull(), F.try_element_at(sure, F.col("rule"))).otherwise(-F.col("near")[0]["s"]).alias("match_confidence"),
        reason.alias("match_reason"),
    )
