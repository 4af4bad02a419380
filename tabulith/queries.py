"""The driver's queries over the engine's own operators, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import delivery_queries, workbook_queries
from tabulith import messy as M
from tabulith.functions import text as X
from tabulith.functions import values as V
from tabulith.operators import ambiguity, catalog, fingerprint, formulas, health, match, profile, route
from tabulith.plans import formats, periods

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy records to terminal states, counted."""
    return status_counts(spark, sf_dir)


def joined(array: str | Column) -> Column:
    return F.array_join(array, ",")


@query("SELECT part_name AS name, trim(regexp_replace(lower(replace(part_name, '_', ' ')), '\\s+', ' ', 'g')) AS header FROM (SELECT '  ' || p_brand || '_' || p_name || ' ' AS part_name FROM part)")
def hdr_normalize(spark, sf_dir):
    rows = M.table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_brand", F.lit("_"), "p_name", F.lit(" ")).alias("name"))
    return rows.select("name", X.header(F.col("name")).alias("header"))


@query(M.sql(M.RECORDS, select="""SELECT row_index, CAST(try_cast(replace(replace(replace(replace(amount_text, ',', ''), 'US$', ''), 'CA$', ''), '$', '') AS DECIMAL(38, 10)) AS DOUBLE) AS amount,
  CASE WHEN amount_text LIKE '%CA$%' THEN 'CAD' WHEN amount_text LIKE '%US$%' THEN 'USD' WHEN amount_text LIKE '%$%' THEN '$' END AS detected FROM recs"""))  # fmt: skip
def amount_parse(spark, sf_dir):
    text = F.col("amount_text")
    return M.records(spark, sf_dir).select("row_index", V.amount(text).cast("double").alias("amount"), V.detected_currency(text).alias("detected"))


@query(M.sql(M.RECORDS, select="""SELECT row_index, CASE WHEN det IS NOT NULL AND decl IS NOT NULL THEN CASE WHEN det = decl OR (det = '$' AND decl IN ('CAD', 'USD', '$')) THEN decl ELSE 'conflict' END ELSE coalesce(decl, det, '') END AS currency
  FROM (SELECT row_index, CASE WHEN amount_text LIKE '%CA$%' THEN 'CAD' WHEN amount_text LIKE '%US$%' THEN 'USD' WHEN amount_text LIKE '%$%' THEN '$' END AS det, nullif(upper(trim(currency_text)), '') AS decl FROM recs)"""))  # fmt: skip
def currency_resolve(spark, sf_dir):
    return M.records(spark, sf_dir).select("row_index", V.resolved_currency(V.detected_currency(F.col("amount_text")), V.currency_evidence(F.col("currency_text"))).alias("currency"))


@query(M.sql(M.RECORDS, select="""SELECT row_index, CASE WHEN regexp_matches(event_date, '^\\d{4}[/-]') THEN replace(event_date, '/', '-')
  WHEN regexp_matches(event_date, '^\\d{2}/\\d{2}/\\d{4}$') THEN coalesce(strftime(try_strptime(event_date, '%m/%d/%Y'), '%Y-%m-%d'), strftime(try_strptime(event_date, '%d/%m/%Y'), '%Y-%m-%d')) ELSE event_date END AS iso FROM recs"""))  # fmt: skip
def date_ingest_ladder(spark, sf_dir):
    return M.records(spark, sf_dir).select("row_index", V.ingest_date(F.col("event_date")).alias("iso"))


@query(M.sql(M.RECORDS, M.DATED, select="SELECT row_index, type, CAST(type_confidence AS DOUBLE) AS confidence, ambiguous, value FROM inferred"))
def infer_value_ladder(spark, sf_dir):
    rows = M.records(spark, sf_dir).select("row_index", V.infer("event_date", F.col("event_date")).alias("i"))
    return rows.select("row_index", "i.type", "i.confidence", "i.ambiguous", "i.value")


_NUMBER = """n AS (SELECT row_index, locale_case, t, CASE WHEN comma > 0 AND dot > 0 THEN CASE WHEN comma < dot THEN ',' ELSE '.' END WHEN comma = 4 THEN '.' WHEN comma > 0 THEN ',' ELSE '.' END AS mark,
  comma > 0 AND dot = 0 AND comma = 4 AS amb FROM (SELECT row_index, row_index % 3 AS locale_case, t, instr(reverse(t), ',') AS comma, instr(reverse(t), '.') AS dot FROM
  (SELECT row_index, CASE row_index % 3 WHEN 0 THEN replace(replace(replace(s, ',', '#'), '.', ','), '#', '.') WHEN 1 THEN s ELSE regexp_replace(s, '\\.\\d\\d$', '') END AS t FROM
  (SELECT row_index, replace(replace(replace(amount_text, 'US', ''), 'CA', ''), '$', '') AS s FROM recs))))"""


@query(M.sql(M.RECORDS, _NUMBER, select="""SELECT row_index, t, CAST(try_cast(CASE WHEN mark = ',' THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END AS DECIMAL(38, 10)) AS DOUBLE) AS value,
  amb AND t <> 'n/a' AS ambiguous FROM n"""))  # fmt: skip
def number_locale_parse(spark, sf_dir):
    s = F.regexp_replace("amount_text", "US|CA|[$]", "")
    k = F.pmod("row_index", F.lit(3))
    t = F.when(k == 0, F.translate(s, ",.", ".,")).when(k == 1, s).otherwise(F.regexp_replace(s, r"\.\d\d$", ""))
    rows = M.records(spark, sf_dir).select("row_index", t.alias("t")).withColumn("n", V.number(F.col("t")))
    return rows.select("row_index", "t", F.col("n.value").cast("double").alias("value"), "n.ambiguous")


_REPORT = ["event_date", "identifier", "category"]
_CELLS = """cells AS (SELECT 'event_date' AS field, row_index AS seq, event_date AS raw, type, type_confidence AS c, ambiguous AS amb, false AS z FROM inferred
  UNION ALL SELECT 'identifier', row_index, identifier, CASE WHEN identifier = '' THEN 'empty' ELSE 'text_identifier' END, CASE WHEN identifier = '' THEN 1.0 ELSE 0.99 END, false, identifier LIKE '0%' FROM inferred
  UNION ALL SELECT 'category', row_index, category, 'text', 0.9, false, false FROM inferred)"""


@query(M.sql(M.RECORDS, M.DATED, _CELLS, """k AS (SELECT field, type, count(*) AS n, min(seq) AS f, sum(c) AS c, count(*) FILTER (c < 0.8) AS low, count(*) FILTER (amb) AS amb, bool_or(z) AS z FROM cells WHERE raw <> '' GROUP BY 1, 2)""",
  select="""SELECT field, arg_max(type, (n, -f)) AS inferred_type, round(CAST(sum(c) / sum(n) * max(n) / sum(n) AS DOUBLE), 3) AS confidence, CAST(sum(n) AS BIGINT) AS sample_count, CAST(sum(low) AS BIGINT) AS low_confidence_count,
  CAST(sum(amb) AS BIGINT) AS ambiguous_count, bool_or(z) AS leading_zero_preserved FROM k GROUP BY field"""))  # fmt: skip
def infer_field_report(spark, sf_dir):
    return profile.field_report(profile.inferred(M.records(spark, sf_dir), _REPORT, "row_index")).drop("unit", "locale")


@query(M.sql(M.RECORDS, M.DATED, select="SELECT row_index, array_to_string(reasons, ',') AS reasons, rejected FROM marked"))
def review_ladder(spark, sf_dir):
    return route.reviewed(M.records(spark, sf_dir)).select("row_index", joined("reasons").alias("reasons"), "rejected")


@query(M.sql(M.RECORDS, M.DATED, select="SELECT CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'review' END AS status, coalesce(reasons[1], '') AS first_reason, count(*) AS n FROM marked GROUP BY 1, 2"))
def review_counts(spark, sf_dir):
    rows = route.reviewed(M.records(spark, sf_dir))
    first = F.coalesce(F.get("reasons", 0), F.lit("")).alias("first_reason")
    return rows.groupBy(F.when(F.size("reasons") == 0, "accepted").otherwise("review").alias("status"), first).agg(F.count("*").alias("n"))


@query(M.sql(M.RECORDS, M.DATED, select="SELECT row_index, record_id FROM marked"))
def record_id(spark, sf_dir):
    return match.with_record_id(M.records(spark, sf_dir)).select("row_index", "record_id")


@query(M.sql(M.RECORDS, M.DATED, select="SELECT row_index, row_number() OVER (PARTITION BY record_id ORDER BY row_index) > 1 AS duplicate FROM marked"))
def dedup_first_seen(spark, sf_dir):
    return match.first_seen(match.with_record_id(M.records(spark, sf_dir))).select("row_index", "duplicate")


@query(M.sql(M.RECORDS, M.DATED, M.DESTINATIONS, M.ROUTED, select="SELECT location, rule, array_to_string(candidates, ',') AS candidates FROM tier"))
def match_tiered(spark, sf_dir):
    good = route.reviewed(M.records(spark, sf_dir)).where("not rejected").select("location").distinct()
    return match.tiers(good, M.destinations(spark, sf_dir)).select("location", "rule", joined(F.transform("candidates", lambda c: c.destination)).alias("candidates"))


@query(M.sql(M.RECORDS, M.DATED, M.DESTINATIONS, M.ROUTED, select="SELECT match_status, match_reason, rule, count(*) AS n FROM matched GROUP BY ALL"))
def match_conflicts(spark, sf_dir):
    good = match.first_seen(match.with_record_id(route.reviewed(M.records(spark, sf_dir)).where("not rejected")))
    return match.matched(good, M.destinations(spark, sf_dir), use_fuzzy=False).groupBy("match_status", "match_reason", "rule").agg(F.count("*").alias("n"))


@query(M.sql(M.RECORDS, M.DATED, M.DESTINATIONS, M.ROUTED, select="""SELECT row_index, CASE WHEN duplicate THEN 'duplicate' WHEN target IS NOT NULL THEN CASE WHEN target IN (SELECT key FROM dest) THEN 'matched' ELSE 'review' END ELSE match_status END AS match_status,
  CASE WHEN duplicate THEN NULL WHEN target IS NOT NULL THEN CASE WHEN target IN (SELECT key FROM dest) THEN target END ELSE destination END AS destination
  FROM (SELECT *, CASE WHEN row_index % 60 = 4 THEN 'NATION_3' WHEN row_index % 60 = 10 THEN 'Nowhere' END AS target FROM matched)"""))  # fmt: skip
def match_confirmed(spark, sf_dir):
    good = match.first_seen(match.with_record_id(route.reviewed(M.records(spark, sf_dir)).where("not rejected")))
    k = F.pmod("row_index", F.lit(60))
    told = good.where("not duplicate").select("record_id", F.when(k == 4, "NATION_3").when(k == 10, "Nowhere").alias("target")).where("target is not null")
    return match.matched(good, M.destinations(spark, sf_dir), told, use_fuzzy=False).select("row_index", "match_status", "destination")


@query()
def match_fuzzy(spark, sf_dir):
    places = M.records(spark, sf_dir).select("location").distinct()
    near = match.fuzzy(places.join(match.tiers(places, M.destinations(spark, sf_dir)), "location", "left_anti"), M.destinations(spark, sf_dir))
    return near.select("location", "destination", "alias", F.round("ratio", 6).alias("ratio"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.routed(M.records(spark, sf_dir), M.destinations(spark, sf_dir), use_fuzzy=False)


_OUT = (M.RECORDS, M.DATED, M.DESTINATIONS, M.ROUTED)


@query(M.sql(*_OUT, select="SELECT row_index, status, destination, array_to_string(reasons, ',') AS reasons FROM outcomes"))
def route_terminal_state(spark, sf_dir):
    return outcomes(spark, sf_dir).select("row_index", "status", "destination", joined("reasons").alias("reasons"))


@query(M.sql(*_OUT, select="""SELECT count(*) AS input, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped_existing') AS skipped_existing FROM outcomes"""))  # fmt: skip
def status_counts(spark, sf_dir):
    return route.status_counts(outcomes(spark, sf_dir))


@query(M.sql(*_OUT, select="SELECT (SELECT count(*) FROM recs) AS input, count(*) AS routed, count(*) = (SELECT count(*) FROM recs) AND count(*) = sum(CASE WHEN status IN ('accepted', 'review', 'rejected') THEN 1 ELSE 0 END) AS conserved FROM outcomes"))
def conservation_check(spark, sf_dir):
    """Records that went in against the sum of all terminal states that came out."""
    n = M.records(spark, sf_dir).agg(F.count("*").alias("input"))
    out = route.status_counts(outcomes(spark, sf_dir)).select((F.col("written") + F.col("accepted") + F.col("review") + F.col("rejected") + F.col("skipped_existing")).alias("routed"))
    return n.join(out, F.lit(True)).select("input", "routed", (F.col("input") == F.col("routed")).alias("conserved"))  # one row each


@query(M.sql(*_OUT, select="""SELECT match_status || '|' || array_to_string(candidates, ',') AS key, array_to_string(candidates, ',') AS candidates, count(*) AS affected, len(list(DISTINCT location)) AS samples
  FROM outcomes WHERE match_status IN ('review', 'conflict') AND len(candidates) > 0 GROUP BY 1, 2"""))  # fmt: skip
def ambiguity_groups(spark, sf_dir):
    groups = ambiguity.grouped(ambiguity.from_outcomes(outcomes(spark, sf_dir)))
    return groups.select("key", joined("candidates").alias("candidates"), "affected", F.col("n_samples").alias("samples"))


@query("""SELECT c_mktsegment AS key, CASE WHEN c_mktsegment < 'C' THEN 'resolved' WHEN c_mktsegment < 'G' THEN 'conflict' WHEN c_mktsegment < 'I' THEN 'unknown' ELSE 'pending' END AS state, count(*) AS affected FROM customer GROUP BY 1, 2""")
def ambiguity_decisions(spark, sf_dir):
    seg = F.col("c_mktsegment")
    items = M.table(spark, sf_dir, "customer").select(seg.alias("key"), F.array(seg).alias("candidates"), F.array("c_name").alias("samples"), F.lit(1).alias("affected"), F.lit(0.9).alias("confidence"), seg.alias("recommendation"), F.col("c_custkey").alias("seq"))
    keys = items.select("key").distinct()
    run = keys.where("key < 'C'").select("key", F.lit("accept").alias("decision"), F.array("key").alias("candidates"))
    saved = keys.where("key < 'I'").select("key", F.when(F.col("key") < "G", "accept").otherwise("unknown").alias("decision"), F.array(F.lit("other")).alias("candidates"))
    return ambiguity.decided(ambiguity.grouped(items), run, saved).select("key", "state", "affected")


def _existing(out: DataFrame) -> DataFrame:
    return out.where("status = 'accepted' and row_index % 3 = 0").select("destination", "record_id")


@query(M.sql(*_OUT, select="SELECT row_index, destination FROM outcomes WHERE status = 'accepted' AND (destination, record_id) NOT IN (SELECT (destination, record_id) FROM outcomes WHERE status = 'accepted' AND row_index % 3 = 0)"))
def antijoin_existing(spark, sf_dir):
    out = outcomes(spark, sf_dir)
    return route.new_records(out, _existing(out)).select("row_index", "destination")


@query(M.sql(*_OUT, select="SELECT row_index, CASE WHEN status = 'accepted' AND row_index % 3 = 0 THEN 'skipped_existing' ELSE status END AS status FROM outcomes"))
def skip_existing(spark, sf_dir):
    before = _existing(outcomes(spark, sf_dir))
    return route.routed(M.records(spark, sf_dir), M.destinations(spark, sf_dir), existing=before, use_fuzzy=False).select("row_index", "status")


@query(M.sql(*_OUT, select="SELECT row_index, destination, CAST(row_number() OVER (PARTITION BY destination ORDER BY row_index) + 1 AS INT) AS target_row FROM outcomes WHERE status = 'accepted'"))
def write_order(spark, sf_dir):
    return route.write_order(outcomes(spark, sf_dir)).select("row_index", "destination", F.col("target_row").cast("int").alias("target_row"))


@query(M.sql(*_OUT, select="""SELECT target, status, count(*) AS n FROM (SELECT unnest(candidates) AS target, status FROM outcomes WHERE status = 'review' UNION ALL SELECT destination, status FROM outcomes WHERE status <> 'review' AND destination IS NOT NULL) GROUP BY 1, 2"""))
def target_counts(spark, sf_dir):
    return route.target_counts(outcomes(spark, sf_dir))


@query(M.sql(*_OUT, select="""SELECT source, count(*) AS records, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped_existing') AS skipped_existing FROM outcomes GROUP BY source"""))  # fmt: skip
def source_counts(spark, sf_dir):
    return route.source_counts(outcomes(spark, sf_dir))


@query(M.sql(*_OUT, select="SELECT destination, count(*) AS expected, count(*) FILTER (row_index % 5 <> 0) AS persisted FROM outcomes WHERE status = 'accepted' GROUP BY 1 HAVING count(*) <> count(*) FILTER (row_index % 5 <> 0)"))
def tab_counts(spark, sf_dir):
    out = outcomes(spark, sf_dir).where("status = 'accepted'")
    count = lambda df: df.groupBy("destination").agg(F.count("*").alias("n"))
    return route.discrepancies(count(out), count(out.where("row_index % 5 <> 0")), "destination")


_PART = ["p_name", "p_brand", "p_type", "p_size"]


@query("""WITH p AS (SELECT p_partkey + 1000 AS seq, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name, p_brand, p_type, p_size FROM part),
  c AS (SELECT 'p_name' AS field, 0 AS position, seq, p_name AS v FROM p UNION ALL SELECT 'p_brand', 1, seq, p_brand FROM p UNION ALL SELECT 'p_type', 2, seq, p_type FROM p UNION ALL SELECT 'p_size', 3, seq, CAST(p_size AS VARCHAR) FROM p),
  e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY seq) AS r FROM c WHERE coalesce(trim(v), '') <> '') WHERE r <= 20),
  s AS (SELECT field, list(v ORDER BY seq) AS l FROM (SELECT field, v, min(seq) AS seq FROM e GROUP BY 1, 2) GROUP BY field)
  SELECT c.field, c.position, CASE c.field WHEN 'p_size' THEN 'integer' ELSE 'text' END AS types, count(*) FILTER (coalesce(trim(v), '') = '') = 0 AS required, count(DISTINCT v) AS distinct_values, array_to_string(any_value(s.l)[1:5], '|') AS samples,
    CASE WHEN count(DISTINCT v) <= 20 THEN array_to_string(list_sort(list(DISTINCT v)), '|') END AS enum FROM c LEFT JOIN s USING (field) GROUP BY 1, 2""")
def column_profile(spark, sf_dir):
    rows = M.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("p_partkey"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name"), "p_brand", "p_type", "p_size")
    got = profile.column_profile(profile.inferred(rows, _PART, "p_partkey"))
    return got.select("field", "position", F.array_join("types", "|").alias("types"), "required", "distinct_values", F.array_join("samples", "|").alias("samples"), F.array_join("enum", "|").alias("enum"))


@query("""SELECT * FROM (VALUES ('pbrand', 'field_renamed'), ('pbrand', 'field_reordered'), ('pname', 'field_reordered'), ('pname', 'field_renamed'), ('ptype', 'field_removed'), ('pretailprice', 'field_added'), ('psize', 'field_type_changed'), ('psize', 'field_renamed')) AS t(field, kind)""")
def drift_full_outer(spark, sf_dir):
    part = M.table(spark, sf_dir, "part")
    new = part.select("p_partkey", F.col("p_brand").alias("P Brand"), F.col("p_name").alias("P Name"), F.col("p_retailprice").alias("P Retailprice"), F.concat("p_size", F.lit(" cm")).alias("P Size"))
    profiled = lambda df, fields: profile.column_profile(profile.inferred(df, fields, "p_partkey"))
    return profile.drift(profiled(part, _PART), profiled(new, ["P Brand", "P Name", "P Retailprice", "P Size"]))


@query("""SELECT * FROM (VALUES ('employee id', 'staff number', CAST(1.0 AS DOUBLE)), ('start date', 'begin date', CAST(1.0 / 3 AS DOUBLE)), ('unit price', 'unit price net', CAST(2.0 / 3 AS DOUBLE))) AS t("old", "new", overlap)""")
def drift_rename_jaccard(spark, sf_dir):
    schema = "field string, position int, types array<string>"
    old = spark.createDataFrame([("employee id", 0, ["text"]), ("start date", 1, ["date"]), ("unit price", 2, ["decimal"]), ("notes", 9, ["text"])], schema)
    new = spark.createDataFrame([("staff number", 5, ["text"]), ("begin date", 1, ["date"]), ("unit price net", 7, ["decimal"]), ("remark", 9, ["integer"])], schema)
    return profile.renames(old, new)


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) / greatest(count(DISTINCT l_orderkey), 1)::DOUBLE AS ratio FROM lineitem")
def grain_ratio(spark, sf_dir):
    return profile.grain(M.table(spark, sf_dir, "lineitem"), F.col("l_orderkey"))


@query("SELECT sha256(text) AS digest, count(*) AS n, arg_min(p, (len(p), p)) AS representative FROM (SELECT text, source || '/' || CAST(doc_id AS VARCHAR) AS p FROM documents) GROUP BY text HAVING count(*) >= 2")
def content_duplicates(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"))
    return catalog.duplicate_groups(docs)


_VERSIONS = """names AS (SELECT 'report ' || CAST(conv_id AS VARCHAR) || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' (1)' WHEN 2 THEN ' - Copy' ELSE '_final' END || '.xlsx' AS name, sha256(text) AS digest, 'report ' || CAST(conv_id AS VARCHAR) AS version_key FROM conversations)"""


@query(f"WITH {_VERSIONS} SELECT version_key, count(*) AS files, count(DISTINCT digest) AS contents FROM names GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT digest) >= 2")
def version_groups(spark, sf_dir):
    t = F.pmod("turn", F.lit(4))
    tail = F.when(t == 0, "").when(t == 1, " (1)").when(t == 2, " - Copy").otherwise("_final")
    rows = M.table(spark, sf_dir, "conversations").select(F.concat(F.lit("report "), F.col("conv_id").cast("string"), tail, F.lit(".xlsx")).alias("name"), F.sha2("text", 256).alias("digest"))
    return catalog.version_groups(rows)


_SUFFIX = """CASE doc_id % 8 WHEN 0 THEN '.xlsx' WHEN 1 THEN ' (1).xlsx' WHEN 2 THEN ' - copy (2).xlsx' WHEN 3 THEN '_FINAL.xlsx' WHEN 4 THEN '-v2.1.xlsx' WHEN 5 THEN ' rev 3.xlsx' WHEN 6 THEN ' final final.xlsx' ELSE '_draft (3).xlsx' END"""


@query(f"SELECT doc_id, 'Pay_Run-' || CAST(doc_id AS VARCHAR) || 'x' || {_SUFFIX} AS name, 'pay run ' || CAST(doc_id AS VARCHAR) || 'x' AS version_key FROM documents")
def version_key(spark, sf_dir):
    name = F.expr(f"concat('Pay_Run-', doc_id, 'x', {_SUFFIX})")
    return M.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("version_key", X.version_key(F.col("name")))


_FILES = """CASE event_id % 8 WHEN 0 THEN '~$book.xlsx' WHEN 1 THEN 'in.csv.part' WHEN 2 THEN 'a (conflicted copy).xlsx' WHEN 3 THEN 'pay template.xlsx' WHEN 4 THEN 'review pack.xlsx' WHEN 5 THEN 'delivered.xlsx' WHEN 6 THEN 'notes.txt' ELSE 'hours.csv' END"""


@query(f"""SELECT classification, disposition, reason, count(*) AS n FROM (SELECT CASE k WHEN 3 THEN 'template' WHEN 4 THEN 'review_return' WHEN 5 THEN 'prior_delivery' WHEN 7 THEN CASE WHEN d < DATE '2024-01-10' THEN 'prior_delivery' WHEN d <= DATE '2024-01-20' THEN 'input' ELSE 'unknown' END ELSE 'unknown' END AS classification,
  CASE k WHEN 2 THEN 'review' WHEN 3 THEN 'review' WHEN 4 THEN 'review' WHEN 7 THEN CASE WHEN d < DATE '2024-01-10' THEN 'exclude' WHEN d <= DATE '2024-01-20' THEN 'include' ELSE 'review' END ELSE 'exclude' END AS disposition,
  CASE k WHEN 0 THEN 'sync_artifact_lock_file' WHEN 1 THEN 'sync_artifact_incomplete_download' WHEN 2 THEN 'sync_artifact_conflict_copy' WHEN 3 THEN 'classified_as_template' WHEN 4 THEN 'classified_as_review_return' WHEN 5 THEN 'classified_as_prior_delivery' WHEN 6 THEN 'unsupported_extension'
    ELSE CASE WHEN d < DATE '2024-01-10' THEN 'historical_outside_current_period' WHEN d <= DATE '2024-01-20' THEN 'current_period_input' ELSE 'modified after the declared current period' END END AS reason
  FROM (SELECT event_id % 8 AS k, CAST(ts AS DATE) AS d FROM events)) GROUP BY ALL""")
def workdir_classify(spark, sf_dir):
    files = M.table(spark, sf_dir, "events").select(F.expr(_FILES).alias("name"), F.col("ts").alias("mtime"), F.lit(True).alias("stable"))
    day = lambda d: F.to_date(F.lit(d))
    return catalog.classified(files, day("2024-01-10"), day("2024-01-20")).groupBy("classification", "disposition", "reason").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS task, o_orderpriority AS component, 'sha256:' || sha256(concat_ws(',', CAST(count(*) AS VARCHAR), CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST(('0x' || substr(h, 31, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(('0x' || substr(h, 46, 15)) AS BIGINT)) AS VARCHAR))) AS digest FROM (SELECT o_orderstatus, o_orderpriority, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) GROUP BY 1, 2""")
def fingerprint_components(spark, sf_dir):
    rows = M.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))
    return fingerprint.fingerprints(rows, "o_orderstatus", "o_orderpriority", "h")


@query("""SELECT c_custkey AS task, CASE WHEN c_custkey % 11 = 0 THEN 'changed' WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'changed' WHEN c_custkey % 7 = 0 THEN 'retry' ELSE 'no_op' END AS decision FROM customer""")
def run_decision(spark, sf_dir):
    rows = M.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.sha2("c_name", 256).alias("fingerprint"))
    now = rows.withColumn("conflict", F.col("task") % 11 == 0)
    last = rows.where("task % 5 <> 0").select("task", F.when(F.col("task") % 3 == 0, "other").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("task") % 7 == 0, "failed").otherwise("succeeded").alias("status"))
    return fingerprint.decided(now, last)


@query("""SELECT task, run, CAST(row_number() OVER (PARTITION BY task, run // 3 ORDER BY run) AS INT) AS attempt FROM (SELECT o_custkey AS task, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS run FROM orders)""")
def run_attempts(spark, sf_dir):
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    rows = M.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), at.alias("run"))
    rows = rows.withColumns({"fingerprint": F.floor(F.col("run") / 3).cast("string"), "status": F.lit("failed")})
    return formulas.runs(rows).select("task", "run", "attempt")


_CELL = """cells AS (SELECT 'part' AS sheet, p_partkey AS row, 1 AS col, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_name WHEN 1 THEN p_name || '  ' WHEN 2 THEN replace(p_name, ' ', '   ') WHEN 3 THEN p_name || chr(8203) WHEN 4 THEN CAST(p_size AS VARCHAR) || ',500.50' ELSE p_name END AS value FROM part)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_name"), F.pmod("p_partkey", F.lit(6))
    value = F.when(k == 0, F.concat(F.lit(" "), n)).when(k == 1, F.concat(n, F.lit("  "))).when(k == 2, F.replace(n, F.lit(" "), F.lit("   "))).when(k == 3, F.concat(n, F.lit("​"))).when(k == 4, F.concat(F.col("p_size").cast("string"), F.lit(",500.50"))).otherwise(n)
    return M.table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), F.col("p_partkey").alias("row"), F.lit(1).alias("col"), value.alias("value"))


@query(f"""WITH {_CELL}, w AS (SELECT row, value, CAST(len(value) - len(regexp_replace(value, '^\\s+', '')) AS INT) AS "leading", CAST(len(value) - len(regexp_replace(value, '\\s+$', '')) AS INT) AS "trailing", regexp_matches(value, '\\S {{2,}}\\S') AS repeated FROM cells)
  SELECT *, regexp_replace(trim(value), ' {{2,}}', ' ', 'g') AS candidate FROM w WHERE "leading" > 0 OR "trailing" > 0 OR repeated""")
def health_whitespace(spark, sf_dir):
    return health.whitespace_findings(_cells(spark, sf_dir)).select("row", "value", "leading", "trailing", "repeated", "candidate")


@query(f"WITH {_CELL} SELECT row, value, replace(value, chr(8203), '') AS candidate FROM cells WHERE contains(value, chr(8203))")
def health_invisible(spark, sf_dir):
    return health.invisible_findings(_cells(spark, sf_dir)).select("row", "value", "candidate")


@query(f"WITH {_CELL} SELECT row, value, CAST(len(regexp_replace(value, '[^0-9]', '', 'g')) AS INT) AS digits, CAST(replace(value, ',', '') AS DOUBLE) AS candidate FROM cells WHERE regexp_matches(trim(value), '^[1-9]\\d{{0,2}}(,\\d{{3}})+\\.\\d+$')")
def health_numeric_text(spark, sf_dir):
    return health.numeric_findings(_cells(spark, sf_dir)).select("row", "value", "digits", "candidate")


@query("""WITH h AS (SELECT p_type AS sheet, p_partkey AS col, lower(replace(p_brand, '#', ' ')) AS header FROM part) SELECT * FROM (SELECT *, min(col) OVER (PARTITION BY sheet, header) AS first_col FROM h) WHERE col > first_col""")
def health_dup_headers(spark, sf_dir):
    rows = M.table(spark, sf_dir, "part").select(F.col("p_type").alias("sheet"), F.col("p_partkey").alias("col"), F.upper(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("value"))
    return health.duplicate_headers(rows)


@query("""SELECT user_id AS sheet, min(event_id) AS first, max(event_id) AS last FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT DISTINCT event_id % 10 AS user_id, event_id // 10 AS event_id FROM events WHERE event_id % 7 <> 0)) GROUP BY user_id, g""")
def health_blank_islands(spark, sf_dir):
    rows = M.table(spark, sf_dir, "events").where("event_id % 7 <> 0").selectExpr("event_id % 10 AS sheet", "event_id div 10 AS r")
    return health.islands(rows, "sheet", "r")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS sheet, l_orderkey AS row FROM lineitem), g AS (SELECT *, lead(row) OVER (PARTITION BY sheet ORDER BY row) AS nxt FROM c),
  m AS (SELECT sheet, coalesce(min(row) FILTER (nxt - row > 50), max(row)) AS lim FROM g GROUP BY 1) SELECT c.sheet, count(*) AS beyond, min(lim) AS "limit" FROM c JOIN m USING (sheet) WHERE row > lim GROUP BY 1""")
def health_gap_outliers(spark, sf_dir):
    cells = M.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sheet"), F.col("l_orderkey").alias("row")).distinct()
    return health.outliers(cells).groupBy("sheet").agg(F.count("*").alias("beyond"), F.min("limit").alias("limit"))


@query("""SELECT sheet, col, count(*) FILTER (v = '') AS blanks, count(*) FILTER (v = '0') AS zeros FROM (SELECT l_returnflag AS sheet, l_linenumber AS col, CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN '0' ELSE 'x' END AS v FROM lineitem) GROUP BY 1, 2 HAVING count(*) FILTER (v = '') > 0 AND count(*) FILTER (v = '0') > 0""")
def health_blank_zero(spark, sf_dir):
    value = F.when(F.col("l_orderkey") % 97 == 0, "").when(F.col("l_orderkey") % 89 == 0, "0").otherwise("x")
    return health.blank_zero(M.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.col("l_linenumber").alias("col"), value.alias("value")))


@query("""SELECT o_orderstatus AS sheet, o_custkey AS col, array_to_string(list_sort(list(DISTINCT f)), '|') AS formats FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'dd/mm/yyyy' ELSE 'yyyy-mm-dd' END AS f FROM orders) GROUP BY 1, 2 HAVING count(DISTINCT f) > 1""")
def health_mixed_formats(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 4 == 0, "dd/mm/yyyy").otherwise("yyyy-mm-dd")
    rows = M.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("sheet"), F.col("o_custkey").alias("col"), form.alias("number_format"))
    return health.mixed_formats(rows).select("sheet", "col", F.array_join("formats", "|").alias("formats"))


@query("""WITH m AS (SELECT r_name AS sheet, r_regionkey AS r1, r_regionkey + 10 AS r2 FROM region), c AS (SELECT r_name AS sheet, n_nationkey AS row, x AS col FROM nation JOIN region ON n_regionkey = r_regionkey, range(4) t(x))
  SELECT c.sheet, c.row, CAST(c.col AS INT) AS col FROM c JOIN m ON c.sheet = m.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN 1 AND 2 WHERE NOT (c.row = r1 AND c.col = 1)""")
def health_merged_followers(spark, sf_dir):
    region, nation = M.table(spark, sf_dir, "region"), M.table(spark, sf_dir, "nation")
    merges = region.select(F.col("r_name").alias("sheet"), F.col("r_regionkey").alias("row1"), F.lit(1).alias("col1"), (F.col("r_regionkey") + 10).alias("row2"), F.lit(2).alias("col2"))
    cells = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sheet"), F.col("n_nationkey").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    return health.merged_followers(cells, merges)


@query("""SELECT c_custkey AS finding_id, CASE WHEN c_custkey % 6 = 0 THEN 'not_repaired' WHEN c_custkey % 6 = 3 THEN 'vanished' ELSE 'new' END AS problem FROM customer WHERE c_custkey % 6 IN (0, 3, 5)""")
def health_reconcile(spark, sf_dir):
    ids = M.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"))
    k = F.col("finding_id") % 6
    return health.reconciled(ids.where(k < 5), ids.where(k.isin(0, 2, 5)), ids.where(k.isin(0, 1, 4)))


def _bounds(spark: SparkSession, sf_dir: str, **kinds: tuple) -> DataFrame:
    days = M.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    columns = [c for name, (kind, args) in kinds.items() for c in zip((f"{name}_start", f"{name}_end"), periods.period(kind, F.col("day"), **args), strict=True)]
    return days.select("day", *[c.alias(n) for n, c in columns])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT day, day - CAST((isodow(day) - 1) % 7 AS INT) AS w, day - CAST((isodow(day) - 1 - 6 + 7) % 7 AS INT) AS u FROM d)
  SELECT day, w AS week_start, w + 6 AS week_end, u - 7 AS last_start, u - 1 AS last_end FROM s""")
def period_weeks(spark, sf_dir):
    return _bounds(spark, sf_dir, week=("current_week", {}), last=("previous_complete_week", {"week_start": 6}))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, CAST(date_trunc('quarter', day) AS DATE) AS q_start, CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH AS DATE) - 1 AS q_end,
  CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS m_start, CAST(date_trunc('month', day) AS DATE) - 1 AS m_end FROM d""")
def period_quarters(spark, sf_dir):
    return _bounds(spark, sf_dir, q=("current_quarter", {}), m=("previous_month", {}))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT day, CAST(date_trunc('month', day) AS DATE) AS f, (month(day) - 4 + 12) % 12 AS k FROM d)
  SELECT day, CAST(f - to_months(CAST(k AS INT)) AS DATE) AS y_start, CAST(f - to_months(CAST(k AS INT)) + INTERVAL 12 MONTH AS DATE) - 1 AS y_end, CAST(f - to_months(CAST(k % 3 + 3 AS INT)) AS DATE) AS q_start, CAST(f - to_months(CAST(k % 3 AS INT)) AS DATE) - 1 AS q_end FROM s""")
def period_fiscal(spark, sf_dir):
    return _bounds(spark, sf_dir, y=("current_fiscal_year", {"fiscal_start": 4}), q=("previous_fiscal_quarter", {"fiscal_start": 4}))


@query("""WITH a AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(38, 4))) AS detail FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, detail + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS summary FROM a WHERE l_orderkey % 25 <> 0)
  SELECT l_orderkey, CAST(detail AS DOUBLE) AS detail, CAST(summary AS DOUBLE) AS summary FROM a LEFT JOIN b USING (l_orderkey) WHERE summary IS NULL OR abs(detail - summary) > 0.5""")
def summary_reconcile(spark, sf_dir):
    lines = M.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    total = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(38,4)")).alias("s")).where("l_orderkey % 25 <> 0")
    total = total.select("l_orderkey", (F.col("s") + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)).alias("l_quantity"))
    got = formulas.reconcile(lines, total, "l_orderkey", "l_quantity", 0.5)
    return got.select("l_orderkey", F.col("detail").cast("double").alias("detail"), F.col("summary").cast("double").alias("summary"))


@query("SELECT l_suppkey, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(38, 4))) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def sumifs(spark, sf_dir):
    got = formulas.sumifs(M.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_returnflag") == "R")
    return got.select("l_suppkey", F.col("total").cast("double").alias("total"))


@query("SELECT c_custkey, coalesce((SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS o_orderpriority FROM customer")
def lookup_first_match(spark, sf_dir):
    rows = M.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    return formulas.lookup(rows, M.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("c_custkey", "o_orderpriority")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS due FROM orders")
def edate(spark, sf_dir):
    return M.table(spark, sf_dir, "orders").select("o_orderkey", formulas.edate(F.to_date("o_orderdate"), 1).alias("due"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '''=' || url WHEN 1 THEN '''@' || url WHEN 2 THEN '''-' || url ELSE url END AS safe FROM pages")
def csv_injection_guard(spark, sf_dir):
    k = F.pmod("page_id", F.lit(4))
    raw = F.concat(F.when(k == 0, "=").when(k == 1, "@").when(k == 2, "-").otherwise(""), "url")
    return M.table(spark, sf_dir, "pages").select("page_id", X.csv_safe(raw).alias("safe"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '-', 'g'), '-+', '-', 'g') AS name FROM pages")
def output_name_clean(spark, sf_dir):
    return M.table(spark, sf_dir, "pages").select("page_id", X.file_component(F.col("url")).alias("name"))


@query("""SELECT p_partkey, 'US$' || format('{:,.2f}', CAST(p_retailprice AS DOUBLE)) AS amount, CAST(p_size AS VARCHAR) || '00.00%' AS share FROM part""")
def number_format_display(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select("p_partkey", formats.shown(F.col("p_retailprice"), "amount", currency="USD").alias("amount"), formats.shown(F.col("p_size").cast("double"), "percentage").alias("share"))


@query(M.sql(M.RECORDS, select="""SELECT category, CASE WHEN count(DISTINCT c) > 1 THEN 'mixed_currency_confirmation_required' WHEN count(DISTINCT c) = 1 THEN min(c) ELSE 'currency_confirmation_required' END AS currency FROM (SELECT category, CASE WHEN category < '3' THEN nullif(upper(currency_text), '') WHEN category < '4' THEN 'CAD' END AS c FROM recs) GROUP BY 1"""))
def currency_policy(spark, sf_dir):
    c = F.when(F.col("category") < "3", F.upper("currency_text")).when(F.col("category") < "4", "CAD")
    return M.records(spark, sf_dir).select("category", c.alias("c")).groupBy("category").agg(formats.one_currency("c").alias("currency"))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey AS book, 'A' || CAST(n_nationkey AS VARCHAR) AS cell, 'A' || CAST((n_nationkey + 5 + CASE WHEN n_nationkey % 5 = 4 THEN 1 ELSE 0 END) % 25 AS VARCHAR) AS needs FROM nation),
  r(book, home, pos) AS (SELECT book, cell, needs FROM e UNION SELECT r.book, r.home, e.needs FROM r JOIN e ON r.book = e.book AND r.pos = e.cell) SELECT DISTINCT book, home AS cell FROM r WHERE home = pos""")
def formula_cycles(spark, sf_dir):
    k = F.col("n_nationkey")
    to = (k + 5 + F.when(k % 5 == 4, 1).otherwise(0)) % 25
    edges = M.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book"), F.concat(F.lit("A"), k.cast("string")).alias("cell"), F.concat(F.lit("=B$1*A"), to.cast("string"), F.lit("+SUM(C1:C9)")).alias("formula"))
    return formulas.on_cycles(edges.select("book", "cell", F.explode(formulas.references(F.col("formula"))).alias("needs")))


@query("""SELECT n_nationkey AS row, '=A' || CAST(n_nationkey + 2 AS VARCHAR) || '*$B$1+C' || CAST(n_nationkey + 3 AS VARCHAR) AS formula FROM nation""")
def formula_fill(spark, sf_dir):
    at = F.col("n_nationkey") + 2
    return M.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), formulas.filled("D2", 2, F.lit("=A2*$B$1+C3"), at).alias("formula"))


@query("""SELECT * FROM (VALUES ('S', 'A1', 'formula_error_literal'), ('S', 'A2', 'external_reference'), ('S', 'A3', 'broken_reference'), ('S', 'A4', 'missing_formula_sheet'), ('S', 'A5', 'unsupported_dynamic_array'), ('S', 'A3', 'formula_error_token'), ('S', 'A6', 'formula_error_token')) AS t(sheet, cell, code)""")
def formula_findings(spark, sf_dir):
    rows = [("S", "A1", "#N/A", None), ("S", "A2", "1", "=[b.xlsx]X!A1"), ("S", "A3", "1", "=#REF!+1"), ("S", "A4", "1", "='No Such'!A1"), ("S", "A5", "1", "=UNIQUE(A1:A9)"), ("S", "A6", "1", "=IF(A1=#N/A,0,1)"), ("S", "A7", "1", "=S!A1+B2")]
    return formulas.findings(spark.createDataFrame(rows, "sheet string, cell string, value string, formula string"), ["S"])


def queries() -> dict[str, Query]:
    return {**_QUERIES, **delivery_queries.QUERIES, **workbook_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **delivery_queries.SQL, **workbook_queries.SQL}
