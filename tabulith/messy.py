"""Deterministic messy records over the driver's clean tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order, with every tenth repeated later on."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    k, name, day = F.col("o_orderkey"), F.col("n_name"), F.to_date("o_orderdate")
    at = lambda n, *cases: F.element_at(F.array(*cases), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.floor(cents / 100).cast("long")
    tail = F.concat(F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    plain = F.concat(whole.cast("string"), tail)
    grouped = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad(F.pmod(whole, F.lit(1000)).cast("string"), 3, "0"), tail)).otherwise(plain)
    serial = F.date_diff(day, F.to_date(F.lit("1899-12-30"))).cast("string")
    rows = rows.select(
        k.alias("row_index"),
        at(6, name, F.lower(name), F.replace(name, F.lit("_"), F.lit(" ")), F.concat(F.substring(name, 1, 1), F.expr("substring(n_name, 3)")), F.lit("Shared Site"), F.concat(F.lit("Depot "), F.pmod(k, F.lit(9)).cast("string"))).alias("location"),
        at(7, *[F.date_format(day, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy")], serial, F.lit(""), F.lit("n/a")).alias("event_date"),
        F.when(F.pmod(k, F.lit(17)) == 0, "").otherwise(F.lpad(k.cast("string"), 8, "0")).alias("identifier"),
        F.col("o_orderpriority").alias("category"),
        (F.pmod(k, F.lit(100)) / 100.0).cast("double").alias("confidence"),
        at(5, F.concat(F.lit("$"), grouped), F.concat(F.lit("US$"), plain), F.concat(F.lit("CA$"), plain), plain, F.lit("n/a")).alias("amount_text"),
        at(4, F.lit("CAD"), F.lit("usd"), F.lit(""), F.lit("EUR")).alias("currency_text"),
        F.lit("orders.parquet").alias("source"),
    )
    again = rows.where(F.pmod("row_index", F.lit(10)) == 0).withColumn("row_index", F.col("row_index") + 1_000_000_000)
    return rows.unionByName(again)


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, aliases): nations, two of which share a site."""
    n = F.col("n_nationkey")
    shared = F.when(n.isin(3, 7), F.array(F.lit("Shared Site"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.array(F.concat(F.lit("NATION-"), n.cast("string"))), shared).alias("aliases"))


RECORDS = """
base AS (
  SELECT o_orderkey AS k, n_name, CAST(o_orderdate AS DATE) AS d, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
money AS (
  SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS plain,
    CASE WHEN cents // 100 >= 1000 THEN CAST(cents // 100000 AS VARCHAR) || ',' || lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
      ELSE CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS grouped FROM base
),
once AS (
  SELECT k AS row_index,
    CASE k % 6 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, '_', ' ') WHEN 3 THEN substr(n_name, 1, 1) || substr(n_name, 3) WHEN 4 THEN 'Shared Site' ELSE 'Depot ' || CAST(k % 9 AS VARCHAR) END AS location,
    CASE k % 7 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y/%m/%d') WHEN 2 THEN strftime(d, '%m/%d/%Y') WHEN 3 THEN strftime(d, '%d/%m/%Y') WHEN 4 THEN CAST(date_diff('day', DATE '1899-12-30', d) AS VARCHAR) WHEN 5 THEN '' ELSE 'n/a' END AS event_date,
    CASE WHEN k % 17 = 0 THEN '' ELSE lpad(CAST(k AS VARCHAR), 8, '0') END AS identifier, o_orderpriority AS category, CAST((k % 100) / 100.0 AS DOUBLE) AS confidence,
    CASE k % 5 WHEN 0 THEN '$' || grouped WHEN 1 THEN 'US$' || plain WHEN 2 THEN 'CA$' || plain WHEN 3 THEN plain ELSE 'n/a' END AS amount_text,
    CASE k % 4 WHEN 0 THEN 'CAD' WHEN 1 THEN 'usd' WHEN 2 THEN '' ELSE 'EUR' END AS currency_text, 'orders.parquet' AS source
  FROM money
),
recs AS (SELECT * FROM once UNION ALL SELECT * REPLACE (row_index + 1000000000 AS row_index) FROM once WHERE row_index % 10 = 0)"""

DESTINATIONS = """
dest AS (SELECT n_name AS key, ['NATION-' || CAST(n_nationkey AS VARCHAR)] || CASE WHEN n_nationkey IN (3, 7) THEN ['Shared Site'] ELSE [] END AS aliases FROM nation),
names AS (SELECT key AS destination, unnest([key] || aliases) AS alias, unnest(range(len(aliases) + 1)) AS pos FROM dest)"""

#: What infer() says of a date text without a locale, under an event_date's name.
DATED = """
dated AS (
  SELECT *, trim(event_date) AS t,
    regexp_matches(event_date, '^\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}$') AS ymd, regexp_matches(event_date, '^\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}$') AS slash,
    try_cast(regexp_extract(event_date, '^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})$', 1) AS INT) AS a, try_cast(regexp_extract(event_date, '^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})$', 2) AS INT) AS b,
    regexp_extract(event_date, '(\\d{4})$', 1) AS y, CASE WHEN regexp_matches(event_date, '^\\d+$') THEN CAST(event_date AS BIGINT) END AS n FROM recs
),
inferred AS (
  SELECT *, CASE WHEN t = '' THEN 'empty' WHEN ymd THEN 'date' WHEN slash THEN 'date' WHEN n BETWEEN 1 AND 2958465 THEN 'excel_serial_date' ELSE 'text' END AS type,
    CASE WHEN t = '' THEN 1.0 WHEN ymd THEN 0.99 WHEN slash AND a <= 12 AND b <= 12 THEN 0.4 WHEN slash THEN 0.9 WHEN n BETWEEN 1 AND 2958465 THEN 0.94 ELSE 0.9 END AS type_confidence,
    coalesce(slash AND a <= 12 AND b <= 12, false) AS ambiguous,
    CASE WHEN ymd THEN replace(t, '/', '-') WHEN slash AND a <= 12 AND b <= 12 THEN NULL WHEN slash AND a <= 12 THEN y || '-' || lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0')
      WHEN slash THEN y || '-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') WHEN n BETWEEN 1 AND 2958465 THEN strftime(DATE '1899-12-30' + CAST(n AS INT), '%Y-%m-%d') WHEN t = '' THEN NULL ELSE t END AS value
  FROM dated
),
reviewed AS (
  SELECT *, list_filter([CASE WHEN trim(location) = '' THEN 'missing:location' END, CASE WHEN t = '' THEN 'missing:event_date' END, CASE WHEN trim(identifier) = '' THEN 'missing:identifier' END, CASE WHEN trim(category) = '' THEN 'missing:category' END,
    CASE WHEN ambiguous THEN 'ambiguous:event_date:ambiguous_day_month' WHEN type NOT IN ('date', 'datetime', 'excel_serial_date') THEN 'invalid:event_date' END, CASE WHEN confidence < 0.85 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS reasons FROM inferred
),
marked AS (
  SELECT *, len(list_filter(reasons, lambda x: x LIKE 'missing:%' OR x LIKE 'invalid:%')) > 0 AS rejected,
    'rec_' || substr(sha256(concat_ws(chr(31), lower(trim(source)), lower(trim(identifier)), lower(trim(event_date)), lower(trim(location)), lower(trim(category)))), 1, 20) AS record_id FROM reviewed
)"""

ROUTED = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY row_index) > 1 AS duplicate FROM marked WHERE NOT rejected),
hits AS (
  SELECT DISTINCT r.location, r.rule_rank, r.rule, n.destination FROM (
    SELECT DISTINCT location, 0 AS rule_rank, 'configured_exact' AS rule, location AS k FROM firsts UNION ALL SELECT DISTINCT location, 1, 'casefold_exact', lower(trim(location)) FROM firsts
    UNION ALL SELECT DISTINCT location, 2, 'normalized_exact', regexp_replace(lower(location), '[^a-z0-9]', '', 'g') FROM firsts) r
  JOIN (SELECT destination, 0 AS rule_rank, alias AS k FROM names UNION ALL SELECT destination, 1, lower(trim(alias)) FROM names UNION ALL SELECT destination, 2, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') FROM names) n
    ON r.rule_rank = n.rule_rank AND r.k = n.k WHERE r.k <> ''
),
tier AS (SELECT location, rule_rank, rule, list_sort(list(destination)) AS candidates FROM hits GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY location ORDER BY rule_rank) = 1),
matched AS (
  SELECT f.*, CASE WHEN duplicate THEN 'duplicate' WHEN rule IS NULL THEN 'unmatched' WHEN len(candidates) = 1 THEN 'matched' ELSE 'conflict' END AS match_status,
    CASE WHEN NOT duplicate THEN t.rule END AS rule, CASE WHEN NOT duplicate THEN t.candidates END AS candidates, CASE WHEN NOT duplicate AND len(candidates) = 1 THEN candidates[1] END AS destination,
    CASE WHEN duplicate THEN 'duplicate_record_id' WHEN rule IS NULL THEN 'no_match' WHEN len(candidates) > 1 THEN 'multiple_destinations' END AS match_reason
  FROM firsts f LEFT JOIN tier t USING (location)
),
outcomes AS (
  SELECT row_index, record_id, source, location, match_status, candidates, destination, CASE WHEN match_reason IS NULL THEN reasons ELSE list_append(reasons, match_reason) END AS reasons,
    CASE WHEN match_status = 'matched' AND len(reasons) = 0 THEN 'accepted' ELSE 'review' END AS status FROM matched
  UNION ALL SELECT row_index, record_id, source, location, 'not_matched', NULL, NULL, reasons, 'rejected' FROM marked WHERE rejected
)"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
