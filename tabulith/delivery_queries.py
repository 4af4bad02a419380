"""Queries over planning, writing, verification, decisions and directories, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import messy as M
from tabulith.functions import text as X
from tabulith.functions import values as V
from tabulith.operators import ambiguity, catalog, manifest, match, profile, review, route, state, verify, write
from tabulith.streaming import deliveries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OUT = (M.RECORDS, M.DATED, M.DESTINATIONS, M.ROUTED)
_MAPPED = {"record_id": 1, "location": 2, "event_date": 3, "identifier": 4}
_NEW = """new AS (SELECT *, CAST(row_number() OVER (PARTITION BY destination ORDER BY row_index) + 1 AS INT) AS row FROM outcomes WHERE status = 'accepted' AND row_index % 3 <> 0),
  full_ AS (SELECT n.*, r.identifier, r.event_date FROM new n JOIN recs r USING (row_index)),
  cells AS (SELECT destination, row, record_id, row_index, unnest(['record_id', 'location', 'event_date', 'identifier']) AS field, unnest([record_id, location, event_date, identifier]) AS value, unnest([1, 2, 3, 4]) AS col FROM full_),
  marked AS (SELECT *, CASE WHEN (row = 10 AND col = 2) OR (row = 11 AND col <= 2) THEN 'merged_non_anchor' WHEN col = 4 AND row % 7 = 0 AND row <= 50 THEN 'protected_formula' END AS skip FROM cells)"""


def _sql(*parts: str, select: str) -> str:
    return M.sql(*parts, select=select).replace("marked AS (SELECT *, CASE", "marked_ AS (SELECT *, CASE").replace("FROM marked WHERE skip", "FROM marked_ WHERE skip")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed records of which a third of the accepted are in their targets already."""
    out = route.routed(M.records(spark, sf_dir), M.destinations(spark, sf_dir), use_fuzzy=False)
    there = (F.col("status") == "accepted") & (F.col("row_index") % 3 == 0)
    return out.withColumn("status", F.when(there, "skipped_existing").otherwise(F.col("status")))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes, and their cells in templates that hold formulas in every seventh row and a merged range."""
    out, names = _outcomes(spark, sf_dir), M.destinations(spark, sf_dir).select(F.col("key").alias("destination"))
    fields = spark.createDataFrame([("S", f, c, 1, 2, False) for f, c in _MAPPED.items()], "sheet string, field string, col int, header_row int, data_start_row int, overwrite boolean")
    template = names.select("destination", F.lit("S").alias("sheet"), F.explode(F.sequence(F.lit(7), F.lit(49), F.lit(7))).alias("row"), F.lit(4).alias("col"), F.lit("").alias("value"), F.lit("=1+1").alias("formula"))
    merges = names.select("destination", F.lit("S").alias("sheet"), F.lit(10).alias("row1"), F.lit(1).alias("col1"), F.lit(11).alias("row2"), F.lit(2).alias("col2"))
    mapping = names.join(F.broadcast(fields), F.lit(True))  # four fields
    return out, write.changes(route.write_order(out), mapping, template, merges)


@query(_sql(*_OUT, _NEW, select="""SELECT d.key AS destination, coalesce(a.n, 0) - coalesce(p.n, 0) AS expected_written, coalesce(r.n, 0) AS expected_review, coalesce(s.n, 0) AS expected_skipped_existing, coalesce(p.n, 0) AS expected_skipped_protected FROM dest d
  LEFT JOIN (SELECT destination, count(*) AS n FROM new GROUP BY 1) a ON a.destination = d.key LEFT JOIN (SELECT destination, count(DISTINCT row) AS n FROM marked WHERE skip IS NOT NULL GROUP BY 1) p ON p.destination = d.key
  LEFT JOIN (SELECT destination, count(*) AS n FROM outcomes WHERE status = 'accepted' AND row_index % 3 = 0 GROUP BY 1) s ON s.destination = d.key LEFT JOIN (SELECT c AS destination, count(*) AS n FROM (SELECT unnest(candidates) AS c FROM outcomes WHERE status = 'review') GROUP BY 1) r ON r.destination = d.key"""))
def plan_counts(spark, sf_dir):
    out, changed = _changes(spark, sf_dir)
    return write.planned(out, changed, M.destinations(spark, sf_dir))


@query(_sql(*_OUT, _NEW, select="SELECT destination, chr(64 + col) || CAST(row AS VARCHAR) AS cell, skip FROM marked WHERE skip IS NOT NULL"))
def protected_cells(spark, sf_dir):
    return write.protected_cells(_changes(spark, sf_dir)[1])


@query(_sql(*_OUT, _NEW, select="SELECT record_id, destination, 'S' AS sheet, chr(64 + col) || CAST(row AS VARCHAR) AS cell, field, value, 'orders.parquet' AS source FROM marked WHERE skip IS NULL"))
def cell_lineage(spark, sf_dir):
    return write.lineage(_changes(spark, sf_dir)[1])


@query(M.sql(*_OUT, select="""SELECT count(*) AS input, count(*) FILTER (status = 'accepted' AND row_index % 3 <> 0 AND destination < 'NATION_15') AS written, count(*) FILTER (status = 'accepted' AND row_index % 3 <> 0 AND NOT destination < 'NATION_15') AS accepted,
  count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'accepted' AND row_index % 3 = 0) AS skipped_existing FROM outcomes"""))
def written_counts(spark, sf_dir):
    done = M.destinations(spark, sf_dir).where("key < 'NATION_15'").select(F.col("key").alias("destination"))
    return route.status_counts(write.written(_outcomes(spark, sf_dir), done))


@query(M.sql(*_OUT, select="SELECT DISTINCT input = accepted + review AS stages_agree, input = total AS conserved FROM (SELECT count(*) FILTER (status <> 'rejected') AS input, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review, (SELECT count(*) FROM firsts) AS total FROM outcomes)"))
def stage_counts(spark, sf_dir):
    """Records that are not rejected are accepted, skipped or in review, each once: counted on the two sides of routing."""
    before = route.reviewed(M.records(spark, sf_dir)).where("not rejected").agg(F.count("*").alias("total"))
    c = route.status_counts(_outcomes(spark, sf_dir)).join(before, F.lit(True))  # one row each
    kept = F.col("accepted") + F.col("review") + F.col("skipped_existing")
    return c.select((F.col("input") - F.col("rejected") == kept).alias("stages_agree"), (F.col("total") == kept).alias("conserved"))


@query(M.sql(M.RECORDS, M.DATED, select="""SELECT row_index, field, value FROM (SELECT row_index, unnest(['record_id', 'location', 'confidence', 'amount']) AS field, unnest([record_id, location, CAST(confidence AS VARCHAR),
  regexp_replace(regexp_replace(CAST(try_cast(replace(replace(replace(replace(amount_text, ',', ''), 'US$', ''), 'CA$', ''), '$', '') AS DECIMAL(38, 10)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')]) AS value FROM marked)"""))
def delivery_values(spark, sf_dir):
    rows = match.with_record_id(M.records(spark, sf_dir)).withColumn("amount", V.amount(F.col("amount_text")))
    each = write.delivered(rows.select("row_index", "record_id", "location", "confidence", "amount")).select("row_index", F.explode("fields").alias("x"))
    return each.select("row_index", "x.field", "x.value")


_ORD = "SELECT 'S' || o_orderstatus AS sheet, o_orderkey AS row, o_custkey % 1000 AS k FROM orders"


@query(f"""SELECT sheet, row, 'first at row ' || CAST("first" AS VARCHAR) AS evidence FROM (SELECT *, min(row) OVER (PARTITION BY sheet, k) AS "first" FROM ({_ORD})) WHERE row > "first" """)
def verify_duplicates(spark, sf_dir):
    ids = M.table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), "o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("row"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("cell"), (F.col("o_custkey") % 1000).cast("string").alias("value"))
    return verify.duplicate_findings(ids).select("sheet", F.col("row").cast("long").alias("row"), "evidence")


@query("SELECT o_orderkey AS row, 'C' || CAST(o_orderkey AS VARCHAR) AS cell, 'written_value_mismatch' AS code FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 17 = 0")
def verify_values(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    at = [F.lit("S").alias("sheet"), k.cast("int").alias("row"), F.lit(3).alias("col"), F.concat(F.lit("C"), k.cast("string")).alias("cell")]
    orders = M.table(spark, sf_dir, "orders")
    changed = orders.select(*at, F.lit("amount").alias("field"), n.alias("new_value"))
    have = orders.where(k % 17 != 0).select(*at, F.when(k % 10 == 0, F.concat(n, F.lit("1"))).when(k % 3 == 0, F.concat(n, F.lit(".0"))).otherwise(n).alias("value"))
    return verify.value_findings(changed, have).select(F.col("row").cast("long").alias("row"), "cell", "code")


@query("SELECT n_regionkey AS destination, CAST(n_nationkey + 1 AS INT) AS col, n_name || ' -> ' || lower(n_name) AS evidence FROM nation WHERE n_nationkey % 4 = 0")
def verify_headers(spark, sf_dir):
    n = M.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("destination"), F.lit("S").alias("sheet"), F.lit(3).alias("row"), (F.col("n_nationkey") + 1).cast("int").alias("col"), F.col("n_name").alias("value"))
    mapping = n.select("destination", "sheet", F.col("value").alias("field"), "col", F.col("row").alias("header_row"))
    have = n.withColumn("value", F.when((F.col("col") - 1) % 4 == 0, F.lower("value")).otherwise(F.col("value")))
    found = verify.header_findings(n, have, mapping).join(mapping.select("destination", "field", "col"), "field")
    return found.select("destination", "col", "evidence")


@query("SELECT c_custkey AS row, CASE WHEN c_custkey % 9 = 0 THEN 'B' ELSE 'C' END || CAST(c_custkey AS VARCHAR) AS cell FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0")
def verify_required(spark, sf_dir):
    rows = M.table(spark, sf_dir, "customer").select(F.lit("S").alias("sheet"), F.col("c_custkey").cast("int").alias("row"), "c_name")
    need = spark.createDataFrame([("S", "name", 2), ("S", "code", 3)], "sheet string, field string, col int")
    b = rows.select("sheet", "row", F.lit(2).alias("col"), F.when(F.col("row") % 9 == 0, " ").otherwise(F.col("c_name")).alias("value"))
    c = rows.where("row % 5 <> 0").select("sheet", "row", F.lit(3).alias("col"), F.lit("x").alias("value"))
    return verify.required_findings(b.unionByName(c), rows.select("sheet", "row"), need).select(F.col("row").cast("long").alias("row"), "cell")


@query("SELECT count(*) AS findings, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS codes, count(*) FILTER (o_orderstatus <> 'O') AS errors, count(*) FILTER (o_orderstatus = 'O') AS warnings, bool_or(o_orderstatus <> 'O') AS blocking FROM orders")
def verification_summary(spark, sf_dir):
    found = M.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderstatus") == "O", "warning").otherwise("error").alias("severity"))
    s = verify.summary(found).join(verify.blocking(found), F.lit(True))  # one row each
    return s.select("findings", F.array_join("codes", "|").alias("codes"), F.col("severities")["error"].alias("errors"), F.col("severities")["warning"].alias("warnings"), "blocking")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that each leave one question open: which segment they belong to."""
    seg = F.col("c_mktsegment")
    return M.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_index"), F.col("c_name").alias("record_id"), F.col("c_name").alias("location"), F.lit("review").alias("match_status"), F.array(seg).alias("candidates"), F.lit(0.9).alias("match_confidence"),
        F.when(F.col("c_custkey") % 7 == 0, "rejected").when(F.col("c_custkey") % 2 == 0, "accepted").otherwise("review").alias("status"), F.array(F.lit("fuzzy_requires_review")).alias("reasons"), seg.alias("destination"),
    )


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ambiguity.grouped(ambiguity.from_outcomes(_asked(spark, sf_dir)))
    name = F.element_at("candidates", 1)
    told = groups.where(name < "G").select("key", F.when(name < "B", "unknown").otherwise(name).alias("decision"), "candidates")
    return ambiguity.decided(groups, told.where("decision <> 'unknown'"), told)


@query("SELECT c_name AS record_id, c_mktsegment AS target FROM customer WHERE c_mktsegment >= 'B' AND c_mktsegment < 'G' AND c_mktsegment <> 'FURNITURE'")
def confirmations_applied(spark, sf_dir):
    there = M.table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_mktsegment").alias("key")).distinct()
    return ambiguity.confirmations(_asked(spark, sf_dir), _batch(spark, sf_dir), there)


@query("""SELECT c_custkey AS row_index, CASE WHEN c_custkey % 7 = 0 THEN 'rejected' WHEN o THEN 'review' WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'review' END AS status, CASE WHEN o AND c_custkey % 7 <> 0 THEN NULL ELSE c_mktsegment END AS destination,
  CASE WHEN o AND c_custkey % 7 <> 0 THEN 'fuzzy_requires_review,unresolved_ambiguity' ELSE 'fuzzy_requires_review' END AS reasons FROM (SELECT *, c_mktsegment < 'B' OR c_mktsegment >= 'G' AS o FROM customer)""")
def unresolved_blocked(spark, sf_dir):
    out = ambiguity.blocked(_asked(spark, sf_dir), _batch(spark, sf_dir))
    return out.select("row_index", "status", "destination", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT 'ambiguity:review|' || c_mktsegment AS record_id, array_to_string((list(c_name ORDER BY c_custkey))[1:5], ', ') AS source_value, c_mktsegment AS proposed_value, 'review|' || c_mktsegment || '; affected=' || CAST(count(*) AS VARCHAR) AS review_reason FROM customer GROUP BY c_mktsegment""")
def ambiguity_review_rows(spark, sf_dir):
    rows = ambiguity.review_rows(ambiguity.grouped(ambiguity.from_outcomes(_asked(spark, sf_dir))))
    return rows.select("record_id", "source_value", "proposed_value", "review_reason")


@query("""SELECT c_name AS record_id, c_name AS source_value, c_mktsegment AS proposed_value, 'fuzzy_requires_review' AS review_reason, '["' || c_mktsegment || '"]' AS candidates FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 2 <> 0""")
def review_pack_rows(spark, sf_dir):
    return review.pack(_asked(spark, sf_dir).withColumn("source", F.lit("f"))).select("record_id", "source_value", "proposed_value", "review_reason", "candidates")


@query("""SELECT c_name AS record_id, p AS problem FROM customer, (VALUES ('missing_row', 11), ('changed_row', 5), ('unknown_decision', 3)) AS t(p, m) WHERE c_custkey % 7 <> 0 AND c_custkey % 2 <> 0 AND c_custkey % m = 0 AND (p = 'missing_row' OR c_custkey % 11 <> 0)""")
def review_pack_problems(spark, sf_dir):
    keyed = _asked(spark, sf_dir).withColumn("source", F.col("row_index").cast("string"))
    issued = review.pack(keyed)
    k = F.col("source_location").cast("long")
    back = issued.where(k % 11 != 0).withColumn("decision", F.when(k % 3 == 0, "maybe").otherwise("accept")).withColumn("proposed_value", F.when(k % 5 == 0, "forged").otherwise(F.col("proposed_value")))
    return review.problems(issued, back)


@query("""WITH f AS (SELECT l_returnflag AS source, 'file' || CAST(l_suppkey % 5 AS VARCHAR) AS x, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT source, array_to_string(list(x ORDER BY o), ',') AS origins FROM f GROUP BY 1""")
def source_origins(spark, sf_dir):
    rows = M.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.concat(F.lit("file"), (F.col("l_suppkey") % 5).cast("string")).alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"))
    return route.source_origins(rows, "source").select("source", F.array_join("origins", ",").alias("origins"))


@query("""SELECT l_returnflag AS destination, l_linestatus AS sheet, count(*) AS written, count(*) FILTER (l_suppkey % 4 <> 0) AS rows, count(*) FILTER (l_linenumber = 1) AS first_input FROM lineitem GROUP BY 1, 2""")
def tab_rows(spark, sf_dir):
    lines = M.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("destination"), F.col("l_linestatus").alias("sheet"), F.col("l_linenumber").cast("string").alias("input"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_suppkey")
    cells = lines.select("destination", "sheet", "row", F.lit(2).alias("col"), F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.col("l_suppkey").cast("string")).alias("value"))
    ids = lines.select("destination", "sheet").distinct().withColumns({"col": F.lit(2), "data_start_row": F.lit(0)})
    tabs = route.tab_counts(lines, manifest.persisted_rows(cells, ids))
    return tabs.select("destination", "sheet", "written", "rows", F.coalesce(F.try_element_at("sources", F.lit("1")), F.lit(0)).alias("first_input"))


@query("""WITH t AS (SELECT l_returnflag AS d, l_linestatus AS s, count(*) AS w, count(*) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM lineitem GROUP BY 1, 2)
  SELECT d AS destination, 'row_count_mismatch:' || s AS problem FROM t WHERE w <> r UNION ALL SELECT d, 'written_count_mismatch' FROM t GROUP BY d HAVING sum(w) <> sum(r)""")
def manifest_discrepancies(spark, sf_dir):
    tabs = M.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("destination"), F.col("l_linestatus").alias("sheet")).agg(F.count("*").alias("written"))
    tabs = tabs.withColumn("rows", F.col("written") - F.when(F.col("destination") == "R", 1).otherwise(0))
    return manifest.discrepancies(tabs, tabs.groupBy("destination").agg(F.sum("written").alias("written")))


@query("SELECT r_name AS sheet, CASE WHEN r_regionkey = 0 THEN 'sheet_removed' ELSE 'sheet_added' END AS kind FROM region WHERE r_regionkey IN (0, 4)")
def drift_sheets(spark, sf_dir):
    r = M.table(spark, sf_dir, "region").select(F.col("r_name").alias("sheet"), "r_regionkey")
    return profile.sheet_drift(r.where("r_regionkey < 4"), r.where("r_regionkey > 0"))


@query("""WITH a AS (SELECT l_returnflag AS g, count(*) / greatest(count(DISTINCT l_partkey), 1)::DOUBLE AS before FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS g, count(*) / greatest(count(DISTINCT l_partkey), 1)::DOUBLE AS after FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber < 3 GROUP BY 1)
  SELECT g AS l_returnflag, before, after FROM a JOIN b USING (g) WHERE abs(after - before) > 0.01""")
def drift_grain(spark, sf_dir):
    lines = M.table(spark, sf_dir, "lineitem")
    return profile.grain_drift(lines, lines.where("l_returnflag <> 'A' or l_linenumber < 3"), "l_returnflag", F.col("l_partkey"))


@query("""SELECT r_name AS field, CASE r_regionkey WHEN 1 THEN 'field_renamed' WHEN 2 THEN 'field_type_changed' WHEN 3 THEN 'field_required_changed' ELSE 'field_added' END AS kind, true AS blocked FROM region WHERE r_regionkey > 0""")
def drift_kinds(spark, sf_dir):
    k, name = F.col("r_regionkey"), F.col("r_name")
    rows = M.table(spark, sf_dir, "region").select(k.alias("k"), name.alias("field"), k.cast("int").alias("position"), F.array(F.lit("text")).alias("types"), F.lit(True).alias("required"), F.array(F.lit("a")).alias("enum"))
    plain = F.regexp_replace(F.lower("field"), r"[^\p{L}\p{N}]+", "")
    new = rows.withColumns({"field": F.when(F.col("k") == 1, F.concat(F.col("field"), F.lit(" "))).otherwise(F.col("field")), "types": F.when(F.col("k") == 2, F.array(F.lit("integer"))).otherwise(F.col("types")), "required": F.col("k") != 3})
    found = profile.drift(rows.where("k < 4").drop("k"), new.drop("k"))
    named = rows.select(plain.alias("p"), F.col("field").alias("name"))
    blocked = profile.drift_blocked(found, spark.createDataFrame([], "old string, new string, overlap double"))
    return found.join(named, found["field"] == named["p"]).select(F.col("name").alias("field"), "kind").join(blocked, F.lit(True))  # one row


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END || '/' || CAST(doc_id AS VARCHAR) AS relative FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def allowed_paths(spark, sf_dir):
    d = F.col("doc_id")
    root = F.when(d % 5 == 0, "/elsewhere/").when(d % 4 == 0, "/data/in/a/").otherwise("/data/in/b/")
    rows = M.table(spark, sf_dir, "documents").select("doc_id", F.concat(root, F.when(d % 7 == 0, "../").otherwise(""), d.cast("string")).alias("path"))
    return catalog.allowed(rows, ["/data/in", "/data/other/"])[0].select("doc_id", "relative")


@query("""WITH n AS (SELECT doc_id, 'report ' || CAST(doc_id // 3 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' (1)' ELSE '_final' END || '.csv' AS name, sha256(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'exclude' ELSE 'include' END AS d0 FROM documents WHERE text IS NOT NULL),
  g AS (SELECT h, arg_min(name, (len(name), name)) AS rep FROM n GROUP BY h HAVING count(*) >= 2), s AS (SELECT n.*, rep, CASE WHEN rep IS NOT NULL AND rep <> name THEN 'exclude' ELSE d0 END AS d1, doc_id // 3 AS k FROM n LEFT JOIN g USING (h)),
  v AS (SELECT k FROM s WHERE d1 <> 'exclude' GROUP BY k HAVING count(*) >= 2 AND count(DISTINCT h) >= 2)
  SELECT doc_id, CASE WHEN d1 <> 'exclude' AND k IN (SELECT k FROM v) THEN 'review' ELSE d1 END AS disposition, CASE WHEN d1 <> 'exclude' AND k IN (SELECT k FROM v) THEN 'version_candidates_require_confirmation' WHEN rep IS NOT NULL AND rep <> name THEN 'duplicate_content' ELSE 'first' END AS reason FROM s""")
def workdir_settled(spark, sf_dir):
    d = F.col("doc_id")
    name = F.concat(F.lit("report "), F.floor(d / 3).cast("string"), F.when(d % 3 == 0, "").when(d % 3 == 1, " (1)").otherwise("_final"), F.lit(".csv"))
    rows = M.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", name.alias("name"), name.alias("relative"), F.sha2("text", 256).alias("digest"), F.when(d % 10 == 0, "exclude").otherwise("include").alias("disposition"), F.lit("first").alias("reason"))
    return catalog.settled(rows).select("doc_id", "disposition", "reason")


@query("""SELECT event_id, CASE WHEN k = 0 THEN 'template' WHEN k < 4 THEN 'input' ELSE 'unknown' END AS classification, CASE WHEN k < 4 AND event_id % 3 = 0 AND k > 0 THEN 'review' WHEN k BETWEEN 1 AND 3 THEN 'include' ELSE 'exclude' END AS disposition,
  CASE WHEN k = 0 THEN 'override:user' WHEN k < 4 AND event_id % 3 = 0 THEN 'override_refused_unstable_file' WHEN k < 4 THEN 'override:team' ELSE 'as it was' END AS reason FROM (SELECT event_id, event_id % 8 AS k FROM events)""")
def overrides_applied(spark, sf_dir):
    k = F.col("event_id") % 8
    rows = M.table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "pay 1.csv").when(k < 4, "pay x.csv").otherwise("other.csv").alias("name"), F.lit("unknown").alias("classification"), F.lit("exclude").alias("disposition"), F.lit("as it was").alias("reason"), (F.col("event_id") % 3 != 0).alias("stable"))
    rules = spark.createDataFrame([(0, "pay ?.csv", "template", None, "user"), (1, "pay*", "input", "include", "team")], "pos int, pattern string, classification string, disposition string, source string")
    rules = rules.withColumn("pattern", F.when(F.col("pos") == 0, "pay [0-9].csv").otherwise(F.col("pattern")))
    return catalog.overridden(rows, rules).select("event_id", "classification", "disposition", "reason")


@query("SELECT d AS disposition, CAST(count(*) FILTER (k = d) AS BIGINT) AS n FROM (VALUES ('include'), ('review'), ('exclude')) AS t(d), (SELECT CASE event_id % 5 WHEN 0 THEN 'include' ELSE 'exclude' END AS k FROM events) GROUP BY 1")
def disposition_counts(spark, sf_dir):
    rows = M.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, "include").otherwise("exclude").alias("disposition"))
    return catalog.disposition_counts(rows)


@query("SELECT event_id, (event_id % 3 <> 0) AND (event_id % 10 >= 5) AS stable FROM events")
def file_stability(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = M.table(spark, sf_dir, "events").select("event_id", at.alias("mtime"), F.lit(10).cast("long").alias("size"), (at.cast("double") + F.col("event_id") % 10).cast("timestamp").alias("now"))
    before = F.when(F.col("event_id") % 3 == 0, F.lit(9)).when(F.col("event_id") % 3 == 1, F.lit(10)).cast("long")
    return rows.select("event_id", catalog.stable(F.col("mtime"), F.col("size"), F.col("now"), F.when(before.isNotNull(), F.col("mtime")), before).alias("stable"))


@query("SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 'historical' WHEN CAST(ts AS DATE) <= DATE '2024-01-20' THEN 'current' ELSE 'unknown' END AS period_state FROM events")
def period_state(spark, sf_dir):
    day = lambda d: F.to_date(F.lit(d))
    return deliveries.in_period(M.table(spark, sf_dir, "events"), day("2024-01-10"), day("2024-01-20")).select("event_id", "period_state")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1, 2")
def period_event_counts(spark, sf_dir):
    day = lambda d: F.to_date(F.lit(d))
    got = deliveries.period_counts(M.table(spark, sf_dir, "events"), day("2024-01-10"), day("2024-01-20"))
    return got.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT n_nationkey AS sheet_index, c || CASE WHEN r > 1 THEN '-' || CAST(r AS VARCHAR) ELSE '' END || '.csv' AS file FROM (SELECT n_nationkey, c, row_number() OVER (PARTITION BY lower(c) ORDER BY n_nationkey) AS r FROM
  (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Pay_Run' WHEN 1 THEN 'pay_run' WHEN 2 THEN '_CON' WHEN 3 THEN 'a_b' ELSE n_name END AS c FROM nation))""")
def sheet_file_names(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    sheet = F.when(k == 0, "Pay:Run").when(k == 1, "pay?run. ").when(k == 2, "CON").when(k == 3, 'a"b').otherwise(F.col("n_name"))
    return X.sheet_file_names(M.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet_index"), sheet.alias("sheet"))).select("sheet_index", "file")


@query("SELECT n_nationkey AS k, n_nationkey % 4 < 2 AS is_secret FROM nation")
def secret_keys(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    name = F.concat("n_name", F.when(k == 0, "_API_KEY").when(k == 1, " Password2").when(k == 2, "_key").otherwise("_name"))
    return M.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), state.secret(name).alias("is_secret"))
