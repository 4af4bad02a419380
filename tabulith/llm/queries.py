"""The driver's queries over the operators of this subpackage, and SQL where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import langid, licences, nndescent, packing, simhash, substrings, tokens, trie_bpe, voronoi, wrappers
from tabulith.llm._spark import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, joined=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokens.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return tokens.with_crc(tokens.read_token_files(spark, path))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identified(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = trie_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_wrapper_induction, op2_licence_scan, op3_substring_dedup, op4_token_files, op5_best_fit_packing, op6_simhash_near_dedup, op7_exact_top_k, op8_language_id, op9_bpe_trie, op10_nn_descent)}


#: Windows as texts, the smallest document of each, and the words that none of a later document covers.
SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM w JOIN m USING (t) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Every query against every vector, in whole numbers that doubles hold exactly.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licence_scan": licences.oracle(), "op3_substring_dedup": SUBSTRINGS, "op7_exact_top_k": TOP_K}
