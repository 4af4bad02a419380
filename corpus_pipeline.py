"""Documents to packed sequences: language ID, near-dedup, substring dedup, packing.

Each stage works on all that the one before kept, written as a table and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import langid, packing, resemblance, substrings
from tabulith.llm._spark import dropped, only, stored, table

#: Words of a shingle in near-dedup, and the odds below which a language is as good as guessed.
SHINGLE, LEAST_SCORE = 5, 0.35


def aside(docs: DataFrame, names: tuple[str, ...], back: bool = False) -> DataFrame:
    """docs whose own columns of these names are called otherwise while an operator makes columns of those names, or back."""
    for name in names:
        now, then = (f"_own_{name}", name) if back else (name, f"_own_{name}")
        docs = (docs.drop(then) if back and now in docs.columns else docs).withColumnRenamed(now, then)
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or the odds of the best are under LEAST_SCORE.

    A missing lang becomes the predicted one. The model is fitted to the labelled documents of docs
    that are not held out; where there are none, nothing can be rejected and all stay.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    if not model.languages:
        return docs
    names = ("lang_pred", "score")
    told = langid.predict(aside(docs, names), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return aside(told.withColumn("lang", F.coalesce("lang", "lang_pred")), names, back=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 and more) the document with the smallest doc_id stays.

    SimHash links candidates, MinHash adds similar ones that it has too far apart, and all are compared
    exactly. Rows without an id stay. See resemblance.kept.
    """
    return resemblance.kept(docs, SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 50 words and more that a document with a smaller doc_id has are cut out; every document stays.

    n_chars, where the documents have it, follows the text.
    """
    names = ("n_words", "n_removed")
    out = substrings.dedup(aside(docs, names))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return aside(out, names, back=True).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, as ids, in sequences of at most 1024: a row for each piece, with its place."""
    return packing.packed(docs.select("doc_id", "text"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the language model nor the similarities; tests/llm holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; of the tables between them only those that are still read are kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only(spark) as keep:
            last, docs = docs, stored(stage(spark, docs, sf_dir), name)
            keep.append(docs.stored_at)
        dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
