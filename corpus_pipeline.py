"""A corpus pipeline over ``documents``: language ID, line deduplication,
near-duplicate removal, benchmark decontamination, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of ``documents``.

Rows with equal or null ids stay rows of their own through every stage; empty
tables pass through."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, langid, line_dedup, ngram_join, queries
from ledgerlens.llm.common import drop_or_keep, read, row_ids, ship_code, staged

# a trained language classifier and a tokenizer cannot be stated in SQL
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the labels stay. With no
    label to learn from, those with a letter stay."""
    ship_code(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.filter(~langid.held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs, model).filter(F.col("lang_pred") != langid.UND)
    return kept.select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; ``n_chars`` follows the new text.
    Copies of a document count once, and a document of boilerplate alone stays
    whole: the next stage decides which copy survives."""
    ship_code(spark)
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), queries.LINE_RATIO, queries.LINE_MIN_REPEATS,
                                      by_text=True, keep_whole=True)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first document stays."""
    ship_code(spark)
    rows = row_ids(docs.select(*COLUMNS), "doc_id", COLUMNS[1:])
    found = ngram_join.near_duplicates(rows.select(F.col("rid").alias("row"), "text"), "row")
    gone = staged(found.filter(~F.col("kept")).select(F.col("row").alias("rid")), "gone")
    return drop_or_keep(rows, gone, "rid", "left_anti").select(*COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    ship_code(spark)
    found = decontaminate.find_copies(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    ship_code(spark)
    return queries.bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", drop_benchmark_copies),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
