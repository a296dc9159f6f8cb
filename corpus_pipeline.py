"""A corpus pipeline of five operators of quarrylane.llm; counted as part of that subpackage.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import linededup, mixing, pieces, quality, simhash
from quarrylane.llm.text import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions or the learned list reject go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("text", F.struct("*").alias("row")), rules)
    return judged.filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go; every document keeps its row, and n_chars is that of the new text."""
    return linededup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of Jaccard similarity 0.8 or more over five-word shingles one row stays: the smallest doc_id, null last, then the smallest hash of the text and of the whole row.

    Groups are found by SimHash with a pivot distance table, and counted exactly after that; see simhash.similar.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.xxhash64(*docs.columns).alias("whole"))
    named = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("h").alias("text_hash"), "whole").join(simhash.similar(docs), F.col("text_hash") == F.col("h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "whole")).alias("first")
    stay = named.groupBy("component").agg(first).select("first.doc_id", F.col("first.h").alias("stays"), F.col("first.whole").alias("stays_whole"))
    kept = rows.join(stay, (F.col("h") == F.col("stays")) & (F.col("whole") == F.col("stays_whole")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left_semi")
    return kept.dropDuplicates(["h"]).select("row.*")  # rows alike in every column


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each document of the mix."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), pieces.model_bytes())
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", source_mix), ("SentencePiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: SQL has neither the learned list nor the encoder; tests compare with brute force.
ORACLE_SQL = None
