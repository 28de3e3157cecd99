"""From raw documents to packed training sequences: five stages, each written as a table before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundlake.llm import lines, packing, pii, quality, simhash
from soundlake.llm.common import cut, row_key, table, text_of


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with text replaced by the column ``text`` and n_chars brought in line."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts."""
    return quality.score(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _with_text(lines.dedup_lines(docs), "kept_text").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the smallest doc_id's, and of equal ids the smallest row key's."""
    groups = cut(simhash.near_duplicates(docs))
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("pick"))
    keys = cut(chosen.select("pick.r1", "pick.r2"))
    r1, r2 = row_key("doc_id", text_of())
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), r1.alias("r1"), r2.alias("r2"))
    once = keyed.join(keys, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("doc").alias("doc"))
    return once.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their form."""
    return _with_text(pii.pseudonymise(docs), "text").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii_pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: No SQL states a trained classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
