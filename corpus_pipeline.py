"""The training-data pipeline: raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

In every stage an empty table stays empty, ids may be null or repeat, columns
beside those of documents stay as they are whatever their names, and texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, free_name, id_fold, table, written
from quarryweb.llm.decontaminate import remove_contamination
from quarryweb.llm.jaccard import deduplicate
from quarryweb.llm.packing import pack_documents
from quarryweb.llm.quality import fit, quality_score
from quarryweb.llm.secrets import redact_secrets

#: No SQL expresses a trained classifier or this packing.
ORACLE_SQL = None


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; null texts are scored as empty ones, equal rows alike.

    The model learns from the labelled rows of docs that are not held out;
    without labels of both kinds it keeps all or, if all are bad, none.
    """
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = fit(docs.where(id_fold("doc_id", 3) != 1), labels.where(id_fold("doc_id", 3) != 1))
    score = free_name(docs, "quality_score")
    return docs.withColumn(score, quality_score(F.col("text"), model)).where(F.col(score) >= 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id (null last; of one id, that of the least hash of its text); equal rows are a group. Documents without words all stay."""
    return deduplicate(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts stay, and equal rows stay or go together."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, equal rows too, each secret replaced by a mark, and n_chars as it is then; null texts stay null and have no n_chars."""
    bounded_batches(spark)
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, equal rows too, and their places in sequences of at most 2048 tokens; null texts are empty. pack_documents can add each piece's ids."""
    return pack_documents(docs, name="pipeline-pieces")


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_documents),
    ("secrets", redact),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
