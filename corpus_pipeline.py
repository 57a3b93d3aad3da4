"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.  run() writes every stage's result to the shared
folder and rereads it as the next one's input.

Defined cases of all stages: an empty table gives no rows; null and empty texts
are judged like any text without words; texts of any length are read whole; rows
with a null id stay in the near-duplicate stage; repeated rows are judged alike,
and one of them is kept there; of rows with one id but different texts the links
of any count for all; columns beyond those of documents are left out, and none
of their names can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm import decontaminate, mixing, near_dedup, quality, secrets
from annulus.llm._blocks import shared_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score of at least 0.7)."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id. Rows with a null id, or without words, all stay."""
    found = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(found, "doc_id", "left_anti")
    # repeated rows of a kept id are copies too
    with_id = rest.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return with_id.unionByName(rest.where(F.col("doc_id").isNull())).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), decontaminate.Retriever(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `copies`."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", clean), ("secrets", safe), ("mix", mixed)]

#: The stages learn, hash and draw at random: SQL can't express them, tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), path, name)
    return STAGES[-1][1](spark, docs, sf_dir)
