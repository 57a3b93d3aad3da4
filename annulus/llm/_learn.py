"""Labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(id_col, parts: int) -> F.Column:
    """crc32 of the id's text, modulo parts; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bound: int, most_bytes: int = 1 << 28) -> DataFrame:
    """At most `bound` labelled rows (doc_id, text, y) and `most_bytes` of text outside the held-out fold, half of each class at most; chosen by a hash of the id.

    The label table is reduced to the chosen ids first, so its broadcast has a
    proven bound of `bound` rows.  Labels that are null or repeat with other
    values are left out.  Of rows with one id those of the least text hash come
    first.  Only id and text of the documents are read.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    y = y.where(fold("doc_id", parts) != held).withColumn("r", F.xxhash64("doc_id", F.lit(11)))
    chosen = y.where("y = 1").orderBy("r", "doc_id").limit(bound // 2).unionByName(y.where("y = 0").orderBy("r", "doc_id").limit(bound // 2))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = src.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("_id"), "y", "r")), F.col("doc_id") == F.col("_id"))
    by = Window.partitionBy("y").orderBy("r", "doc_id", F.xxhash64("text"))
    # ranks limit the rows before they meet in one task, sizes what is left
    sized = rows.select("doc_id", "r", "y", "text", F.row_number().over(by).alias("k")).where(F.col("k") <= bound // 2)
    return sized.withColumn("size", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(by)).where(F.col("size") <= most_bytes // 2).select("doc_id", "text", "y")
