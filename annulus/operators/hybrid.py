"""Filtered nearest neighbours: the dispatcher, over-fetching, partitioned tables, padding and iteration."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import search_mode
from .filters import Filter, matching, predicate, tree_of
from .search import batch_search, top_k


def matched_count(rows: DataFrame, where: dict | Filter | None) -> tuple[int, int]:
    """Rows and matching rows."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(predicate(rows, where)).alias("m")).first()
    return r["n"], r["m"]


def iterative_search(rows: DataFrame, queries: DataFrame, k: int, where, metric: str = "l2", pool: int = 0) -> DataFrame:
    """Nearest rows are fetched first and filtered after; the pool doubles until each query has k matches or the table is spent."""
    n, m = matched_count(rows, where)
    want, pool = min(k, m), pool or 2 * k
    asked = queries.select("qid").distinct().count()
    flags = rows.select("id", predicate(rows, where).alias("_ok"))
    while True:
        near = batch_search(rows.select("id", "v"), queries, min(pool, max(n, 1)), metric).drop("rk").join(flags, "id").where("_ok").drop("_ok")
        found = top_k(near, k)
        if pool >= n or found.groupBy("qid").count().where(F.col("count") >= want).count() >= asked:
            return found
        pool *= 2


def hybrid_search(rows: DataFrame, queries: DataFrame, k: int, where: dict | Filter | None = None, metric: str = "l2", hint: str | None = None, brute_force: bool = False) -> DataFrame:
    """(qid, id, dist, rk) by the mode that hint and costs choose; all modes give the exact rows."""
    tree = tree_of(where)
    filtered = bool(tree.conditions or tree.filters)
    mode = "exact" if brute_force or not filtered else search_mode(k, *matched_count(rows, where), hint, filtered)
    if mode == "iterative_filter":
        return iterative_search(rows, queries, k, where, metric)
    return batch_search(rows, queries, k, metric, where if filtered else None)


def build_view(rows: DataFrame, field: str, path: str, most: int = 128) -> None:
    """The table partitioned by a field of 2 to `most` values, for pruned reads; replaced as a whole."""
    n = rows.select(field).distinct().limit(most + 1).count()
    if not 2 <= n <= most:
        raise ValueError(f"{field} must have 2 to {most} values")
    rows.withColumn("_value", F.col(field)).write.mode("overwrite").partitionBy("_value").parquet(path)


def view_search(spark, path: str, field: str, values: list, queries: DataFrame, k: int, metric: str = "l2", residual: dict | Filter | None = None) -> DataFrame:
    """Searches the partitions of the values only, then merges by (dist, id)."""
    rows = spark.read.parquet(path).where(F.col("_value").isin(values))
    return batch_search(matching(rows, residual), queries, k, metric)


def padded(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, ids, dists) with exactly k places: missing ones are null and NaN."""
    got = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "id", "dist"))).alias("h"))
    at = F.sequence(F.lit(0), F.lit(k - 1))
    return queries.select("qid").join(got, "qid", "left").select("qid", F.transform(at, lambda i: F.get("h", i)["id"]).alias("ids"), F.transform(at, lambda i: F.coalesce(F.get("h", i)["dist"], F.lit(float("nan")))).alias("dists"))


def iterate(rows: DataFrame, query: list[float], metric: str = "l2", where: dict | Filter | None = None) -> Iterator[tuple[int, float]]:
    """(id, distance) in order, fetched partition by partition."""
    from ..functions import distance

    q = F.array(*[F.lit(float(x)) for x in query])
    for r in matching(rows, where).select("id", distance(metric, "v", q).alias("dist")).orderBy("dist", "id").toLocalIterator():
        yield r["id"], r["dist"]
