"""Keyed tables: inserts, upserts, deletes, log replay, compaction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import matching, predicate


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != "")).groupBy(key).count().where("count > 1").select(key)


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append; a key that repeats within the rows or exists raises ValueError and changes nothing."""
    clash = repeated_keys(rows, key).unionByName(rows.join(table, key, "left_semi").select(key)).limit(1).collect()
    if clash:
        raise ValueError(f"Duplicate item_id: {clash[0][0]}")
    return table.unionByName(rows)


def last_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`. Without an order a key that repeats raises ValueError."""
    if order is None:
        clash = repeated_keys(rows, key).limit(1).collect()
        if clash:
            raise ValueError(f"Duplicate item_id: {clash[0][0]}")
        return rows
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace or append; of rows with one key the last by `order` counts."""
    rows = last_of(rows, key, order)
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Unknown keys are skipped."""
    return table.join(keys.select(key), key, "left_anti")


def delete_where(table: DataFrame, spec: dict) -> DataFrame:
    return table.where(~predicate(table, spec))


def numbered(rows: DataFrame, order: list, at: str, name: str, start: int = 0, ranges: list | None = None) -> DataFrame:
    """Rows with `name`: start, start + 1, ... in an order, without one task for all rows. ranges: columns of the same order that cost less.

    The sorted ranges are written to the folder `at` once, since a second evaluation
    of the plan may cut or join ranges otherwise; then each range starts where the
    ones before it end.
    """
    spark = rows.sparkSession
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    placed = rows.repartitionByRange(*(ranges or order)).withColumns(keys)
    placed.sortWithinPartitions(*keys).drop(*keys).withColumn("_m", F.monotonically_increasing_id()).write.parquet(at)
    held, part = spark.read.parquet(at), F.shiftright("_m", 33)
    counts = {r["p"]: r["count"] for r in held.groupBy(part.alias("p")).count().collect()}
    before, total = [], start
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return held.withColumn(name, F.get(F.lit(before).cast("array<bigint>"), part.cast("int")) + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


def replay(base: DataFrame, log: DataFrame, key: str, applied: int = -1) -> DataFrame:
    """Base with the last operation per key of a log (op_id, op in upsert/delete, columns of base) after `applied`."""
    columns = [c for c in base.columns if c != key]
    last = log.where(F.col("op_id") > applied).groupBy(key).agg(F.max_by(F.struct("op", *columns), "op_id").alias("r"))
    kept = base.join(last, key, "left_anti")
    return kept.unionByName(last.where("r.op = 'upsert'").select(key, *[F.col(f"r.{c}").alias(c) for c in columns]))


def filter_query(table: DataFrame, spec: dict, limit: int, order: str) -> DataFrame:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return matching(table, spec).orderBy(order).limit(limit)


def get_by_key(table: DataFrame, keys: list, key: str) -> DataFrame:
    """Rows in the order of the request; repeats repeat, misses are skipped."""
    ask = table.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("pos", key))
    return ask.join(table, key).orderBy("pos")


def contains_key(table: DataFrame, value, key: str) -> bool:
    return bool(table.where(F.col(key) == F.lit(value)).limit(1).count())


def available(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The keys that the table doesn't have."""
    return keys.select(key).join(table, key, "left_anti")


def members_by_value(table: DataFrame, field: str, key: str, most: int = 128) -> DataFrame:
    """(field, members) sorted keys by value; more than `most` values, or fewer than two, raise ValueError."""
    n = table.select(field).where(F.col(field).isNotNull()).distinct().limit(most + 1).count()
    if not 2 <= n <= most:
        raise ValueError(f"{field} has {'more than ' + str(most) if n > most else n} values")
    return table.where(F.col(field).isNotNull()).groupBy(field).agg(F.sort_array(F.collect_list(key)).alias("members"))


def digest(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(rows, sha256) of a table's content, whatever its order: row digests are summed in an exact decimal."""
    row = F.sha2(F.to_json(F.struct(order, *[c for c in columns if c != order])), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(5)]
    return table.agg(F.count("*").alias("rows"), *part).select("rows", F.sha2(F.concat_ws("-", "rows", *[F.col(f"s{k}").cast("string") for k in range(5)]), 256).alias("sha256"))
