"""Exact nearest neighbours as joins: single, batch, filtered, partition-merged; recall and reranking.

Order is (distance, id) everywhere.  The query side is broadcast only up to
QUERY_LIMIT rows (counted first); beyond it rows are written once as blocks of
matrices, which tasks of queries read, so neither side is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import METRICS, distance
from ..sources import opened, shared_dir
from .filters import Filter, matching

QUERY_LIMIT = 4096
GROUPS = 64  # at least, beyond QUERY_LIMIT queries
NO_PAIRS = (np.zeros(0, np.int64), np.zeros(0, np.int64))
WHOLE = ("bigint", "int", "smallint", "tinyint")
BLOCK = 4096  # rows of a block
STEP = 512  # queries of one product
LOAD = 16_384  # queries of a task
HELD = 32 << 20  # bytes of queries that a task holds at once
PAIRS = 32_768  # pairs that are compared at once by the definition


def top_k(df: DataFrame, k: int, group: str = "qid", dist: str = "dist", key: str = "id") -> DataFrame:
    """First k of each group; Spark limits groups before and after the shuffle."""
    if k <= 0:
        raise ValueError("limit must be positive")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(dist, key))
    return df.withColumn("rk", rank).where(F.col("rk") <= k)


def pairs(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """All (row, query) pairs of a stated query set, as expressions need them."""
    n = queries.limit(QUERY_LIMIT + 1).count()
    if n <= QUERY_LIMIT:
        return rows.crossJoin(F.broadcast(queries))
    groups = max(GROUPS, rows.sparkSession.sparkContext.defaultParallelism * 4)
    blocks = queries.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.withColumn("_g", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(groups))).join(blocks, "_g").drop("_g")


def block_distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (query, row) of matrix rows by one product."""
    dots = q @ x.T
    if metric == "l2":
        return (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * dots
    if metric == "cos":
        n = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        return np.where(n == 0, 0.0, -dots / np.where(n == 0, 1.0, n))
    return -dots


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up in the order of the components as SQL and the column expressions do."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def pair_distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of equally many rows, by the definition: equal vectors give equal numbers."""
    if metric == "l2":
        return _total((x - q) ** 2)
    dots = _total(x * q)
    if metric == "cos":
        n = np.sqrt(_total(q * q)) * np.sqrt(_total(x * x))
        return np.where(n == 0, 0.0, -dots / np.where(n == 0, 1.0, n))
    return -dots


def _left(metric: str, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of queries, whose products with _right's are the distances, and the queries' lengths."""
    n = np.sqrt((q * q).sum(axis=1))
    if metric == "l2":
        return np.column_stack([q, n * n, np.ones(len(q))]), n
    return (q / np.where(n == 0, 1.0, n)[:, None], np.ones(len(q))) if metric == "cos" else (q, n)


def _right(metric: str, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Factors of rows, and the largest length."""
    n = np.sqrt((x * x).sum(axis=1))
    if metric == "l2":
        return np.column_stack([-2 * x, np.ones(len(x)), n * n]).T, n.max(initial=0)
    return (-(x / np.where(n == 0, 1.0, n)[:, None]).T, 1.0) if metric == "cos" else (-x.T, n.max(initial=0))


class Nearest:
    """The k first rows of each query by (distance, id), over blocks of rows that come one after another.

    Products of blocks tell which rows may be among them; these few are compared by
    the definition, since products round.  own: a query's own id may be among them.
    """

    fields = ("qid long", "id long", "dist double")

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, metric: str = "l2", own: bool = True):
        self.qid, self.q, self.k, self.metric, self.own = qid, q, k, metric, own
        self.left, self.length = _left(metric, q)
        with np.errstate(over="ignore"):
            self.left32 = self.left.astype(np.float32)
        self.cut = np.full(len(qid), np.inf)  # the k-th distance so far
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.best = [none] * -(-len(qid) // STEP)

    def seed(self, d: np.ndarray, at: slice, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowers the bounds of queries that have none; pairs that need no further look."""
        if d.shape[1] > self.k and np.isinf(self.cut[at]).any():
            self.cut[at] = np.minimum(self.cut[at], np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + slack)
        return NO_PAIRS

    def limit(self, at: slice) -> np.ndarray:
        """Up to what product a row may be among a query's first."""
        return self.cut[at]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        ok = np.isfinite(x).all(axis=1)
        self.compare(ids[ok], x[ok], x[ok])

    def compare(self, ids: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
        """Rows x, of which `near` tells which to look at: by single precision, or by double if that leaves too many."""
        if not len(ids):
            return
        right, longest = _right(self.metric, near)
        right32 = right.astype(np.float32) if max(longest, self.length.max(initial=0)) < 1e15 else None
        order = np.argsort(ids, kind="stable")
        for s, lo in enumerate(range(0, len(self.qid), STEP)):
            at = slice(lo, lo + STEP)
            skip_i, skip_j = NO_PAIRS if self.own else self.same(at, ids, order)
            scale = (near.shape[1] + 8) * (self.length[at] + longest) ** 2
            seeded = False
            for single in (True, False) if right32 is not None else (False,):
                slack = (1.2e-7 if single else 1e-15) * scale + 1e-12
                d = self.left32[at] @ right32 if single else self.left[at] @ right
                d[skip_i, skip_j] = np.inf
                if not seeded:
                    more, seeded = self.seed(d, at, slack), True
                    skip_i, skip_j = np.concatenate([skip_i, more[0]]), np.concatenate([skip_j, more[1]])
                    d[more] = np.inf
                limit = np.minimum(self.limit(at) + slack, np.finfo(d.dtype).max).astype(d.dtype)
                flat = np.flatnonzero(d <= np.nextafter(limit, d.dtype.type(np.inf), where=limit < np.finfo(d.dtype).max, out=limit)[:, None])
                if len(flat) <= d.size >> 6:
                    break
            if len(flat):
                self.merge(s, at, *np.divmod(flat, d.shape[1]), ids, x)

    def same(self, at: slice, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and its own row."""
        first, last = (np.searchsorted(ids, self.qid[at], side, sorter=order) for side in ("left", "right"))
        i = np.flatnonzero(last > first)
        return np.repeat(i, (last - first)[i]), np.concatenate([order[:0], *(order[first[r] : last[r]] for r in i)])

    def exact(self, at: slice, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> np.ndarray:
        q = self.q[at]
        return np.concatenate([pair_distances(self.metric, x[j[a : a + PAIRS]], q[i[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)])

    def merge(self, s: int, at: slice, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        dist, ids = self.exact(at, i, j, x), ids[j]
        i, ids, dist = (np.concatenate([old, new]) for old, new in zip(self.best[s], (i, ids, dist)))
        order = np.lexsort((ids, dist, i))
        i, ids, dist = i[order], ids[order], dist[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        use = (rank < self.k) & np.isfinite(dist)
        self.best[s] = i[use], ids[use], dist[use]
        last = use & (rank == self.k - 1)
        self.cut[at.start + i[last]] = np.minimum(self.cut[at.start + i[last]], dist[last])

    def found(self) -> Iterator[pa.RecordBatch]:
        for s, (i, *rest) in enumerate(self.best):
            if len(i):
                yield pa.record_batch([pa.array(c) for c in (self.qid[s * STEP + i], *rest)], names=[f.split()[0] for f in self.fields])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vector_blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, matrix) of at most BLOCK rows (id, v)."""
    for a in range(0, batch.num_rows, BLOCK):
        part = batch.slice(a, BLOCK)
        yield part.column(0).to_numpy().astype(np.int64), _matrix(part.column(1))


def stored(rows: DataFrame, blocks=vector_blocks) -> list[str]:
    """Files of the rows as packed blocks in the shared folder, each row once; the column `part`, if any, becomes a folder."""
    by = "part" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(batch.num_columns - 1).to_numpy() if by else np.zeros(batch.num_rows)
            ends = [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip([0, *ends], ends):
                for block in blocks(batch.slice(a, b - a)):
                    packed = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in block]
                    yield pa.record_batch([*packed, *([pa.array([int(parts[a])], pa.int32())] if by else [])], names=[*(f"c{c}" for c in range(len(packed))), *(["part"] if by else [])])

    spark, n = rows.sparkSession, blocks.columns if hasattr(blocks, "columns") else 2
    path = f"{shared_dir(spark)}/blocks"
    # whole parts are together; otherwise as many even files as tasks can share
    placed = rows.repartition("part").sortWithinPartitions("part") if by else rows.repartition(4 * spark.sparkContext.defaultParallelism)
    out = placed.mapInArrow(run, ", ".join([*(f"c{c} binary" for c in range(n)), *(["part int"] if by else [])])).write
    (out.partitionBy("part") if by else out).option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def _read(path: str) -> Iterator[list[bytes]]:
    """The packed blocks of a file, one at a time."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        for batch in pq.ParquetFile(f, pre_buffer=False).iter_batches(1):
            for r in range(batch.num_rows):
                yield [batch.column(c)[r].as_py() for c in range(batch.num_columns)]


def unpacked(block: list[bytes]) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(block[0], np.int64)
    return ids, np.frombuffer(block[1]).reshape(len(ids), -1)


def met(queries: DataFrame, n: int, files: list[list[str]], make, unpack=unpacked) -> DataFrame:
    """What make(qid, matrix) finds for queries (qid, qv, part) in the files of their part.

    A task holds some LOAD queries of one part and reads that part's blocks one after
    another: queries are sent once a part, rows not at all.
    """
    m = max(1, -(-n // LOAD))
    fields = make(np.zeros(0, np.int64), np.zeros((0, 1))).fields

    def search(qid: list, q: list, part: list) -> Iterator[pa.RecordBatch]:
        qid, q, part = np.concatenate(qid), np.concatenate(q), np.concatenate(part)
        for p in np.unique(part):
            here = part == p
            state = make(qid[here], q[here])
            for path in files[p]:
                for block in _read(path):
                    state.add(*unpack(block))
            yield from state.found()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            if batch.num_rows:
                for into, c in zip(held, (batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1)), batch.column(2).to_numpy())):
                    into.append(c)
                if sum(c.nbytes for c in held[1]) >= HELD:
                    yield from search(*held)
                    held = ([], [], [])
        if held[0]:
            yield from search(*held)

    q = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"), F.col("part").cast("int"))
    placed = q.repartitionById(max(1, len(files) * m), (F.col("part") * m + F.pmod(F.xxhash64("qid"), F.lit(m))).cast("int"))
    return placed.mapInArrow(run, ", ".join(fields))


def over_blocks(rows: DataFrame, queries: DataFrame, make, blocks=vector_blocks, unpack=unpacked) -> DataFrame:
    """What make(qid, matrix) finds for queries (qid, qv) over all rows, by parts of the rows.

    Up to QUERY_LIMIT queries (counted first) go to all tasks of the rows.  Else rows
    are written once as packed blocks, and queries go to parts of their files, of
    which there are fewer the more queries there are.
    """
    n = queries.limit(QUERY_LIMIT + 1).count()
    if n <= QUERY_LIMIT:
        qid, q = _collected(queries, "qid", "qv")

        def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = make(qid, q)
            for batch in batches:
                for block in blocks(batch) if len(qid) else ():
                    state.add(*block)
            yield from state.found()

        return rows.mapInArrow(near, ", ".join(make(qid[:0], q[:0]).fields))
    n, files = queries.count(), stored(rows, blocks)
    parts = min(len(files), -(-4 * rows.sparkSession.sparkContext.defaultParallelism // -(-n // LOAD)))
    sent = queries.select("qid", "qv", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return met(sent, n, [files[p::parts] for p in range(parts)], make, unpack)


def _collected(rows: DataFrame, id_col: str, v_col: str) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select(F.col(id_col).cast("long").alias("i"), F.col(v_col).cast("array<double>").alias("v")).toPandas()
    return got["i"].to_numpy(dtype=np.int64), np.array(got["v"].tolist(), dtype=np.float64).reshape(len(got), -1 if len(got) else 1)


def block_search(rows: DataFrame, queries: DataFrame, k: int, metric: str, own: bool = True) -> DataFrame:
    """(qid, id, dist): the best rows per query of each part of the rows, by matrix products. Rows that are few go to the tasks of many queries."""
    rows = rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    queries = queries.where(F.col("qv").isNotNull()).select(F.col("qid").cast("long"), F.col("qv").cast("array<double>"))
    make = lambda qid, q: Nearest(qid, q, k, metric, own)
    if rows.limit(QUERY_LIMIT + 1).count() > QUERY_LIMIT or queries.limit(QUERY_LIMIT + 1).count() <= QUERY_LIMIT:
        return over_blocks(rows, queries, make)
    ids, x = _collected(rows, "id", "v")

    def far(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vector_blocks(batch):
                state = make(*block)
                state.add(ids, x)
                yield from state.found()

    return queries.mapInArrow(far, ", ".join(Nearest.fields))


def batch_search(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: dict | Filter | None = None) -> DataFrame:
    """(qid, id, dist, rk) for queries (qid, qv) over rows (id, v, further columns for the filter)."""
    if k <= 0:
        raise ValueError("limit must be positive")
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    found = matching(rows, where).select("id", "v")
    if dict(found.dtypes)["id"] in WHOLE:
        return top_k(block_search(found, queries.select("qid", "qv"), k, metric), k)
    d = pairs(found.where(F.col("v").isNotNull()), queries.select("qid", "qv")).select("qid", "id", distance(metric, "v", "qv").alias("dist"))
    return top_k(d, k)


def single_search(rows: DataFrame, query: list[float], k: int, metric: str = "l2", where: dict | Filter | None = None) -> DataFrame:
    """(id, dist) of the k nearest; plans as a TakeOrderedAndProject."""
    if k <= 0:
        raise ValueError("limit must be positive")
    found = matching(rows, where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return found.select("id", distance(metric, "v", q).alias("dist")).orderBy("dist", "id").limit(k)


def with_payload(hits: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Late materialisation: wide columns join only the hits."""
    return hits.join(rows.select("id", *columns), "id")


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances for approximate (qid, id) candidates."""
    exact = candidates.select("qid", "id").distinct().join(rows.select("id", "v"), "id").join(queries.select("qid", "qv"), "qid")
    return top_k(exact.select("qid", "id", distance(metric, "v", "qv").alias("dist")), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall) mean share of the true neighbours that were found."""
    t = truth.groupBy("qid").agg(F.collect_set("id").alias("t"))
    f = found.groupBy("qid").agg(F.collect_set("id").alias("f"))
    return t.join(f, "qid", "left").agg(F.avg(F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<bigint>")))) / float(k)).alias("recall"))


def neighbour_graph(rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(src, dst, dist, pos): exact k nearest other rows of each row."""
    q = rows.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    return top_k(block_search(rows, q, k, metric, own=False), k).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist", F.col("rk").alias("pos"))


def with_reverse(edges: DataFrame, k: int) -> DataFrame:
    """Edges and their reverses, without repeats, the k nearest of each node."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    return top_k(both, k, "src", "dist", "dst").withColumnRenamed("rk", "pos")


def fused(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two graphs' edges without repeats."""
    return a.select("src", "dst", "dist").unionByName(b.select("src", "dst", "dist")).dropDuplicates(["src", "dst"])
