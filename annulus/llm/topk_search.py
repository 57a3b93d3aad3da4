"""Operator 2: exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets of about BUCKET rows.  A query first
gets a lower bound of its k-th score from the longest bucket; it visits a bucket
only if its bound can be beaten by the bucket's longest vector.  Inside a bucket
the local cosine threshold bound / (|q| * longest) chooses the pruning: by
coordinates (the range of a vector's direction on the query's two largest
coordinates) where the threshold is high, else by length (vectors of at least
bound / |q|).  What is left is verified by its integer product.

Queries are a stated set and travel in blocks to buckets; nothing is broadcast
that grows with the data except one number per bucket and the first bucket.

Defined cases: vectors that are null or hold a null or non-finite component,
and null ids, take no part; vectors of other dimensions are no candidates; the
query's id is never its own candidate; ties go to the smaller id; empty vectors
score 0; repeated rows are separate candidates; further columns are ignored; an
empty table gives no rows.  Products beyond 2**53 are taken in exact integers
and saturate at the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _blocks as B

BUCKET, QUERY_BLOCK = 4096, 512
COORDINATE = 0.55  # local threshold from which coordinates prune better than lengths
SLACK = 1e-9  # relative slack of float bounds; verification is exact


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of integral float64 rows, as int64."""
    if q.size == 0 or v.size == 0:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    return np.clip(to_int(q) @ to_int(v).T, -(2**63), 2**63 - 1).astype(np.int64)


class Bucket:
    """Vectors by falling length, with per-coordinate orders of their directions made on demand."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        norm = np.sqrt((v * v).sum(axis=1))
        order = np.lexsort((ids, -norm))
        self.ids, self.v, self.norm = ids[order], v[order], norm[order]
        self.unit = self.v / np.maximum(self.norm, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def candidates(self, q: np.ndarray, norm: float, bound: float) -> np.ndarray:
        """Rows that may reach the bound (a superset)."""
        if not np.isfinite(bound) or bound <= 0 or norm == 0:
            return np.arange(len(self.ids))
        long = int(np.searchsorted(-self.norm, -(bound / norm) * (1 - SLACK), side="right"))
        t = bound / (norm * max(self.norm[0], 1e-300))
        if t < COORDINATE or t > 1 or long == 0:
            return np.arange(long)
        unit, hit = q / norm, None
        for f in np.argsort(-np.abs(unit))[:2].tolist():
            order, values = self.coordinate(f)
            reach = np.sqrt(max(0.0, 1 - unit[f] ** 2) * max(0.0, 1 - t * t)) + 1e-9
            a, b = np.searchsorted(values, unit[f] * t - reach), np.searchsorted(values, unit[f] * t + reach, side="right")
            if unit[f] ** 2 >= t * t:  # the cone holds the axis: no upper end on the query's side
                a, b = (a, len(values)) if unit[f] > 0 else (0, b)
            m = np.zeros(len(values), dtype=bool)
            m[order[a:b]] = True
            hit = m if hit is None else hit & m
        return np.flatnonzero(hit[:long])

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, candidate, score), at most k a query, none below its bound."""
        norm = np.sqrt((q * q).sum(axis=1))
        wide = []
        for i in range(len(qid)):
            c = self.candidates(q[i], norm[i], bound[i])
            if len(c) > len(self.ids) // 4:
                wide.append(i)
            elif len(c):
                yield from self._best(qid[i], c, products(q[i : i + 1], self.v[c])[0], bound[i], k)
        for lo in range(0, len(wide), 64):
            rows = wide[lo : lo + 64]
            scores = products(q[rows], self.v)
            for i, s in zip(rows, scores):
                yield from self._best(qid[i], np.arange(len(self.ids)), s, bound[i], k)

    def _best(self, qid: int, c: np.ndarray, s: np.ndarray, bound: float, k: int):
        use = self.ids[c] != qid
        if np.isfinite(bound):
            use &= s >= bound
        c, s = c[use], s[use]
        if len(s) > 4 * k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            c, s = c[s >= cut], s[s >= cut]
        for j in np.lexsort((self.ids[c], -s))[:k]:
            yield int(qid), int(self.ids[c[j]]), int(s[j])


def _matrix(dim: int, raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)


def integral_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, norm, v): usable vectors as floor(scale * x), packed float64."""
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            flat = np.floor(scale * flat)
            size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            cut = np.concatenate([[0], np.cumsum(size)])
            norm = [float(np.sqrt((flat[a:b] ** 2).sum())) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(norm, pa.float64()), pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["vec_id", "dim", "norm", "v"])

    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(pack, "vec_id long, dim long, norm double, v binary")


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by `every` the k largest integer products with all other rows."""
    path = B.shared_dir(vectors.sparkSession)
    rows = B.written(integral_vectors(vectors, scale, id_col, vector_col), path, "vectors")
    n = rows.count()
    n_buckets = max(1, -(-n // BUCKET))

    def to_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, part, made = [], TaskContext.get().partitionId() << 32, 0

        def flush():
            nonlocal made
            dim = held[0][1]
            v = _matrix(dim, [h[3] for h in held])
            row = pa.record_batch([pa.array([part + made], pa.int64()), pa.array([dim], pa.int64()), pa.array([max(h[2] for h in held)], pa.float64()), pa.array([B.pack(np.array([h[0] for h in held], dtype=np.int64), v.ravel())], pa.binary())], names=["block", "dim", "longest", "payload"])
            held.clear()
            made += 1
            return row

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if held and (held[0][1] != r[1] or len(held) == BUCKET):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    by = [F.col("dim"), F.col("norm").desc(), F.col("vec_id")]
    buckets = B.written(rows.repartitionByRange(n_buckets, *by).sortWithinPartitions(*by).mapInArrow(to_buckets, "block long, dim long, longest double, payload binary"), path, "buckets", "uncompressed")
    shape = sorted(buckets.select("dim", "longest", "block").collect(), key=lambda r: (r["dim"], -r["longest"], r["block"]))  # three numbers per 4,096 vectors
    first = {}
    for r in shape:
        first.setdefault(r["dim"], r["block"])
    longest: dict[int, list[tuple[int, float]]] = {}
    for r in shape:
        longest.setdefault(r["dim"], []).append((r["block"], r["longest"]))
    # one bucket a dimension: at most 4,096 vectors each
    seed = {r["block"]: bytes(r["payload"]) for r in buckets.where(F.col("block").isin([int(b) for b in list(first.values())[:16]])).select("block", "payload").collect()} if first else {}

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = 0
        for batch in batches:
            table = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            for lo in range(0, len(table), QUERY_BLOCK):
                for dim in {r[1] for r in table[lo : lo + QUERY_BLOCK]}:
                    mine = [r for r in table[lo : lo + QUERY_BLOCK] if r[1] == dim]
                    qid, q, norm = np.array([r[0] for r in mine], dtype=np.int64), _matrix(dim, [r[3] for r in mine]), np.array([r[2] for r in mine])
                    bound = np.full(len(qid), -np.inf)
                    if (b := first[dim]) in seed:
                        if b not in opened:
                            ids, flat = B.unpack(seed[b])
                            opened[b] = ids, flat.reshape(len(ids), dim)
                        ids, v = opened[b]
                        if len(ids) > k + 1:
                            s = products(q, v).astype(np.float64)
                            s[ids[None, :] == qid[:, None]] = -np.inf
                            bound = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                    out = []
                    for block, top in longest[dim]:
                        use = (bound <= 0) | (norm * top * (1 + SLACK) >= bound)
                        if use.any():
                            out.append((at, block, 0, B.pack(qid[use], q[use].ravel(), bound[use])))
                            at += 1
                    yield B.rows_batch(out)

    queries = rows.where(F.col("vec_id") % every == 0)
    sent = queries.repartition(max(1, -(-n // every // QUERY_BLOCK)), F.xxhash64("vec_id")).mapInArrow(send, B.ROWS)

    def search(block: int, payload: bytes, replies) -> Iterator[pa.RecordBatch]:
        ids, flat = B.unpack(payload)
        bucket = Bucket(ids, flat.reshape(len(ids), -1))
        for _, _, p in replies:
            qid, q, bound = B.unpack(p)
            if found := list(bucket.search(qid, q.reshape(len(qid), -1), bound, k)):
                a, b, c = zip(*found)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])

    found = B.join_blocks(buckets, [sent], search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
