"""Index construction over tables (id, v): k-means cells, codes, proximity graphs; and searches over them.

Fitting uses a bounded, documented sample (SAMPLE rows by a hash of the id);
every row is indexed.  Graphs are edges (src, dst, dist, pos); pruning works on
one node's candidates at a time, whose number the degree bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import l2_squared
from ..functions.codes import PCA, OneBit, ProductQuantizer, lloyd, random_rotation
from .search import Nearest, _matrix, batch_search, block_distances, met, neighbour_graph, rerank, stored, top_k, with_reverse

SAMPLE = 20_000


def sample_rows(rows: DataFrame, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in every run, in the order of their ids."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).orderBy("id")


def bernoulli_sample(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each row with the given probability, by a hash of its id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))


def sampled_matrix(rows: DataFrame, n: int = SAMPLE, seed: int = 0) -> np.ndarray:
    got = sample_rows(rows.where(F.col("v").isNotNull()), n, seed).select(F.col("v").cast("array<double>").alias("v")).toPandas()
    return np.array(got["v"].tolist(), dtype=np.float64)


def kmeans(rows: DataFrame, k: int, seed: int = 0, rounds: int = 10, tol: float = 1e-5, sample: int = SAMPLE) -> np.ndarray:
    """Centres (k, dim): k-means++ and Lloyd steps on a sample, then Lloyd steps over all rows until the cost settles. A step sends one sum per centre and partition."""
    centres = lloyd(sampled_matrix(rows, sample, seed), k, seed)
    last = np.inf
    for _ in range(rounds):
        fixed = centres

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, cost = np.zeros(len(fixed), dtype=np.int64), np.zeros_like(fixed), 0.0
            for batch in batches:
                x = _matrix(batch.column(0))
                if len(x):
                    d = block_distances("l2", fixed, x)
                    at = d.argmin(axis=1)
                    cost += float(d[np.arange(len(x)), at].sum())
                    n += np.bincount(at, minlength=len(fixed))
                    np.add.at(total, at, x)
            yield pa.record_batch([pa.array(range(len(fixed)), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.float64())), pa.array([cost] + [0.0] * (len(fixed) - 1))], names=["c", "n", "s", "cost"])

        parts = rows.where(F.col("v").isNotNull()).select(F.col("v").cast("array<double>")).mapInArrow(sums, "c int, n long, s array<double>, cost double")
        got = parts.select("c", "n", "cost", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("cost").alias("cost")).toPandas()
        got = got.sort_values(["c", "i"])
        n = got["n"].to_numpy().reshape(len(centres), -1)
        centres = np.where(n > 0, got["x"].to_numpy().reshape(centres.shape) / np.maximum(n, 1), centres)
        cost = got[got["i"] == 0]["cost"].sum()
        if last - cost <= tol * max(abs(cost), 1e-12):
            break
        last = cost
    return centres


def centre_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell long, c array<double>")


def cells_of(rows: DataFrame, centres: np.ndarray, copies: int = 1) -> DataFrame:
    """(id, cell, rk): each row's nearest centres by one matrix product a batch; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = block_distances("l2", centres, _matrix(batch.column(1)))
            at = np.argsort(d, axis=1, kind="stable")[:, :copies]
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), at.shape[1])), pa.array(at.ravel().astype(np.int64)), pa.array(np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), len(at)))], names=["id", "cell", "rk"])

    return rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "id long, cell long, rk int")


def cells_within(rows: DataFrame, most: int, seed: int = 0, grow: float = 1.5) -> np.ndarray:
    """As few centres, growing from one estimate, as keep every cell at `most` rows."""
    n = rows.count()
    k = max(1, -(-n // most))
    while True:
        centres = kmeans(rows, k, seed)
        if k >= n or cells_of(rows, centres).groupBy("cell").count().agg(F.max("count")).first()[0] <= most:
            return centres
        k = max(k + 1, int(k * grow))


def probed_search(rows: DataFrame, cells: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "l2") -> DataFrame:
    """(qid, id, dist, rk): queries meet the rows of their nearest `probes` cells, by matrix products over a cell's blocks."""
    if k <= 0:
        raise ValueError("limit must be positive")
    near = cells_of(queries.select(F.col("qid").alias("id"), F.col("qv").alias("v")), centres, probes).select(F.col("id").alias("qid"), F.col("cell").alias("part"))
    kept = rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    files: list[list[str]] = [[] for _ in centres]
    for path in stored(kept.join(cells.select("id", F.col("cell").cast("int").alias("part")), "id")):
        files[int(path.rsplit("/", 2)[1].split("=")[1])].append(path)
    # a cell's share of the queries, if they are spread evenly
    found = met(queries.join(near, "qid").select("qid", "qv", "part"), -(-queries.count() * probes // len(centres)), files, lambda qid, q: Nearest(qid, q, k, metric))
    return top_k(found.distinct(), k)


def pca_fit(rows: DataFrame, k: int) -> PCA:
    """Over all rows: partitions send a count, a sum and a sum of outer products."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, None, None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, total, products = n + len(x), x.sum(axis=0) + (0 if total is None else total), x.T @ x + (0 if products is None else products)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([np.concatenate([total, products.ravel()])], pa.list_(pa.float64()))], names=["n", "m"])

    parts = rows.where(F.col("v").isNotNull()).select(F.col("v").cast("array<double>")).mapInArrow(run, "n long, m array<double>")
    n = parts.agg(F.sum("n")).first()[0]
    m = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    dim = int((np.sqrt(1 + 4 * len(m)) - 1) / 2)
    return PCA.from_moments(n, m[:dim], m[dim:].reshape(dim, dim), k)


def mapped(rows: DataFrame, fn, out: str = "v") -> DataFrame:
    """(id, out): a matrix function of the vectors, by batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(list(np.asarray(fn(_matrix(batch.column(1))), dtype=np.float64)), pa.list_(pa.float64()))], names=["id", out])

    return rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, f"id long, {out} array<double>")


def _scored(rows: DataFrame, queries: DataFrame, score) -> DataFrame:
    """(qid, id, dist) of a driver-sized query set: score(matrix, query) by batches."""
    got = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>")).toPandas()
    qid, q = got["qid"].tolist(), [np.array(v) for v in got["qv"]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for i, d in zip(qid, score(batch, q)):
                    yield pa.record_batch([pa.array([i] * batch.num_rows, pa.int64()), batch.column(0), pa.array(d)], names=["qid", "id", "dist"])

    return rows.mapInArrow(run, "qid long, id long, dist double")


def pq_train(rows: DataFrame, chunks: int, seed: int = 0, sample: int = SAMPLE) -> ProductQuantizer:
    return ProductQuantizer.train(sampled_matrix(rows, sample, seed), chunks, seed)


def pq_encode(rows: DataFrame, pq: ProductQuantizer) -> DataFrame:
    """(id, code): one byte a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in pq.encode(_matrix(batch.column(1)))], pa.binary())], names=["id", "code"])

    return rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "id long, code binary")


def pq_search(rows: DataFrame, codes: DataFrame, pq: ProductQuantizer, queries: DataFrame, k: int, pool: int = 0) -> DataFrame:
    """Asymmetric distances keep `pool` (3k by default) rows a query; exact distances decide."""

    def score(batch, q):
        c = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return [pq.distances(pq.query_table(x), c) for x in q]

    near = top_k(_scored(codes.select("id", "code"), queries, score), pool or 3 * k)
    return rerank(near, rows, queries, k)


def one_bit_fit(rows: DataFrame, seed: int = 0) -> OneBit:
    from .statistics import as_vector, by_dimension

    mean = np.array(as_vector(by_dimension(rows), "mean").first()["mean"])
    return OneBit(mean, random_rotation(len(mean), seed))


def one_bit_encode(rows: DataFrame, model: OneBit) -> DataFrame:
    """(id, bits, length, cosine)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, cosine = model.encode(_matrix(batch.column(1)))
                yield pa.record_batch([batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(cosine)], names=["id", "bits", "length", "cosine"])

    return rows.where(F.col("v").isNotNull()).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "id long, bits binary, length double, cosine double")


def one_bit_search(rows: DataFrame, codes: DataFrame, model: OneBit, queries: DataFrame, k: int, pool: int = 0) -> DataFrame:
    """Estimated distances keep `pool` (10k by default) rows a query; exact distances decide."""

    def score(batch, q):
        bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return [model.estimate(x, bits, batch.column(2).to_numpy(), batch.column(3).to_numpy()) for x in q]

    near = top_k(_scored(codes.select("id", "bits", "length", "cosine"), queries, score), pool or 10 * k)
    return rerank(near, rows, queries, k)


def occluded(dist: np.ndarray, between: np.ndarray, degree: int, alpha: float = 1.2) -> list[int]:
    """Candidates kept by robust pruning: nearest first, one is dropped while a kept one is alpha times nearer to it than the node is; alpha rises from 1 by the factor 1.2. dist: node to candidates, sorted; between: candidates to candidates."""
    kept: list[int] = []
    factor = np.zeros(len(dist))
    a = 1.0
    while a <= alpha + 1e-9 and len(kept) < degree:
        for i in range(len(dist)):
            if len(kept) >= degree:
                break
            if factor[i] > a:
                continue
            factor[i] = np.inf
            kept.append(i)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(between[i] == 0, np.inf, dist / between[i])
            factor = np.maximum(factor, np.where(np.arange(len(dist)) > i, ratio, factor))
        a *= 1.2
    return kept


def robust_prune(edges: DataFrame, rows: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(src, dst, dist, pos): each node's candidates, at most the table's degree, pruned by occlusion."""
    full = edges.select("src", "dst").where("src <> dst").distinct().join(rows.select(F.col("id").alias("dst"), F.col("v").cast("array<double>").alias("v")), "dst").join(rows.select(F.col("id").alias("src"), F.col("v").cast("array<double>").alias("w")), "src")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, me = np.array(g["v"].tolist()), np.array(g["w"].iloc[0])
        d = ((x - me) ** 2).sum(axis=1)
        order = np.lexsort((g["dst"].to_numpy(), d))
        x, d, dst = x[order], d[order], g["dst"].to_numpy()[order]
        kept = occluded(d, ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), degree, alpha)
        return pd.DataFrame({"src": g["src"].iloc[0], "dst": dst[kept], "dist": d[kept], "pos": np.arange(1, len(kept) + 1, dtype=np.int32)})

    return full.groupBy("src").applyInPandas(run, "src long, dst long, dist double, pos int")


def random_edges(rows: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """(src, dst): each row's successor in m hash orders of its group of about 1,000; one order's edges pass through the whole group."""
    ids = rows.select("id")
    group = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, ids.count() // 1000)))
    out = None
    for s in range(m):
        w = Window.partitionBy(group).orderBy(F.xxhash64("id", F.lit(seed + s + 1)), "id")
        step = ids.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")
        out = step if out is None else out.unionByName(step)
    return out


def vamana(rows: DataFrame, degree: int = 16, pool: int = 32, alpha: float = 1.2) -> DataFrame:
    """Pruned graph: nearest candidates, pruned, with reverse edges, pruned again; each node's last edge is a random one, so that clusters hang together."""
    near = neighbour_graph(rows, pool)
    pruned = robust_prune(near, rows, degree - 1, alpha)
    both = with_reverse(pruned.select("src", "dst", "dist"), 4 * degree)
    kept = robust_prune(both, rows, degree - 1, alpha)
    v = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    far = random_edges(rows, 1).join(v.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    every = kept.unionByName(far.select("src", "dst", l2_squared("a", "b").alias("dist"), F.lit(degree).cast("int").alias("pos")))
    return every.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("pos").alias("pos"))


def nn_descent(rows: DataFrame, k: int, rounds: int = 6, seed: int = 0, checkpoint=None) -> DataFrame:
    """Approximate k nearest neighbours: random ones, then neighbours of neighbours in both directions, kept by distance. checkpoint: a function that writes and rereads a table between rounds."""
    keep = checkpoint or (lambda df, name: df)
    edges = random_edges(rows, k, seed)
    v = rows.select("id", F.col("v").cast("array<double>").alias("v"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(v.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst").select("src", "dst", l2_squared("a", "b").alias("dist"))

    both = lambda e: e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    graph = keep(top_k(scored(both(edges)), k, "src", "dist", "dst").drop("rk"), "graph0")
    for r in range(rounds):
        wide = top_k(graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct(), 2 * k, "src", "dist", "dst").select("src", "dst")
        hop = wide.select(F.col("src").alias("m"), F.col("dst").alias("x")).join(wide.select(F.col("src").alias("m"), F.col("dst").alias("y")), "m").where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
        new = scored(hop.join(graph, ["src", "dst"], "left_anti"))
        graph = keep(top_k(graph.unionByName(new).distinct(), k, "src", "dist", "dst").drop("rk"), f"graph{r + 1}")
    return top_k(graph, k, "src", "dist", "dst").withColumnRenamed("rk", "pos")


def merged_shards(graphs: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """Adjacency (src, nbrs) of shard graphs' edges: distinct neighbours in a seeded order, cut at the degree."""
    shuffled = F.transform(F.array_sort(F.collect_set(F.struct(F.xxhash64("src", "dst", F.lit(seed)).alias("r"), "dst"))), lambda s: s["dst"])
    return graphs.groupBy("src").agg(F.slice(shuffled, 1, degree).alias("nbrs"))


def two_hop(edges: DataFrame, dead: DataFrame, most: int = 5) -> DataFrame:
    """Edges repaired after deletes: a deleted neighbour's first `most` live neighbours take its place."""
    gone = dead.select(F.col("id").alias("dst"))
    live = edges.join(gone, "dst", "left_anti").join(gone.withColumnRenamed("dst", "src"), "src", "left_anti").select("src", "dst")
    lost = edges.join(gone, "dst", "left_semi").join(gone.withColumnRenamed("dst", "src"), "src", "left_anti").select("src", F.col("dst").alias("mid"))
    beyond = top_k(edges.join(gone, "dst", "left_anti").join(gone.withColumnRenamed("dst", "src"), "src", "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("to"), "pos"), most, "mid", "pos", "to")
    return live.unionByName(lost.join(beyond, "mid").where("src <> to").select("src", F.col("to").alias("dst"))).distinct()


def beam_search(adjacency: dict[int, np.ndarray], ids: np.ndarray, x: np.ndarray, entry: int, query: np.ndarray, k: int, ef: int, allowed: set[int] | None = None) -> list[tuple[int, float]]:
    """Best-first search of one segment's graph in memory: (id, distance) of the k nearest found with a list of ef."""
    if ef < k:
        raise ValueError("ef_search must be at least the limit")
    place = {int(i): p for p, i in enumerate(ids)}
    dist = lambda i: float(((x[place[i]] - query) ** 2).sum())
    pool, seen, done = [(dist(entry), entry)], {entry}, set()
    while True:
        todo = [c for c in pool[:ef] if c[1] not in done]
        if not todo:
            break
        node = todo[0][1]
        done.add(node)
        for n in adjacency.get(node, ()):
            if int(n) not in seen and int(n) in place:
                seen.add(int(n))
                pool.append((dist(int(n)), int(n)))
        pool = sorted(pool)[: max(ef, k)]
    found = [c for c in pool if allowed is None or c[1] in allowed]
    return [(i, d) for d, i in found[:k]]


def segment_search(rows: DataFrame, edges: DataFrame, segments: DataFrame, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
    """(qid, id, dist, rk): beam search in each segment (id, segment), merged by (dist, id). A segment must fit a task."""
    got = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>")).toPandas()
    near = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("nbrs"))
    table = rows.select("id", F.col("v").cast("array<double>").alias("v")).join(segments.select("id", "segment"), "id").join(near.withColumnRenamed("src", "id"), "id", "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, x = g["id"].to_numpy(), np.array(g["v"].tolist())
        graph = {int(i): np.array(n) for i, n in zip(ids, g["nbrs"]) if n is not None}
        entry = int(ids[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()])
        out = [(int(q), i, d) for q, v in zip(got["qid"], got["qv"]) for i, d in beam_search(graph, ids, x, entry, np.array(v), k, max(ef, k))]
        return pd.DataFrame(out, columns=["qid", "id", "dist"])

    return top_k(table.groupBy("segment").applyInPandas(run, "qid long, id long, dist double"), k)


def hot_nodes(edges: DataFrame, entry: int, share: float, n: int) -> DataFrame:
    """(id, depth): nodes in breadth-first order from the entry, up to a share of all n."""
    seen = edges.sparkSession.createDataFrame([(entry, 0)], "id long, depth int")
    most, front, depth = max(1, int(share * n)), seen, 0
    while seen.count() < most:
        depth += 1
        front = front.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "id").limit(most)


def recall_at(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> float:
    from .search import recall

    return recall(found, batch_search(rows, queries, k, metric), k).first()["recall"]
