"""Steps that must not grow faster than their input: no pairs are sent, bounds lose nothing, and no plan is evaluated twice for numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.catalog import Client
from annulus.operators import chunkers, index, mutations, search, statistics


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)) * (1 + np.arange(600) % 7)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3).cache()
    return x, rows, rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(x, at, k):
    d = ((x[at][:, None] - x[None]) ** 2).sum(axis=2)
    return {(int(q), n + 1, int(i)) for q, row in zip(at, d) for n, i in enumerate(np.lexsort((np.arange(len(x)), row))[:k])}


def test_quantised_search_sends_no_pairs(table, monkeypatch):
    x, rows, q = table
    monkeypatch.setattr(search, "QUERY_LIMIT", 3)
    got = statistics.quantised_search(rows, q, 5, 255, 20)
    assert "Join" not in plan(got) and "Cartesian" not in plan(got)
    assert {(r.qid, r.rk, r.id) for r in got.collect()} == nearest(x, np.arange(0, 600, 20), 5)


@pytest.mark.parametrize("limit", [3, 4096])
def test_quantised_search_is_exact_where_codes_tell_nothing(spark, table, monkeypatch, limit):
    x, rows, q = table
    monkeypatch.setattr(search, "QUERY_LIMIT", limit)
    far = rows.unionByName(spark.createDataFrame([(10**6, [1e4] * 8)], "id long, v array<double>"))
    got = statistics.quantised_search(far, q, 5, 255, 20).collect()
    assert {(r.qid, r.rk, r.id) for r in got} == nearest(x, np.arange(0, 600, 20), 5)


def test_probed_search_sends_no_pairs(table, monkeypatch):
    x, rows, q = table
    monkeypatch.setattr(index, "rerank", None)
    c = index.kmeans(rows, 6, seed=1)
    cell = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    want = set()
    for at in range(0, 600, 20):
        ids = np.flatnonzero(np.isin(cell.argmin(axis=1), np.argsort(cell[at], kind="stable")[:2]))
        order = np.lexsort((ids, ((x[ids] - x[at]) ** 2).sum(axis=1)))
        want |= {(at, n + 1, int(i)) for n, i in enumerate(ids[order][:5])}
    for copies in (1, 2):
        got = index.probed_search(rows, index.cells_of(rows, c, copies), c, q, 5, 2).collect()
        assert len(got) == len({(r.qid, r.rk) for r in got}) == 150
        if copies == 1:
            assert {(r.qid, r.rk, r.id) for r in got} == want


@pytest.mark.parametrize("limit", [3, 100, 4096])
def test_cells_are_assigned_without_pairs(table, monkeypatch, limit):
    x, rows, _ = table
    monkeypatch.setattr(search, "QUERY_LIMIT", limit)
    monkeypatch.setattr(statistics, "pairs", None)
    centres = rows.where("id % 50 = 7").select(F.col("id").alias("cell"), F.col("v").alias("c"))
    at = np.arange(7, 600, 50)
    want = at[((x[:, None] - x[at][None]) ** 2).sum(axis=2).argmin(axis=1)]
    got = {r.id: r.cell for r in statistics.assign_cells(rows, centres).collect()}
    assert [got[i] for i in range(600)] == want.tolist()


def test_graph_sends_no_pairs_of_blocks(table, monkeypatch):
    x, rows, _ = table
    monkeypatch.setattr(search, "QUERY_LIMIT", 3)
    g = search.neighbour_graph(rows, 4)
    assert "Cartesian" not in plan(g) and "NestedLoop" not in plan(g)
    assert {(r.src, r.pos + 1, r.dst) for r in g.collect()} == {t for t in nearest(x, np.arange(600), 5) if t[1] > 1}
    both = search.with_reverse(g, 4)
    assert "Cartesian" not in plan(both) and both.groupBy("src").count().where("count <> 4").count() == 0


def test_a_task_keeps_k_rows_a_query(spark, table):
    _, rows, q = table
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert search.block_search(rows.coalesce(1), q, 5, "l2").count() == 30 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
def test_far_from_the_origin_and_equal_rows(metric):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(40, 4)) + 1e6, np.ones((9, 4)), np.zeros((2, 4)), [[np.nan] * 4, [1e200] * 4]])
    ids, q = np.arange(len(x))[::-1].copy(), x[:50:7]
    state = search.Nearest(np.arange(len(q)), q, 6, metric)
    for a in range(0, len(x), 17):
        state.add(ids[a : a + 17], x[a : a + 17])
    got = [(int(a), int(b)) for batch in state.found() for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    with np.errstate(over="ignore", invalid="ignore"):
        for n in range(len(q)):
            d = search.pair_distances(metric, x, np.repeat(q[n : n + 1], len(x), axis=0))
            ok = np.flatnonzero(np.isfinite(d))
            assert [b for a, b in got if a == n] == ids[ok][np.lexsort((ids[ok], d[ok]))][:6].tolist()


def test_numbers_are_whole_whatever_the_partitions(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("pos"), (F.col("id") % 3).alias("k"))
    got = mutations.numbered(rows, ["k", "pos"], str(tmp_path / "s"), "n", 1)
    assert "Window" not in plan(got)
    want = {(k, p): n for n, (k, p) in enumerate(sorted((r.k, r.pos) for r in rows.collect()), 1)}
    assert {(r.k, r.pos): r.n for r in got.collect()} == want


def test_no_row_of_a_large_insert_is_lost(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        c = Client(spark, str(tmp_path)).create_collection("a", capacity=10**6)
        c.insert(spark.range(20_000).select(F.col("id").alias("item_id"), F.sha2(F.col("id").cast("string"), 512).alias("document"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), F.col("id").alias("pos")))
        assert c.table().where("internal_id = CAST(item_id AS BIGINT)").count() == 20_000
        c.delete_by_id(c.table().where("internal_id % 2 = 0"))
        assert c.count() == 10_000 and not [n for n in c.store.names() if n.startswith("sorted")]
    finally:
        for name, value in (("adaptive.advisoryPartitionSizeInBytes", None), ("adaptive.coalescePartitions.parallelismFirst", None), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{name}", value) if value else spark.conf.unset(f"spark.sql.{name}")


def test_texts_are_cut_by_slices(spark):
    texts = [None if i % 50 == 3 else f"Apples are red. They grow. {i} stars. Planets turn. Far away." * (i % 3) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = chunkers.semantic_chunks(df, "t", 1)
    assert "MapInArrow" in plan(got)  # results leave by slices; a pandas function holds those of a whole batch
    for r in got.collect():
        assert r.chunks is None if r.t is None else " ".join(r.chunks) == " ".join(s.strip() + "." for s in r.t.split(".") if s.strip())
