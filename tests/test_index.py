import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus import sources
from annulus.functions import codes, from_sortable_hex, sortable_double, sortable_hex
from annulus.operators import index, search


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16)) * 3
    x = centres[r.integers(0, 8, 800)] + r.normal(size=(800, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    q = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    return x, rows, q


def test_codecs(table):
    x, _, _ = table
    h = codes.hadamard(np.eye(8))
    assert np.array_equal(h @ h.T, 8 * np.eye(8)) and np.allclose(codes.hadamard(codes.hadamard(x)) / 16, x)
    rot = codes.random_rotation(16, 3)
    assert np.allclose(rot @ rot.T, np.eye(16)) and np.allclose(np.linalg.norm(codes.sign_rotation(x[:, :11]), axis=1), np.linalg.norm(x[:, :11], axis=1))
    p = codes.PCA.from_moments(len(x), x.sum(axis=0), x.T @ x, 16)
    assert np.allclose(np.cov(p.transform(x).T), np.diag(p.variance)) and np.allclose(p.inverse(p.transform(x)), x) and (p.components.sum(axis=1) >= -1e-9).all()
    pq = codes.ProductQuantizer.train(x, 4, size=32)
    c = pq.encode(x)
    assert np.allclose(pq.distances(pq.query_table(x[3]), c), ((pq.decode(c) - x[3]) ** 2).sum(axis=1)) and np.allclose(pq.symmetric(c[:5], c[5:10]), ((pq.decode(c[:5]) - pq.decode(c[5:10])) ** 2).sum(axis=1))
    m = codes.OneBit(x.mean(axis=0), rot)
    true, got = ((x - x[7]) ** 2).sum(axis=1), m.estimate(x[7], *m.encode(x))
    assert np.corrcoef(true, got)[0, 1] > 0.95
    low, high = x.min(axis=0), x.max(axis=0)
    four = np.clip(np.floor((x - low) / (high - low) * 15), 0, 15).astype(np.uint8)
    packed = four[:, ::2] << 4 | four[:, 1::2]
    assert np.array_equal(codes.unpack_nibbles(packed, 16), four)
    for metric in ("l2", "ip"):
        assert np.allclose(codes.code_distance(metric, packed, x[0], low, high, 15), codes.code_distance(metric, four, x[0], low, high, 15))
    assert codes.ceil_div(7, 2) == 4 and codes.round_up(7, 4) == 8 and codes.is_power_of_two(64) and not codes.is_power_of_two(0)


def test_cells_and_code_searches_recall(spark, table):
    x, rows, q = table
    c = index.kmeans(rows, 16, seed=2)
    cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).mean()
    assert cost < 1.3 * 16
    cells = index.cells_of(rows, c)
    assert cells.count() == 800 and index.cells_of(rows, c, 2).groupBy("id").count().where("count = 2").count() == 800
    assert index.recall_at(index.probed_search(rows, cells, c, q, 10, 6), rows, q, 10) >= 0.9
    pq = index.pq_train(rows, 8)
    assert index.recall_at(index.pq_search(rows, index.pq_encode(rows, pq), pq, q, 10, 60), rows, q, 10) >= 0.9
    m = index.one_bit_fit(rows)
    assert index.recall_at(index.one_bit_search(rows, index.one_bit_encode(rows, m), m, q, 10), rows, q, 10) >= 0.9
    p = index.pca_fit(rows, 5)
    assert np.allclose(p.mean, x.mean(axis=0)) and np.allclose(p.variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:5])
    got = {r.id: r.v for r in index.mapped(rows, p.transform).collect()}
    assert np.allclose(got[5], p.transform(x[5:6])[0])


def test_graphs(spark, table):
    x, rows, q = table
    exact = {r.src: set() for r in search.neighbour_graph(rows, 1).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")
    for r in search.neighbour_graph(rows, 5).collect():
        assert near[r.src, r.pos - 1] == r.dst and abs(r.dist - d[r.src, r.dst]) < 1e-9
        exact[r.src].add(r.dst)
    e = index.vamana(rows, 12, 24).cache()
    assert e.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    seg = rows.select("id", (F.col("id") % 2).alias("segment"))
    both = e.unionByName(search.fused(e, e).withColumn("pos", F.lit(99)))
    assert index.recall_at(index.segment_search(rows, both, rows.select("id", F.lit(0).alias("segment")), q, 10, 80), rows, q, 10) >= 0.9
    assert index.segment_search(rows, e, seg, q, 3, 60).count() == 3 * 16
    merged = index.merged_shards(e.unionByName(e), 6, 1).collect()
    assert all(len(r.nbrs) == len(set(r.nbrs)) <= 6 for r in merged)
    dead = spark.createDataFrame([(i,) for i in range(0, 800, 9)], "id long")
    fixed = index.two_hop(e, dead).collect()
    assert not {i for r in fixed for i in (r.src, r.dst)} & set(range(0, 800, 9)) and len({r.src for r in fixed}) > 700
    hot = index.hot_nodes(e, 0, 0.05, 800).collect()
    assert len(hot) == 40 and hot[0].id == 0


def test_neighbour_descent(spark, table):
    x, rows, _ = table
    few = rows.where("id < 300").cache()
    d = ((x[:300, None] - x[None, :300]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    g = index.nn_descent(few, 5, 3, checkpoint=lambda df, name: spark.createDataFrame(df.toPandas()))
    hit = sum(r.dst in near[r.src] for r in g.collect())
    assert hit / 1500 >= 0.8  # three rounds; more rounds find more


def test_occlusion_rule():
    pts = np.array([[1.0, 0], [1.1, 0], [0, 2.0], [3.0, 0]])
    d = (pts**2).sum(axis=1)
    order = np.argsort(d)
    between = ((pts[order][:, None] - pts[order][None]) ** 2).sum(axis=2)
    assert index.occluded(d[order], between, 4, 1.2) == [0, 2]  # 1.1 and 3 lie behind 1


def test_many_queries_by_blocks(spark, table, monkeypatch):
    _, rows, q = table
    want = sorted(map(tuple, search.batch_search(rows, q, 5).collect()))
    monkeypatch.setattr(search, "QUERY_LIMIT", 3)
    assert [r[:2] for r in sorted(map(tuple, search.batch_search(rows, q, 5).collect()))] == [r[:2] for r in want]


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    monkeypatch.setattr(sources, "RANGE_BYTES", 40)
    for kind in ("fvecs", "fbin"):
        assert sources.write_vectors(rows.repartition(3), str(tmp_path / kind), kind) == 20
        got = sources.read_vectors(spark, str(tmp_path / kind), kind).orderBy("path", "pos").collect()
        assert [r.v for r in got] == x.tolist()
    (tmp_path / "one.fbin").write_bytes(sources.encode(x, "fbin"))
    assert [r.v for r in sources.read_vectors(spark, str(tmp_path / "one.fbin"), "fbin", 5, 3).orderBy("pos").collect()] == x[5:8].tolist()
    (tmp_path / "cut.fbin").write_bytes(sources.encode(x, "fbin")[:-1])
    with pytest.raises(ValueError):
        sources.read_vectors(spark, str(tmp_path / "cut.fbin"), "fbin")
    a, b, t = sources.load_synthetic(spark, 50, 4, 3, seed=1, k=2)
    assert t.count() == 6 and a.first().v == sources.synthetic(spark, 50, 4, 1).first().v and b.count() == 3


def test_sortable_keys_round_trip(spark):
    n = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", sortable_hex("n").alias("k"), from_sortable_hex(sortable_hex("n")).alias("b")).collect()
    assert all(r.n == r.b for r in got) and [r.n for r in sorted(got, key=lambda r: r.k)] == sorted(n)
    f = [0.0, 1.5, -1.5, 1e300, -1e-300, 3.0, 2.9999999999999996, float("inf"), float("-inf"), 5e-324, 0.1, 1 / 3]
    got = spark.createDataFrame([(x,) for x in f], "x double").select("x", sortable_double("x").alias("k")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.k)] == sorted(f)
    bits = {r.x: r.k for r in got}
    for x in f:
        raw = int(np.float64(x).view(np.int64))
        assert bits[x] == f"{(~raw if raw < 0 else raw ^ -(2**63)) & (2**64 - 1):016x}", x
