"""Searches over their whole query set (ids divisible by 50) against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from annulus.queries import QUERIES, flagship

D = "/root/testdata/sf0.1"  # 2,000 vectors, 40 queries
ALL = {
    "hybrid_eq": lambda i, g: g == 3,
    "hybrid_in": lambda i, g: np.isin(g, [1, 4, 7]),
    "hybrid_range": lambda i, g: (g > 2) & (g <= 6),
    "hybrid_or": lambda i, g: (g == 1) | (g == 2) | (g >= 8),
    "hybrid_residual": lambda i, g: np.isin(g, [1, 2]) & (i > 100),
}


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{D}/embeddings.parquet")
    i, g = t["vec_id"].to_numpy(), t["label"].to_numpy()
    return i, g, np.array(t["embedding"].to_pylist(), dtype=np.float64) * (1 + i % 7)[:, None]


def nearest(table, k=10, metric="l2", keep=None):
    i, g, v = table
    use = np.ones(len(i), bool) if keep is None else keep(i, g)
    out = {}
    for q in np.flatnonzero(i % 50 == 0):
        x, y = v[use], v[q]
        dist = {"l2": lambda: ((x - y) ** 2).sum(axis=1), "ip": lambda: -(x @ y), "cos": lambda: -(x @ y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y)}[metric]()
        first = np.lexsort((i[use], dist.round(9)))[:k]
        out.update({(int(i[q]), n): (int(i[use][j]), dist[j]) for n, j in enumerate(first.tolist(), 1)})
    return out


def same(rows, want):
    got = {(r.qid, r.rk): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for at, (i, dist) in want.items():
        assert got[at].id == i and ("dist" not in got[at] or abs(got[at].dist - dist) < 2e-6)


@pytest.mark.parametrize("name", ["knn_l2", "knn_ip", "knn_cos", "sq8_knn_rerank", *ALL])
def test_all_queries(spark, table, name):
    rows = QUERIES[f"{name}_all_queries"](spark, D).collect()
    same(rows, nearest(table, 10, name[4:] if name in ("knn_ip", "knn_cos") else "l2", ALL.get(name)))
    assert len({r.qid for r in rows}) == 40


def test_payload_recall_and_flagship(spark, table):
    rows = QUERIES["knn_payload_all_queries"](spark, D).collect()
    same(rows, nearest(table, 5))
    label = dict(zip(table[0].tolist(), table[1].tolist()))
    assert all(r.label == label[r.id] for r in rows)
    assert QUERIES["cells_probed_recall_all_queries"](spark, D).first()["enough"]
    same(flagship(spark, D).collect(), nearest(table, 10, "l2", ALL["hybrid_in"]))
