import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from annulus.llm import suffix_tree_lm as L
from annulus.llm import topk_search as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_lm_base_and_gain(spark):
    r = random.Random(4)
    vocab = [f"w{k}é" for k in range(60)]
    rows = [(0, None, "x"), (1, "", "x"), (None, "w1é zz", "x")]
    for i in range(2, 500):
        w, k = [], r.randrange(60)
        for _ in range(r.randint(1, 120)):
            k = (k * 7 + r.choice([1, 2, 3])) % 60
            w.append(vocab[k] if r.random() < 0.97 else f"rare{r.randrange(10**6)}")
        rows.append((i, r.choice([" ", "\n"]).join(w).title(), "x"))
    rows += rows[10:12]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    got = L.score_documents(df).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [[*WORD.findall((t or "").translate(low)), None] for _, t, _ in rows]
    out = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter(x for t, h in zip(toks, out) if not h for x in t)
    N, V = sum(c.values()), len(c)
    want = sorted((str(i), h, len(t), sum(c[x] > 0 for x in t), N, round(sum(math.log10((c[x] + 0.5) / (N + 0.5 * (V + 1))) for x in t), 6)) for (i, *_), t, h in zip(rows, toks, out))
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > 0.8 * sum(x.base_score for x in held)  # log10: less negative by a fifth
    assert all(x.score <= 1e-9 for x in got)


def test_lm_without_training_documents_and_empty(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = L.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in got} == {(3, 0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("dim,stretch", [(8, 0.0), (16, 1.5)])
def test_topk_matches_brute_force(spark, monkeypatch, dim, stretch):
    monkeypatch.setattr(K, "BUCKET", 64)
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    r = np.random.default_rng(dim)
    x = r.normal(size=(400, dim))
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.exp(stretch * r.normal(size=400))[:, None]
    x[50:60] = x[40]  # ties
    x[100:110] = x[100] + r.normal(size=(10, dim)) * 0.01
    rows = [(int(i), [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [None] * dim, 1), (1040, [float("nan")] * dim, 1), (1060, [float("inf")] * dim, 1), (None, [1.0] * dim, 1), (1080, [1.0] * (dim + 1), 1), (1081, [2.0] * (dim + 1), 1), (1100, [0.0] * dim, 1), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted(tuple(t) for t in K.top_products(df, k=5).collect())
    ok = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    assert got == sorted(want)


def test_topk_empty_and_huge(spark):
    assert K.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [3e8, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.top_products(df).collect()] == [(0, 1, 1, 64 * 10**9 * (64 * 3 * 10**8 + 64))] or K.top_products(df).first().score == 2**63 - 1
