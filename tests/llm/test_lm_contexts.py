"""Suffix-tree scores against a tree of dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from annulus.llm import _blocks as B
from annulus.llm import suffix_tree_lm as L


def brute(rows, divergence, hot):
    toks = [[*t.split(), None] for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    c = Counter(x for t, u in zip(toks, train) if u for x in t)
    D = sum(c.values()) + 0.5 * (len(c) + 1)
    fine = lambda p: round(-math.log(p) * L.FINE)
    code = [[fine((c[x] + 0.5) / D) for x in t] for t in toks]
    root = [[(c[x] + 0.5) / D for x in t] for t in toks]
    first = [list(x) for x in code]
    length, kept, shorter = 1, {}, lambda ctx, x: c[x]
    while True:
        pull, found = L.PULL / length**2, 0
        nexts, q = defaultdict(Counter), {}
        for t, u, k in zip(toks, train, code):
            for i in range(length, len(t)):
                if u:
                    nexts[tuple(t[i - length : i])][t[i]] += 1
                q[tuple(t[i - length : i]), t[i]] = math.exp(-((k[i] + L.SENT // 2) // L.SENT) * L.SENT / L.FINE)
        loose = {}
        for ctx, n in nexts.items():
            N = sum(n.values())
            counted = {x: k for x, k in n.items() if shorter(ctx, x) >= 2}
            loose[ctx] = s = N - sum(counted.values())
            gain = sum(k * math.log((k - 1 + (pull + s) * q[ctx, x]) / ((N - 1 + pull) * q[ctx, x])) for x, k in counted.items())
            gain += s * math.log((pull + max(s, 1) - 1) / (N - 1 + pull))
            if length <= 2 and N >= hot:
                kept[ctx], loose[ctx] = True, 0
            else:
                kept[ctx] = N >= L.LEAST and gain >= divergence * N
        for t, k in zip(toks, code):
            for i in range(len(t) - 1, length - 1, -1):
                ctx = tuple(t[i - length : i])
                if kept.get(ctx):
                    n = nexts[ctx][t[i]] if shorter(ctx, t[i]) >= 2 else 0
                    k[i] = fine((n + (pull + loose[ctx]) * math.exp(-k[i] / L.FINE)) / (sum(nexts[ctx].values()) + pull))
                    found += 1
        shorter = lambda ctx, x, m=nexts, d=length: m[ctx[-d:]][x] if ctx[-d:] in m else 0
        length *= 2
        if not found:
            break
    score = {i: sum(math.log10(p) + (a - b) / L.FINE / math.log(10) for p, a, b in zip(r, f, k)) for (i, _), r, f, k in zip(rows, root, first, code)}
    return score, kept, length


@pytest.mark.parametrize("hot", [1 << 20, 60])
def test_scores_match_a_tree_of_all_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(L, "BUCKET", 500)
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L, "DIVERGENCE", 0.3)  # so that some suffixes fail the test
    r = random.Random(3)
    rows = []
    passage = " ".join(f"w{r.randrange(300)}" for _ in range(70))
    for i in range(300):
        w = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(0, 60))]
        if i % 12 == 0:  # a phrase of rare words, far below any share of a large corpus
            w[3:3] = ["p1", "w1", "w1", "w1", "p2"]
        elif i % 12 == 1:
            w[3:3] = ["q1", "w1", "w1", "w1", "q2"]
        elif i % 60 == 2:
            w[5:5] = passage.split()
        rows.append((i, " ".join(w)))
    want, kept, length = brute(rows, 0.3, hot)
    got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept[("p1", "w1", "w1", "w1")] and kept[("q1", "w1", "w1", "w1")]  # a dependency of four words
    assert any(k and not kept[x[len(x) // 2 :]] for x, k in kept.items() if len(x) > 1)  # kept, though its suffix isn't
    assert length >= 16 and max(len(x) for x, k in kept.items() if k) >= 4  # as deep as the data ask for
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_words_that_fool_a_polynomial_hash(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(i, a) for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1] + [(100, b)]
    got = {r.doc_id: r.n_known for r in L.score_documents(spark.createDataFrame(rows[:-1] + [(i, b) for i in range(20, 40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")).collect()}
    assert all(n == (2 if i < 20 else 1) for i, n in got.items()) and len(got) > len(rows) - 1


def test_buckets_follow_what_is_left(spark, monkeypatch):
    """Blocks send to a full number of buckets only while their positions fill them; scores don't depend on it."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(L, "BUCKET", 30)
    r = random.Random(5)
    same = " ".join(f"c{r.randrange(200)}" for _ in range(40))
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(60)) + (f" {same}" if i < 8 else "")) for i in range(60)]
    asked, send = [], L._send_level
    monkeypatch.setattr(L, "_send_level", lambda length, n, D: asked.append((length, n)) or send(length, n, D))
    got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    want, _, _ = brute(rows, L.DIVERGENCE, L.HOT)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert asked[0][1] > 4 * L.FEWEST and asked[-1][0] >= 8 and asked[-1][1] <= L.FEWEST


def test_frequent_contexts_are_judged_like_others(spark, monkeypatch):
    """Scores don't change with the count from which a context's pairs are spread; a frequent context that tells nothing isn't kept."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(L, "BUCKET", 500)
    monkeypatch.setattr(L, "DIVERGENCE", 0.3)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["a", "a", "x y", "x z", f"w{r.randrange(60)}", f"once{i}"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    want, kept, _ = brute(rows, 0.3, L.HOT)
    assert not kept["a",] and kept["x",] and sum(t.split().count("a") for _, t in rows) > 1000
    for wide in (40, 1 << 20):
        monkeypatch.setattr(L, "WIDE", wide)
        got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert L.HOT > 1 << 60


def test_late_lengths_use_fewer_tasks_and_blocks_hold_more(spark, monkeypatch):
    """The state's files follow what is left, and blocks send few messages; scores don't depend on either."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 400)
    r = random.Random(7)
    same = " ".join(f"c{r.randrange(200)}" for _ in range(40))
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.9)) % 400}" for _ in range(90)) + (f" {same}" if i < 8 else "")) for i in range(500)]
    asked, write = [], B.bucketed
    monkeypatch.setattr(B, "bucketed", lambda df, path, name, n: asked.append((name, n)) or write(df, path, name, n))
    got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    want, _, _ = brute(rows, L.DIVERGENCE, L.HOT)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    n = [n for _, n in asked]
    assert n[0] == n[1] == n[2] < sum(len(t) for _, t in rows) / 400 / 4 / 2 and 12 <= n[-1] <= n[0] // 2
    assert B.halving_parts(6) == 6 and [B.halving_parts(k) for k in (400, 4000)] == [104, 1024] and all(B.halving_parts(k) >= B.parts(k) for k in range(1, 3000))


def test_messages_hold_counts_of_any_size():
    import numpy as np

    for most in (0, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**62):
        x = np.array([0, most, most // 3], dtype=np.int64)
        y = B.unpack(B.pack(B.narrow(x), B.narrow(x[:0])))
        assert y[0].tolist() == x.tolist() and len(y[1]) == 0 and y[0].itemsize <= 8


def test_wide_contexts_are_summed_in_one_pass_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(L, "WIDE", 40)
    rows = [(i, "a b a c " * (5 + i)) for i in range(30)]
    calls, sums, run = [], L._sums, L._send_loose
    monkeypatch.setattr(L, "_sums", lambda told, *kinds: calls.append(kinds) or sums(told, *kinds))
    got = {x.doc_id: x.score for x in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _, _ = brute(rows, L.DIVERGENCE, L.HOT)
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert calls[:2] == [(-3, -4), (-3,)]  # the blocks are read once for both sums of a length
    docs = [(i, t.encode()) for i, t in rows]
    import numpy as np

    t = L.Texts(np.arange(30), np.zeros(30, dtype=bool), np.cumsum([0] + [len(x) for _, x in docs]), np.frombuffer(b"".join(x for _, x in docs), np.uint8))
    *rest, own, inverse = B.unpack(L.pack_tokens(5, 1)(t))
    total = np.bincount(B.from_planes(inverse, 4).astype(np.int64))
    payload = L.Tokens(*rest, np.zeros(30), np.zeros(30, dtype=np.int64), np.arange(len(own), dtype=np.uint64), total, B.from_planes(inverse, 4)).pack()
    monkeypatch.setattr(L, "_distinct", None)
    assert list(run(1, 1000.0)(0, payload))
