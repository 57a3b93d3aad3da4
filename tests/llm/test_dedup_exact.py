import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from annulus.llm import _anchored as A
from annulus.llm import substring_dedup, suffix_dedup
from annulus.llm._text import Texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_bytes long, kept string"  # clashing extra columns


def brute4(rows, W):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + W] for _, d in data for p in range(len(d) - W + 1))
    out = []
    for i, d in data:
        m = np.zeros(len(d), bool)
        for p in range(len(d) - W + 1):
            if seen[d[p : p + W]] > 1:
                m[p : p + W] = True
        kept = bytes(b for b, x in zip(d, m) if not x)
        spans = int(np.diff(np.concatenate([[0], m.astype(int)])).clip(0).sum())
        out.append((i, len(d), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute10(rows, W):
    data = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    least = {}
    big = 2**63 - 1
    for i, w in data:
        for p in range(len(w) - W + 1):
            k = tuple(w[p : p + W])
            least[k] = min(least.get(k, big), big if i is None else i)
    out = []
    for i, w in data:
        m = [False] * len(w)
        for p in range(len(w) - W + 1):
            if least[tuple(w[p : p + W])] < (big if i is None else i):
                m[p : p + W] = [True] * W
        kept = b" ".join(x for x, y in zip(w, m) if not y)
        out.append((i, len(w), sum(m), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé ") for _ in range(r.randint(1, 5))).strip() or "x" for _ in range(25)]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (None, passages[0]), (5, "same same same " * 40), (6, "aaaa" * 100), (7, "same same same " * 40)]
    for i in range(10, 10 + n):
        parts = [r.choice(passages)[r.randint(0, 20) :] if r.random() < 0.5 else " ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) for _ in range(r.randint(1, 5))]
        rows.append((i, r.choice([" ", "\n", ""]).join(parts)))
    rows += rows[-4:] + [(1000 + i, t) for i, t in rows[12:20]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,W", [(1, 40), (2, 200), (3, 20)])
def test_suffix_dedup(spark, seed, W):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(df, W).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute4(rows, W)


@pytest.mark.parametrize("seed,W", [(1, 13), (4, 6)])
def test_substring_dedup(spark, seed, W):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in substring_dedup.remove_factors(df, W).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute10(rows, W)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(df).collect() == [] and substring_dedup.remove_factors(df).collect() == []


def test_many_blocks_and_buckets(spark, monkeypatch):
    from annulus.llm import _blocks as B

    monkeypatch.setattr(B, "BLOCK_BYTES", 500)
    monkeypatch.setattr(A, "BUCKET_ROWS", 50)
    monkeypatch.setattr(A, "BOUNDARY_BYTES", 2000)
    rows = corpus(9, 80)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(df, 60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute4(rows, 60)
    got = [tuple(r) for r in substring_dedup.remove_factors(df, 8).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute10(rows, 8)


def test_suffix_sort_orders_and_verifies():
    r = np.random.default_rng(0)
    rows = r.integers(0, 2, (300, 12)).astype(np.uint8)
    size = r.integers(0, 13, 300)
    rows[np.arange(12)[None, :] >= size[:, None]] = 0
    group = np.sort(r.integers(0, 4, 300))
    from annulus.llm._text import BYTE_VALUE

    order, lcp = A.suffix_sort(rows, size, BYTE_VALUE[rows], group)
    want, want_lcp = A._exact_sort(rows, size, group)
    key = lambda k: (group[k], rows[k, : size[k]].tolist())
    assert [key(k) for k in order] == [key(k) for k in want] and (lcp == want_lcp).all()
    # a useless hash must not change the result
    order, lcp = A.suffix_sort(rows, size, np.zeros_like(rows, dtype=np.uint64), group)
    assert [key(k) for k in order] == [key(k) for k in want] and (lcp == want_lcp).all()


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_words_and_strings_that_fool_a_polynomial_hash(spark):
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}"), (2**63 - 1, f"{y} {tail} end"), (None, f"{y} {tail} end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.remove_factors(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute10(rows, 13) and {r[0]: r[2] for r in got}[2] == 0
    long = [(k, thue_morse(4096, *("ab" if k % 2 else "ba"))[k * 7 : k * 7 + 900]) for k in range(6)]
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(long, "doc_id long, text string"), 256).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute4(long, 256)


def test_hot_grams_are_split(spark, monkeypatch):
    from annulus.llm import _blocks as B

    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(A, "HOT", 5)
    monkeypatch.setattr(A, "BUCKET_ROWS", 300)
    r = random.Random(5)
    shared = " ".join(f"p{k}" for k in range(30))
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    rows = [(k, " ".join(word() for _ in range(r.randint(0, 9))) + " " + " ".join(shared.split()[r.randint(0, 3) : r.randint(20, 30)]) + " " + " ".join(word() for _ in range(r.randint(0, 9)))) for k in range(120)]
    rows += rows[:6] + corpus(3, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in suffix_dedup.remove_repeats(df, 60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute4(rows, 60)
    got = [tuple(x) for x in substring_dedup.remove_factors(df, 13).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute10(rows, 13)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_factors_are_a_greedy_parse_of_earlier_documents(spark, monkeypatch, block):
    from annulus.llm import _blocks as B

    monkeypatch.setattr(B, "BLOCK_BYTES", block)
    rows = [(i, t) for i, t in {i: t for i, t in corpus(11, 80)}.items() if i is not None]
    words = {i: WORD.findall((t or "").encode()) for i, t in rows}
    W, first = 8, {}
    for i in sorted(words):
        for p in range(len(words[i]) - W + 1):
            first.setdefault(tuple(words[i][p : p + W]), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    copied = 0
    for r in substring_dedup.remove_factors(df, W).collect():
        w, hit = words[r.doc_id], [False] * len(words[r.doc_id])
        for p in range(len(w) - W + 1):
            if first[tuple(w[p : p + W])] < r.doc_id:
                hit[p] = True
        seen = [False] * len(w)
        for f, after in zip(r.factors, [*r.factors[1:], None]):
            assert f.ref_doc < r.doc_id and f.end - f.start >= W
            assert words[f.ref_doc][f.ref_start : f.ref_start + f.end - f.start] == w[f.start : f.end]  # a copy
            for p in range(f.start, f.end - W + 1):
                assert not seen[p]
                seen[p] = True
            # greedy: it ends where its place ends, or where the index has another place for the next window
            if f.end < len(w) and hit[f.end - W + 1]:
                assert after.start == f.end - W + 1 and (after.ref_doc, after.ref_start) != (f.ref_doc, f.ref_start + f.end - W + 1 - f.start)
            copied += 1
        assert seen == hit  # every window of the reference lies in one factor
    assert copied > 50


@pytest.mark.parametrize("m,window,gram", [(suffix_dedup, 30, 7), (substring_dedup, 13, 5)])
def test_anchors_are_chosen_once_a_block(monkeypatch, m, window, gram):
    spec = A.Windows(window, gram, m is substring_dedup, m._elements, m._parse, m._value_of)
    r = random.Random(9)
    data = [" ".join(f"w{r.randrange(9)}" for _ in range(n)).encode() for n in (0, 3, 40, 300, 90)]
    t = Texts(np.arange(5), np.zeros(5, dtype=bool), np.cumsum([0] + [len(x) for x in data]), np.frombuffer(b"".join(data), np.uint8))
    _, want = A.find_anchors(spec, t)
    payload = A.pack_anchored(spec)(t)
    monkeypatch.setattr(A, "choose_anchors", None)  # the steps that follow read them
    _, got = A.find_anchors(spec, *A.read_anchored(payload))
    assert len(want.at) > 10 and all(np.array_equal(getattr(want, k), getattr(got, k)) for k in vars(want))


@pytest.mark.parametrize("m", [suffix_dedup, substring_dedup])
def test_marking_costs_a_block_no_more_with_more_buckets(spark, monkeypatch, m):
    """A block's length is walked as often for one reply as for many, and for one hot anchor as for many."""
    from annulus.llm import _blocks as B

    spec = A.Windows(13, 5, m is substring_dedup, m._elements, m._parse, m._value_of)
    r = random.Random(4)
    passages = [" ".join(f"w{r.randrange(30)}" for _ in range(40)) for _ in range(12)]
    data = [f"{r.choice(passages)[r.randint(0, 9):]} u{k} {r.choice(passages)}".encode() for k in range(80)]
    halves = [Texts(np.arange(40) + 40 * k, np.zeros(40, dtype=bool), np.cumsum([0] + [len(x) for x in data[40 * k : 40 * k + 40]]), np.frombuffer(b"".join(data[40 * k : 40 * k + 40]), np.uint8)) for k in range(2)]
    payloads = [A.pack_anchored(spec)(t) for t in halves]

    def reduced(rows, fn):
        by = defaultdict(list)
        for key, block, kind, p in rows:
            by[key].append((block, kind, p))
        return [x for key in sorted(by) for x in fn(key, sorted(by[key], key=lambda x: x[:2]))]

    def marks(n_second, hot):
        monkeypatch.setattr(A, "HOT", hot)
        known = [x for x in reduced([x for k in range(2) for x in A.send_representatives(spec, 3)(k, payloads[k])], A.classify(spec)) if x[2] == 0]
        mine = [[(t, k, p) for k, block, t, p in known if block == b] for b in range(2)]
        near = [x for k in range(2) for batch in A.send_boundaries(spec, 3, n_second, n_second)(k, payloads[k], mine[k]) for x in zip(*(c.to_pylist() for c in batch.columns))]
        decided = reduced(near, A.decide(spec, n_second))
        got = [sorted(mine[b] + [(t, k, p) for k, block, t, p in decided if block == b], key=lambda x: x[:2]) for b in range(2)]
        assert len(got[1]) > n_second
        walks, bincount = [], np.bincount
        monkeypatch.setattr(np, "bincount", lambda *x, **y: walks.append(1) or bincount(*x, **y))
        found = [A.covered(spec, halves[b], 3, n_second, got[b], A.read_anchored(payloads[b])[1])[1] for b in range(2)]
        monkeypatch.setattr(np, "bincount", bincount)
        return len(walks), [f.mask.tolist() for f in found]

    (one, mask), (many, same) = marks(1, A.HOT), marks(20, A.HOT)
    assert sum(map(sum, mask)) > 100 and mask == same and one == many
    (one, mask), (many, also) = marks(1, 4), marks(20, 4)
    assert mask == same == also and one == many <= 20
