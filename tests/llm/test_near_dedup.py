import random
import re
from itertools import combinations

import numpy as np

from annulus.llm import near_dedup as N
from annulus.llm._text import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        a, b = rows[x][0], rows[y][0]
        if a is None or b is None or not sets[x] or not sets[y]:
            continue
        if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, *_), s in zip(rows, sets)], key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"W{k}é" for k in range(400)]
    rows = [(0, None, 1), (1, "", 1), (2, " \t ", 1), (3, "One two", 1), (4, "one TWO", 1), (5, "one", 1), (None, "one two", 1)]
    for k in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([6, 12, 30, 100, 400, 3000]))]
        for c in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((100 * k + 10 + c, r.choice([" ", "\n"]).join(w), 1))
    # a chain: neighbours are near, ends are not
    w = [r.choice(vocab) for _ in range(300)]
    for k in range(12):
        rows.append((5000 + k, " ".join(w), 1))
        for x in range(k * 5, k * 5 + 5):
            w[x] = f"new{x}"
    rows += rows[20:23]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, size in ((1, 4), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
        got = sorted([tuple(x) for x in N.near_duplicates(df, size, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)
        assert got == brute(rows, size, 80)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == []


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8, 0.95):
        got = []
        for _ in range(30):
            n = 2000
            both = int(2 * n * j / (1 + j))
            pool = mix(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            r = N.registers(np.concatenate([a, b]), np.array([0, n, n + len(b)]))
            got.append(N.estimate(r[0], r[1])[0])
        assert abs(np.mean(got) - j) < 0.03


def test_components_of_a_long_path(spark, tmp_path):
    r = random.Random(1)
    ids = list(range(300))
    r.shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])) + [(1000, 1001)], "a long, b long")
    got = dict(N.components(edges, str(tmp_path), "c").collect())
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


def word_sets(n):
    words = [f"w{k}" for k in range(n)]
    one = [N.shingle_sets(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8), 1)[0] for w in words]
    return words, np.concatenate(one)


def test_equal_sketches_of_different_sets(spark):
    """a has b's sketch and one word more; c is linked with a only."""
    words, h = word_sets(1200)
    sketch = lambda k: N.registers(np.sort(h[k]), np.array([0, len(k)]))[0].tolist()
    b = list(range(1000))
    extra = next(x for x in range(1000, 1200) if sketch([*b, x]) == sketch(b))
    rows = [(1, b), (2, [*b, extra]), (3, [*b[:800], extra])]
    df = spark.createDataFrame([(i, " ".join(words[k] for k in ks)) for i, ks in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 1, 80).collect()} == {1: 1, 2: 1, 3: 1}


def test_small_sets_in_one_band(spark):
    """Five words of one band, of which four make another document."""
    words, h = word_sets(4000)
    slot = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(57)).astype(int)
    in_ = lambda k: [w for w, s in zip(words, slot) if s == k]
    four = [*in_(0)[:2], *in_(1)[:2]]
    rows = [(1, " ".join([*four, in_(2)[0]])), (2, " ".join(four)), (3, " ".join([*four[:3], in_(2)[1]]))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_few_keys_meet_for_every_linked_pair():
    r = random.Random(4)
    pool = mix(np.arange(1, 400, dtype=np.uint64))
    for _ in range(3000):
        n, m = r.randint(1, N.FEW), r.randint(1, N.FEW)
        both = r.randint(0, min(n, m))
        if 100 * both < 80 * (n + m - both):
            continue
        k = r.sample(range(len(pool)), n + m - both)
        a, b = np.sort(pool[k[:n]]), np.sort(pool[k[n - both :]])
        assert np.intersect1d(N.few_keys(a, 80), N.few_keys(b, 80)).size


def alike(count):
    """Documents of one template of 400 words, about 0.65 alike; of the first ten, two and two are linked."""
    r = random.Random(7)
    base = [f"t{k}" for k in range(400)]
    rows = []
    for i in range(count):
        w = list(base)
        for k in r.sample(range(100), 10):
            w[4 * k] = f"own{i}x{k}"
        rows.append((i, " ".join(w), 1))
    for i in range(0, 10, 2):
        rows[i + 1] = (i + 1, rows[i][1] + f" more{i}", 1)
    return rows


def test_template_sends_few_texts(spark, monkeypatch):
    """Documents alike but below the threshold must not all be compared by their texts."""
    sent, verify = [], N.verify

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(N, "verify", counted)
    rows = alike(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted([tuple(x) for x in N.near_duplicates(df, 4, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)
    assert got == brute(rows, 4, 80)
    assert sent[2] < 120  # of 7,140 pairs


def test_groups_cut_by_size_and_part(spark, monkeypatch):
    """Groups above PART are cut into cells and parts, and lose no link; so do groups compared one by one."""
    monkeypatch.setattr(N, "PART", 4)
    monkeypatch.setattr(N, "SMALL", 2)
    rows = corpus(3) + [(10000 + i, *x) for i, *x in alike(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted([tuple(x) for x in N.near_duplicates(df, 4, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)
    assert got == brute(rows, 4, 80)


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 20, 400, 5000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        for both in (0, n // 2, n * 9 // 10, n):
            a, b = pool[:n], pool[n - both : 2 * n - both]
            odd = N.parities(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            assert odd.shape == (2, N.PARITIES // 8)
            assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= 2 * (n - both)
