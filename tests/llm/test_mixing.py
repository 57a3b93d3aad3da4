import random
import re

from annulus.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(size_by_source, weights=(5, 2, 1), most=3):
    names = sorted([s for s in size_by_source if s is not None]) + [s for s in size_by_source if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(size_by_source.values()), set()
    while True:
        free = [s for s in names if s not in held]
        share = sum(w[s] for s in free)
        rest = total - sum(most * size_by_source[s] for s in held)
        out = {s: (most * size_by_source[s] if s in held else rest * w[s] / share) for s in names}
        above = {s for s in free if out[s] > most * size_by_source[s]}
        if not above:
            return out
        held |= above


def check(spark, rows, weights=(5, 2, 1)):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")
    got = mixing.mix_sources(df, weights=weights).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5), weights=weights).collect()))  # reruns agree
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(size, weights)
    assert len(got) == len(rows)
    taken = dict.fromkeys(size, 0)
    biggest = dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    return {s: (taken[s], want[s], biggest[s]) for s in size}


def test_small_cases(spark):
    rows = [(1, "a b c", "x", "s", 1), (1, "a b c", "x", "s", 1), (2, None, "x", "s", 1), (None, "one", None, "s", 1), (3, "", "y", "s", 1), (4, "w " * 50, "z", None, None), (5, "é ü x y", "é", None, None)]
    for t, w, b in check(spark, rows).values():
        assert abs(t - w) <= b / 2 + 1e-6


def test_near_targets_and_unbiased(spark):
    r = random.Random(3)
    rows = [(i, "w " * (r.randint(1, 60) if r.random() < 0.998 else 3000), r.choice(["hot"] * 6 + ["a", "b", "c", "d", None]), "s", 1) for i in range(6000)]
    for t, w, b in check(spark, rows).values():
        assert abs(t - w) <= b / 2 + 1, (t, w, b)
        if b < 3000:
            assert abs(t - w) <= 30, (t, w, b)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).collect() == [] and mixing.mixed_documents(df).collect() == []


def test_documents_carry_copies(spark):
    rows = [(i % 50, f"t{i} " * (i % 7 + 1), "abc"[i % 3], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mixed_documents(df).collect()
    assert sum(r.copies * len(r.text.split()) for r in got) == sum(r.taken for r in mixing.mix_sources(df).collect())
