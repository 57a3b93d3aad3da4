"""Operator 1: quality by a generalised additive model with pairwise interactions.

Per-document features come from the whole text (vectorised over bytes and
words).  Training boosts shallow trees in cycles: each round visits every
feature with a small tree of at most LEAVES bins fitted to the logistic
gradient, so every feature ends as one lookup table over its bins.  Then pairs
of features are ranked by how much a joint grid reduces the residual, and the
best are boosted in cycles by trees of two levels, a cut of one feature and a
cut of the other on either side, into two-dimensional tables.  A score is the
logistic of a sum of table entries: bins and additions, no trees.

Only texts are inputs; labels of the held-out fold are never read.  Training
takes a bounded sample of labelled rows (SAMPLE, half of each class); the
intercept is corrected to the label rate of the whole training fold.

Defined cases: null, empty and blank texts are scored by the same tables (all
features 0); with one class or no labels the score is that rate (0.5 without
any); repeated rows score alike; null ids are kept (never labelled); further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._learn import fold, labelled_sample
from ._text import LOWER, slices, split_words, word_hashes

SAMPLE = 16_000
BINS, LEAVES, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 4, 60, 30, 6, 0.15
SLICE = 1 << 18

FEATURES = ("log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "non_ascii", "space", "lines", "distinct_words", "top_run", "repeats_next", "ends_symbol", "sentences", "commas", "bare_symbols", "capitals", "vowels")
_byte = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.float32)
_CLASSES = np.stack([
    _byte(bytes(range(65, 91))), _byte(b"0123456789"), _byte(b".,;:!?'\"()-"), _byte(b"#$%&*+/<=>@[]^_`{|}~\\"),
    (np.arange(256) >= 128).astype(np.float32), _byte(b" \t\n\r\x0b\x0c"), _byte(b"\n"), _byte(b".!?"), _byte(b","), _byte(b"aeiouAEIOU"),
]).astype(np.uint8)
_TAIL = _byte(b"#$%&*+/<=>@[]^_`{|}~\\!").astype(bool)
_WORDY = ~(_byte(b"#$%&*+/<=>@[]^_`{|}~\\!.,;:?'\"()-").astype(bool))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (c[off[1:]] - c[off[:-1]]).astype(np.float64)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix (document, feature)."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    w = split_words(data, off)
    words = np.diff(w.off).astype(np.float64)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    upper, digit, punct, symbol, wide, space, line, stop, comma, vowel = (_sums(c[data], off) for c in _CLASSES)
    length = w.end - w.start
    h = word_hashes(LOWER[data], w)
    doc = w.doc
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, ds[starts], count)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[w.end - 1] if len(h) else data[:0]
    first = data[w.start] if len(h) else data[:0]
    ink = np.concatenate([[0], np.cumsum(_WORDY[data])])
    bare = ink[w.end] == ink[w.start]
    cols = [
        np.log1p(size), np.log1p(words), length_mean(length, w.off, words), _sums(length > 12, w.off) * per_word, _sums(length <= 2, w.off) * per_word,
        upper * per_byte, digit * per_byte, punct * per_byte, symbol * per_byte, wide * per_byte, space * per_byte, line * per_word,
        np.bincount(ds[starts], minlength=n) * per_word, top * per_word, _sums(again, w.off) * per_word, _sums(_TAIL[last], w.off) * per_word,
        stop * per_word, comma * per_word, _sums(bare, w.off) * per_word, _sums((first >= 65) & (first <= 90), w.off) * per_word, vowel * per_byte,
    ]
    return np.stack(cols, axis=1)


def length_mean(length: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _sums(length, off) / np.maximum(words, 1)


class AdditiveModel:
    """intercept + sum of one-dimensional tables + sum of pair tables, over quantile bins."""

    def __init__(self, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], intercept: float):
        self.edges, self.tables, self.pairs, self.intercept = edges, tables, pairs, intercept

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[b[:, i] // 4, b[:, j] // 4]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Newton step by bin of the best shallow tree over ordered bins (greedy splits)."""
    cuts = [(0, len(grad))]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for c, (a, b) in enumerate(cuts):
            for m in range(a + 1, b):
                if (d := gain(a, m) + gain(m, b) - gain(a, b)) > best[0]:
                    best = (d, c, m)
        if best[1] is None:
            break
        a, b = cuts.pop(best[1])
        cuts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in cuts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Newton step by cell of the best tree of two levels over a grid: one cut along an axis, then one of the other axis on each side."""

    def halves(g: np.ndarray, h: np.ndarray):
        """Best cut of each row: its gain and place (0: none)."""
        cg, ch = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
        all_g, all_h = cg[:, -1:], ch[:, -1:]
        low, high = np.zeros_like(cg), np.zeros_like(cg)
        low[:, 1:], high[:, 1:] = cg[:, :-1], ch[:, :-1]
        gain = low**2 / (high + 5.0) + (all_g - low) ** 2 / (all_h - high + 5.0)
        at = gain.argmax(axis=1)
        return gain[np.arange(len(at)), at], at

    best = (-1.0, None)
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        top_g, top_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
        up, up_at = halves(top_g, top_h)
        down, down_at = halves(g.sum(axis=0) - top_g, h.sum(axis=0) - top_h)
        m = int((up + down)[:-1].argmax())
        if (up + down)[m] > best[0]:
            out = np.zeros_like(g)
            for rows, c in ((slice(0, m + 1), up_at[m]), (slice(m + 1, None), down_at[m])):
                for cols in (slice(0, c), slice(c, None)):
                    out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 5.0)
            best = ((up + down)[m], out if axis == 0 else out.T)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> AdditiveModel:
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(d)]
    rate = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def step():
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = step()
            size = len(edges[k]) + 1
            t = RATE * _tree(np.bincount(b[:, k], g, size), np.bincount(b[:, k], h, size), LEAVES)
            model.tables[k] += t
            z += t[b[:, k]]
    g, h = step()
    side = BINS // 4 + 1
    cell = lambda i, j: (b[:, i] // 4) * side + b[:, j] // 4
    gain = []
    for i in range(d):
        for j in range(i):
            c = cell(i, j)
            gg, hh = np.bincount(c, g, side * side), np.bincount(c, h, side * side)
            gain.append(((gg**2 / (hh + 5.0)).sum(), i, j))
    chosen = sorted(gain, reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((side, side))) for _, i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = step()
            c = cell(i, j)
            s = RATE * _pair_tree(np.bincount(c, g, side * side).reshape(side, side), np.bincount(c, h, side * side).reshape(side, side))
            t += s
            z += s.ravel()[c]
    return model


def _feature_rows(df: DataFrame, extra: str) -> DataFrame:
    """(features array, extra) of (doc_id, text, extra)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, a, b in slices(batch, "doc_id", "text", SLICE):
                yield pa.record_batch([pa.array(list(features(t.data, t.off)), pa.list_(pa.float64())), batch.column(2).slice(a, b - a)], names=["x", "y"])

    return df.select("doc_id", "text", extra).mapInArrow(run, "x array<double>, y int")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on the training fold. The driver gets at most `sample` rows of 21 numbers."""
    rows = _feature_rows(labelled_sample(docs, labels.withColumn(label, F.col(label).cast("int")), label, parts, held, sample), "y").toPandas()
    rate = labels.where(F.col(label).isNotNull() & (fold("doc_id", parts) != held)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    if not len(rows):
        return AdditiveModel([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], 0.0 if rate is None else float(np.log(np.clip(rate, 1e-4, 1 - 1e-4) / (1 - np.clip(rate, 1e-4, 1 - 1e-4)))))
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=np.float64)
    share = y.mean()
    weight = np.where(y == 1, rate / max(share, 1e-9), (1 - rate) / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(y))
    return fit(x, y, weight)


def score_documents(docs: DataFrame, model: AdditiveModel, parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, a, b in slices(batch, "doc_id", "text", SLICE):
                yield pa.record_batch([t.id_column(), batch.column(2).slice(a, b - a), pa.array(model.score(features(t.data, t.off)))], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold(id_col, parts) == held).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.7) -> DataFrame:
    """The rows, all columns, whose text scores at least `least`."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, a, b in slices(batch, "doc_id", "text", SLICE):
                good = model.score(features(t.data, t.off)) >= least
                yield pa.RecordBatch.from_arrays(batch.slice(a, b - a).filter(pa.array(good)).columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, train(docs, labels))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
