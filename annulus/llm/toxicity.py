"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is the logistic of
the weights of its hashed words and word beginnings; the document's is their
noisy-or, 1 - prod(1 - p).  Only document labels are known in training; the
gradient of the noisy-or tells the sentences apart, and the same weights then
locate the offending sentences.

Only texts are inputs; labels of the held-out fold are never read.  Training
takes a bounded sample of labelled documents (SAMPLE, half of each class, and
SAMPLE_BYTES of text).

Defined cases: null, empty and blank texts have no sentences and score 0; with
one class or no labels every score is 0 or the model's noisy-or of the bias;
repeated rows score alike; null ids are kept; further columns are ignored; an
empty table gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._learn import fold, labelled_sample
from ._text import BYTE_VALUE, LOWER, U64, Texts, mix, prefix, range_hash, slices, split_words

SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
SPACE = 1 << 18
BEGINNINGS = (4, 5)
EPOCHS = 60
BIAS = -8.0
NEGATIVE = 10.0  # weight of clean documents, which outnumber toxic ones outside the sample
SLICE = 1 << 18
_END = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
_TRIM = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]", np.uint8))


def instances(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (word, kind), sentence of each word, document of each sentence, byte start and end of each sentence."""
    w = split_words(t.data, t.off)
    n = len(w.start)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.int64), z, z, z, z
    low = LOWER[t.data]
    stop = np.concatenate([[0], np.cumsum(_END[t.data])])
    doc = w.doc
    # a word opens a sentence if an end mark lies between its predecessor's last byte and itself
    opens = np.ones(n, dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (stop[w.start[1:]] > stop[w.end[:-1] - 1])
    sentence = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n) - 1
    s, e = w.start.copy(), w.end.copy()
    for _ in range(3):  # up to three marks on either side
        e -= (e - s > 1) & _TRIM[low[e - 1]]
        s += (e - s > 1) & _TRIM[low[s]]
    pre = prefix(BYTE_VALUE[low])
    kinds = [mix(range_hash(pre, s, e))]
    for k in BEGINNINGS:
        kinds.append(mix(range_hash(pre, s, np.minimum(s + k, e)) + U64(k)))
    # a word counts once per sentence
    order = np.lexsort((kinds[0], sentence))
    new = np.ones(n, dtype=bool)
    new[1:] = (kinds[0][order][1:] != kinds[0][order][:-1]) | (sentence[order][1:] != sentence[order][:-1])
    order = order[new]
    ids = (np.stack(kinds, axis=1)[order] & U64(SPACE - 1)).astype(np.int64)
    sentence = sentence[order]
    return ids, sentence, doc[first], w.start[first], w.end[last]


class NoisyOr:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def sentences(self, ids: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(sentence, self.weight[ids].sum(axis=1), n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, l1: float = 1e-4) -> NoisyOr:
    """Adagrad on the noisy-or likelihood; bags: instances of chunks of documents, numbered through y."""
    model = NoisyOr(np.zeros(SPACE, dtype=np.float64), BIAS)
    if not len(y) or len(np.unique(y)) < 2:
        return model
    ids = np.concatenate([b[0] for b in bags])
    shift = np.concatenate([[0], np.cumsum([len(b[2]) for b in bags])])
    sentence = np.concatenate([b[1] + s for b, s in zip(bags, shift)]).astype(np.int32)
    doc = np.concatenate([b[2] for b in bags])
    n_s, n_d = len(doc), len(y)
    # features of a single document are left out
    flat, where = ids.ravel(), np.repeat(sentence, ids.shape[1])
    spread = np.unique(doc[where].astype(np.int64) * SPACE + flat) % SPACE
    use = (np.bincount(spread, minlength=SPACE) >= 2)[flat]
    flat, where = flat[use], where[use]
    w, seen = model.weight, np.zeros(SPACE)
    pos = max(y.sum(), 1)
    scale = np.where(y == 1, n_d / (2 * pos), NEGATIVE * n_d / (2 * max(n_d - pos, 1)))
    for _ in range(EPOCHS):
        z = np.bincount(where, w[flat], n_s) + model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = np.clip(model.documents(p, doc, n_d), 1e-6, 1 - 1e-9)
        # d log-likelihood / dz: p * (y / d - 1) of the sentence's document
        g = p * ((y / d - 1) * scale)[doc]
        step = np.bincount(flat, g[where], SPACE) / n_d - l1 * np.sign(w)
        seen += step**2
        w += step / (np.sqrt(seen) + 1e-4)
        w[np.abs(w) < 1e-3] = 0.0
    return model


def _bags(df: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, a, b in slices(batch, "doc_id", "text", SLICE):
                ids, sentence, doc, _, _ = instances(t)
                yield pa.record_batch([pa.array([a_.tobytes()], pa.binary()) for a_ in (ids.astype(np.int32), sentence.astype(np.int32), doc.astype(np.int32), np.asarray(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)).astype(np.int8))], names=["ids", "sentence", "doc", "y"])

    return df.select("doc_id", "text", "y").mapInArrow(run, "ids binary, sentence binary, doc binary, y binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, sample: int = SAMPLE) -> NoisyOr:
    """Fit on the training fold. The driver gets the hashed words of at most `sample` documents and SAMPLE_BYTES of text."""
    bags, ys, at = [], [], 0
    for r in _bags(labelled_sample(docs, labels.withColumn(label, F.col(label).cast("int")), label, parts, held, sample, SAMPLE_BYTES)).toLocalIterator():
        y = np.frombuffer(bytes(r["y"]), np.int8)
        bags.append((np.frombuffer(bytes(r["ids"]), np.int32).reshape(-1, 1 + len(BEGINNINGS)), np.frombuffer(bytes(r["sentence"]), np.int32).astype(np.int64), np.frombuffer(bytes(r["doc"]), np.int32).astype(np.int64) + at))
        ys.append(y)
        at += len(y)
    return fit(bags, np.concatenate(ys).astype(np.float64) if ys else np.zeros(0))


def score_documents(docs: DataFrame, model: NoisyOr, parts: int = 3, held: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, offending: array of (start, end, p), byte ranges of the sentences with p >= least."""
    weight = model.weight.astype(np.float32)
    bias = model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOr(weight, bias)
        for batch in batches:
            for t, a, b in slices(batch, "doc_id", "text", SLICE):
                ids, sentence, doc, s, e = instances(t)
                p = own.sentences(ids, sentence, len(doc))
                d = own.documents(p, doc, len(t))
                bad = np.flatnonzero(p >= least)
                found: list[list[dict]] = [[] for _ in range(len(t))]
                for k in bad.tolist():
                    found[doc[k]].append({"start": int(s[k] - t.off[doc[k]]), "end": int(e[k] - t.off[doc[k]]), "p": float(p[k])})
                yield pa.record_batch([t.id_column(), batch.column(2).slice(a, b - a), pa.array(d), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))], names=["doc_id", "held_out", "score", "offending"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold(id_col, parts) == held).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, offending array<struct<start:bigint,end:bigint,p:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"), "offending")
