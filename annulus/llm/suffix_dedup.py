"""Operator 4: exact substring removal by a hash-compared suffix sort.

Every byte that a string of ``window`` bytes covers is removed if that string
also starts anywhere else, in the same document or another; strings are judged
on the input.  Suffixes that start at content-chosen anchors are sorted by
merge sort; prefix polynomial hashes and binary search find common extensions,
which are verified on the bytes; whole contexts of equal text are joined by a
digest of their bytes before they would be sorted (see ``_anchored``).

Defined cases: a null text is empty; an empty text, or one shorter than the
window, keeps all its bytes; a repeated row counts as another place, so texts
of at least ``window`` bytes that occur twice are removed whole; a null id is
kept and returned as null; further columns of the input are ignored; an empty
table gives no rows.  Documents of any length are treated whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _anchored as A
from ._text import BYTE_VALUE, Texts

GRAM = 50
DENSITY = 0.016  # anchors a byte in prose; only sizes the buckets


def _elements(t: Texts) -> A.Elements:
    return A.Elements(BYTE_VALUE[t.data], t.off, t.data)


def _parse(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return data


def _value_of(rows: np.ndarray) -> np.ndarray:
    return BYTE_VALUE[rows]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that stay), spans (array of [start, end) byte ranges removed)."""
    spec = A.Windows(window, max(1, min(GRAM, window // 4)), False, _elements, _parse, _value_of)

    def finish(t: Texts, el: A.Elements, found: A.Found):
        data, off, mask = t.data, t.off, found.mask
        size, gone, count, sha, kept, spans = [], [], [], [], [], []
        for i in range(len(t)):
            a, b = off[i], off[i + 1]
            m = mask[a:b]
            s, e = runs(m)
            k = data[a:b][~m].tobytes() if len(s) else data[a:b].tobytes()
            size.append(int(b - a))
            gone.append(int(m.sum()))
            count.append(len(s))
            sha.append(hashlib.sha256(k).hexdigest())
            kept.append(k)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
        yield pa.record_batch(
            [t.id_column(), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )

    return A.search(spec, docs, id_col, text_col, DENSITY, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
