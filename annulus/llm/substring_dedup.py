"""Operator 10: relative Lempel-Ziv removal of passages seen in earlier documents.

The reference of a document is every document with a smaller id.  Reference
blocks are indexed by seeds (content-chosen k-grams of words, bucketed over all
blocks), each distinct passage at its first place.  A document is parsed greedily
from left to right against that index: a factor starts at the first window that
the reference has, takes that window's place and goes on as long as the next
window continues it there.  Where it ends, the windows that cross its end are
looked up by themselves, so a further factor may start inside the last words of
the one before.  Factors of at least ``window`` words are duplicate spans and
their words are removed; shorter ones are literals.  Equality is decided on the
words' bytes, or on digests of them.

A seed whose whole context lies in the reference gives all its windows at once;
otherwise each window is compared by sorted neighbours (see ``_anchored``).

Defined cases: a null or empty text has no words; a document of fewer words
than the window keeps all; rows with equal ids are no reference for each other;
a null id counts as the largest, 2**63 - 1; repeats inside one document stay
unless an earlier document has them; bytes that aren't UTF-8 show as U+FFFD in
`kept` and are kept as they are in its digest; further columns of the input are
ignored; an empty table gives no rows.  Documents of any length are treated whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _anchored as A
from ._text import Texts, exact_ids, split_words, word_hashes
from .suffix_dedup import runs

GRAM = 5
DENSITY = 0.03  # seeds a byte in prose; only sizes the buckets
_FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))


def _elements(t: Texts) -> A.Elements:
    w = split_words(t.data, t.off)
    # the words side by side, one space after each
    size = w.end - w.start + 1
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = np.append(t.data, np.uint8(32))[np.repeat(w.start - start[:-1], size) + np.arange(start[-1])]
    data[start[1:] - 1] = 32
    return A.Elements(word_hashes(t.data, w), w.off, data, start)


def _parse(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    w = split_words(data, off)
    return exact_ids(data, w, word_hashes(data, w))


def _value_of(rows: np.ndarray) -> np.ndarray:
    return rows


def factors(found: A.Found, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of found windows: starts, ends, reference ids and reference starts of the factors."""
    start, at = np.unique(found.start, return_index=True)
    ref, place = found.id[at], found.place[at]
    doc = np.searchsorted(off, start, side="right")
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return start[first], start[last] + window, ref[first], place[first]


def remove_factors(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (string: kept words joined by a space), factors (array of word ranges [start, end) with the earlier document and the word there that they copy), spans (array of [start, end) word ranges removed)."""
    spec = A.Windows(window, max(1, min(GRAM, window // 2)), True, _elements, _parse, _value_of)

    def finish(t: Texts, el: A.Elements, found: A.Found):
        off = el.off
        raw = el.data.tobytes()
        f_start, f_end, f_doc, f_at = factors(found, off, window)
        mask = np.zeros(len(el.values) + 1, dtype=np.int64)
        np.add.at(mask, f_start, 1)
        np.add.at(mask, f_end, -1)
        mask = np.cumsum(mask[:-1]) > 0
        cut = np.searchsorted(f_start, off)
        size, gone, sha, kept, copied, spans = [], [], [], [], [], []
        for i in range(len(t)):
            a, b = off[i], off[i + 1]
            m = mask[a:b]
            s, e = runs(m)
            if len(s):
                stay = np.flatnonzero(~m) + a
                k = b" ".join([raw[x : y - 1] for x, y in zip(el.start[stay].tolist(), el.start[stay + 1].tolist())])
            else:
                k = raw[el.start[a] : max(el.start[a], el.start[b] - 1)]
            size.append(int(b - a))
            gone.append(int(m.sum()))
            sha.append(hashlib.sha256(k).hexdigest())
            kept.append(k.decode("utf-8", "replace"))
            own = slice(cut[i], cut[i + 1])
            copied.append([{"start": x, "end": y, "ref_doc": d, "ref_start": r} for x, y, d, r in zip((f_start[own] - a).tolist(), (f_end[own] - a).tolist(), f_doc[own].tolist(), f_at[own].tolist())])
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
        yield pa.record_batch(
            [t.id_column(), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(copied, _FACTORS), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors", "spans"],
        )

    return A.search(spec, docs, id_col, text_col, DENSITY, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:bigint,end:bigint,ref_doc:bigint,ref_start:bigint>>, spans array<struct<start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_factors(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
