"""Vectorised text primitives over whole Arrow columns.

A batch of texts is one UTF-8 byte array with document offsets.  Words are the
runs of bytes outside ``0x20, 0x09-0x0D`` and never cross documents.

Words are hashed eight bytes a step through a bijective mixer (above LONG bytes
by blake2b), so no family of words is known to collide; `exact_ids` tells on the
bytes whether equal hashes are equal words.  Ranges of words or bytes are hashed
by prefix polynomials modulo 2**64, one subtraction and one multiplication a
range; what they decide is verified on the elements or on a digest of the bytes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
NO_ID = np.int64(2**63 - 1)  # the order of a null id; the mask `null` tells it from the id of that value
LONG = 64  # bytes of a word above which it is hashed by blake2b

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = np.array(h, dtype=U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)) | U64(1)
_MULT = 0xD6E8FEB86659FD93
_INV = pow(_MULT, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial of the values, of length len(values) + 1."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of ranges; independent of the place."""
    inv = powers(len(pre))[1]
    return (pre[end] - pre[start]) * inv[start]


class Texts(NamedTuple):
    """Documents side by side: ids (NO_ID where null), which ids are null, byte offsets, bytes."""

    ids: np.ndarray
    null: np.ndarray
    off: np.ndarray
    data: np.ndarray

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, type=pa.int64(), mask=self.null)

    def __len__(self) -> int:
        return len(self.ids)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray  # word offsets of documents

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(len(col) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(len(col) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], raw


def ids_of(col: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(col.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False), dtype=np.int64)


def slices(batch: pa.RecordBatch, id_col: str, text_col: str, limit: int):
    """Texts of at most limit bytes (or one longer document) that cover the batch, with their row range."""
    off, data = column_bytes(batch.column(batch.schema.get_field_index(text_col)))
    column = batch.column(batch.schema.get_field_index(id_col))
    ids, null = ids_of(column), column.is_null().to_numpy(zero_copy_only=False)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield Texts(ids[a:b], null[a:b], off[a : b + 1] - off[a], data[off[a] : off[b]]), a, b
        a = b


def split_words(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return Words(z, z, np.zeros(len(off), dtype=np.int64))
    ink = ~WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~ink[:-1]
    before |= edge[:n]
    start = np.flatnonzero(ink & before)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~ink[1:]
    after |= edge[1:]
    end = np.flatnonzero(ink & after) + 1
    return Words(start, end, np.searchsorted(start, off))


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)  # masks of the first k bytes of eight


def range_bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; ranges of one length up to 8 never collide."""
    size = end - start
    h = mix(size.astype(U64) * U64(0xA24BAED4963EE407) + U64(0x9E3779B97F4A7C15))
    if not len(size):
        return h
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while live.size:
        left = size[live] - at
        v = np.ascontiguousarray(eights[start[live] + at]).view("<u8")[:, 0] & _FIRST[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ v) + U64(0x9FB21C651E98DF25))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return range_bytes_hash(data, words.start, words.end)


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], for arrays of ranges."""
    out = np.ones(len(a), dtype=bool)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, dtype=np.uint8)]), 8)
    live, at = np.flatnonzero((a != b) & (size > 0) & (size <= LONG)), 0
    while live.size:
        left = size[live] - at
        x = (np.ascontiguousarray(eights[a[live] + at]).view("<u8")[:, 0] ^ np.ascontiguousarray(eights[b[live] + at]).view("<u8")[:, 0]) & _FIRST[np.minimum(left, 8)]
        out[live[x != 0]] = False
        live, at = live[(left > 8) & (x == 0)], at + 8
    for i in np.flatnonzero((a != b) & (size > LONG)).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


def exact_ids(data: np.ndarray, words: Words, h: np.ndarray) -> np.ndarray:
    """The hashes if equal ones are equal words on the bytes; else numbers given by the bytes themselves."""
    if not len(h):
        return h
    order = np.argsort(h)
    i, j = order[:-1], order[1:]
    pair = h[i] == h[j]
    i, j = i[pair], j[pair]
    size = words.end - words.start
    if (size[i] == size[j]).all() and same_ranges(data, words.start[i], words.start[j], size[i]).all():
        return h
    raw, number = data.tobytes(), {}
    return np.array([number.setdefault(raw[s:e], len(number)) for s, e in zip(words.start.tolist(), words.end.tolist())], dtype=U64)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit blake2b digests of byte ranges."""
    make = hashlib.blake2b
    return np.frombuffer(b"".join([make(raw[s:e], digest_size=8).digest() for s, e in zip(start.tolist(), end.tolist())]), dtype="<u8").astype(U64)


def shingles(wh: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents, starts and ends of all runs of size words; a shorter non-empty document is one run."""
    count = np.diff(off)
    pre = prefix(wh)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(wh))
    whole = at + size <= off[1:][doc]
    short = (count > 0) & (count < size)
    s = np.concatenate([at[whole], off[:-1][short]])
    e = np.concatenate([at[whole] + size, off[1:][short]])
    d = np.concatenate([doc[whole], np.flatnonzero(short)])
    return mix(range_hash(pre, s, e) + (e - s).astype(U64) * U64(0x9FB21C651E98DF25)), d, s, e


def distinct_by_doc(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes by document, with the n + 1 offsets of documents."""
    bits = max(int(n), 1).bit_length()
    # documents in the high bits and the hash's high bits below: one sort, unless two hashes of a document differ in the bits cut off only
    order = np.argsort(doc.astype(U64) << U64(64 - bits) | h >> U64(bits))
    a, d = h[order], doc[order]
    if ((d[1:] == d[:-1]) & (a[1:] < a[:-1])).any():
        order = np.lexsort((h, doc))
        a, d = h[order], doc[order]
    h, doc = a, d
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def exact_shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Like distinct_by_doc of the texts' shingles, with numbers that are equal exactly for shingles of equal words (decided on the bytes)."""
    w = split_words(data, off)
    ids = exact_ids(data, w, word_hashes(data, w))
    h, doc, s, e = shingles(ids, w.off, size)
    order = np.argsort(h)
    i, j = order[:-1], order[1:]
    pair = h[i] == h[j]
    i, j = i[pair], j[pair]
    n = e - s
    same = n[i] == n[j]
    for k in range(size):
        at = np.flatnonzero(same & (n[i] > k))
        same[at] = ids[s[i[at]] + k] == ids[s[j[at]] + k]
    if not same.all():
        number: dict[tuple[int, ...], int] = {}
        h = np.array([number.setdefault(tuple(ids[x:y].tolist()), len(number)) for x, y in zip(s.tolist(), e.tolist())], dtype=U64)
    return distinct_by_doc(h, doc, len(off) - 1)
