"""Exact repeated-window search over sampled suffixes.

A window is W consecutive elements (bytes or words) of one document.  Every
window holds one anchor: the start of its least-hashed k-gram, leftmost on
ties.  Equal windows have equal anchors at equal offsets, so only suffixes that
start at anchors need to be compared.  The context of an anchor (the W - k
elements before it and W from it, within the document) holds every window that
the anchor serves.

0. Blocks are written with their anchors and the digests of the contexts.
1. Each block sends one representative per distinct (k-gram, context), known by
   the gram's hash and a blake2b digest of the context's bytes; a bucket of
   k-grams tells which contexts occur elsewhere (interior of a repeat) and which
   k-grams have several contexts (a repeat's boundary).
2. Blocks send the bytes of boundary contexts only.
3. A bucket sorts these suffixes and reversed prefixes by merge sort; two of
   them are compared by binary search for their common extension on prefix
   hashes, and the extensions of neighbours are verified on the elements.  The
   sorted neighbours' extensions decide each window.
4. Blocks take each repeated window's first place elsewhere (`earlier`), or mark
   what repeated windows cover.

Nothing is capped.  A k-gram or context that holds a third of the corpus
reaches a bucket once per block; a k-gram of more than HOT distinct boundary
contexts is split by the digests of its windows, which blocks pre-aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from ._text import U64, Texts, digests, mix, powers, prefix, range_hash

FULL, FETCH, SPLIT = 1, 2, 4
BUCKET_ROWS = 500_000  # representatives that a bucket gets on average
BOUNDARY_BYTES = 6 << 20  # bytes of boundary contexts that a bucket gets on average
HOT = 1 << 15  # boundary contexts of one k-gram from which its windows are spread by their digests
SORTED, SPREAD = 1 << 30, (1 << 30) + 1  # kinds of the second replies
STEP = 1 << 13  # anchors whose windows a block marks at once


class Elements(NamedTuple):
    """Elements of a block: hash values, element offsets of documents, and bytes; element i is data[i], or the word data[start[i]:start[i + 1] - 1]."""

    values: np.ndarray
    off: np.ndarray
    data: np.ndarray
    start: np.ndarray | None = None

    def span(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of element ranges."""
        return (lo, hi) if self.start is None else (self.start[lo], self.start[hi] - 1)


@dataclass(frozen=True)
class Windows:
    """window, gram: sizes in elements; earlier: only a document with a smaller id counts as elsewhere; elements: Texts to Elements; parse: bytes of contexts and their offsets to comparable elements side by side; value_of: their hash values."""

    window: int
    gram: int
    earlier: bool
    elements: Callable[[Texts], Elements]
    parse: Callable[[np.ndarray, np.ndarray], np.ndarray]
    value_of: Callable[[np.ndarray], np.ndarray]


@dataclass
class Anchors:
    """Anchors of one block in order of (gram, context, id, place), with the groups of equal (gram, context)."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    ids: np.ndarray
    place: np.ndarray  # of the anchor in its document
    gram: np.ndarray
    context: np.ndarray
    group: np.ndarray  # group of each anchor
    first: np.ndarray  # first anchor of each group


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w elements."""
    if w > len(x):
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def choose_anchors(spec: Windows, t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' elements, ascending, and digests of their contexts."""
    el = spec.elements(t)
    n, W, k, off = len(el.values), spec.window, spec.gram, el.off
    at = np.zeros(0, dtype=np.int64)
    if n >= W:
        pre = prefix(el.values)
        gram = mix((pre[k:] - pre[:-k]) * powers(n + 1)[1][: n - k + 1])
        low = sliding_min((gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64), W - k + 1)
        long = np.flatnonzero(np.diff(off) >= W)
        whole = np.zeros(n + 1, dtype=np.int8)
        whole[off[long]] += 1
        np.add.at(whole, off[long + 1] - W + 1, -1)
        low = low[np.cumsum(whole[: len(low)]).astype(bool)] & U64(0xFFFFFFFF)
        if len(low):
            keep = np.ones(len(low), dtype=bool)
            keep[1:] = low[1:] != low[:-1]
            at = low[keep].astype(np.int64)
    doc = np.searchsorted(off, at, side="right") - 1
    lo = np.maximum(off[doc], at - (W - k))
    # where in the context the anchor is belongs to its identity
    return at, mix(digests(el.data.tobytes(), *el.span(lo, np.minimum(off[doc + 1], at + W))) + (at - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


def pack_anchored(spec: Windows):
    """A block: its texts and anchors, which three steps use."""

    def make(t: Texts) -> bytes:
        at, c = choose_anchors(spec, t)
        return B.pack(t.ids, t.null.astype(np.uint8), np.diff(t.off), t.data, B.planes(np.diff(at, prepend=0), 4), c)

    return make


def read_anchored(payload: bytes) -> tuple[Texts, tuple[np.ndarray, np.ndarray]]:
    ids, null, size, data, at, c = B.unpack(payload)
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return Texts(ids, null.astype(bool), off, data), (np.cumsum(B.from_planes(at, 4).astype(np.int64)), c)


def find_anchors(spec: Windows, t: Texts, chosen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Elements, Anchors]:
    """The block's elements and anchors; chosen: what choose_anchors gave."""
    at, c = choose_anchors(spec, t) if chosen is None else chosen
    el = spec.elements(t)
    W, k, off = spec.window, spec.gram, el.off
    doc = np.searchsorted(off, at, side="right") - 1
    lo = np.maximum(off[doc], at - (W - k))
    hi = np.minimum(off[doc + 1], at + W)
    pre = prefix(el.values)
    g = mix((pre[at + k] - pre[at]) * powers(len(pre))[1][at])
    ids = t.ids[doc] if len(at) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((at, ids, c, g))
    at, lo, hi, ids, g, c, doc = (x[order] for x in (at, lo, hi, ids, g, c, doc))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    return el, Anchors(at, lo, hi, ids, at - off[doc], g, c, np.cumsum(new) - 1, np.flatnonzero(new))


def _groups(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def send_representatives(spec: Windows, n_buckets: int):
    def run(block: int, payload: bytes):
        _, a = find_anchors(spec, *read_anchored(payload))
        f = a.first
        # smaller-id rule: the group's least id and its place; else: whether the group has several places
        told = (a.ids[f], a.place[f].astype(np.uint32)) if spec.earlier else (np.minimum(np.diff(np.append(f, len(a.at))), 2).astype(np.uint8),)
        for b, i in B.Buckets((a.gram[f] % U64(n_buckets)).astype(np.int64)):
            yield b, block, 0, B.pack(a.gram[f][i], a.context[f][i], *(x[i] for x in told))

    return run


def classify(spec: Windows):
    """Per block (kind 0): the places, in what it sent to this bucket, of contexts that are elsewhere (with their first place) and of those whose elements are wanted. Kinds -1 and -2 count, in key, the wanted entries and those of hot k-grams."""

    def run(key: int, rows):
        got = [(block, *B.unpack(p)) for block, _, p in rows]
        src = np.repeat(np.arange(len(got)), [len(x[1]) for x in got])
        place = np.concatenate([np.arange(len(x[1])) for x in got])
        g, c, told = (np.concatenate([x[j] for x in got]) for j in (1, 2, 3))
        at = np.concatenate([x[4] for x in got]) if spec.earlier else np.zeros(len(g), dtype=np.uint32)
        order = np.lexsort((at, told, c, g))
        g, c, told, at, src, place = (x[order] for x in (g, c, told, at, src, place))
        new_c, new_g = _groups([g, c]), _groups([g])
        cs, gs = np.flatnonzero(new_c), np.flatnonzero(new_g)
        in_c, in_g = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
        if spec.earlier:
            full = told > told[cs][in_c]
            wants = ~full & (told > np.minimum.reduceat(told, gs)[in_g])
        else:
            full = (np.add.reduceat(told.astype(np.int64), cs) >= 2)[in_c]
            wants = ~full
        several = np.add.reduceat(new_c.astype(np.int64), gs)
        fetch = ((several > 1) & np.logical_or.reduceat(wants, gs))[in_g] & (new_c | ~full)
        split = fetch & (np.add.reduceat(fetch.astype(np.int64), gs) > HOT)[in_g]
        state = (full * FULL + (fetch & ~split) * FETCH + split * SPLIT).astype(np.uint8)
        yield int((fetch & ~split).sum()), -1, -1, b""
        yield int(split.sum()), -2, -2, b""
        use = np.flatnonzero(state > 0)
        use = use[np.argsort(src[use], kind="stable")]
        cut = np.searchsorted(src[use], np.arange(len(got) + 1))
        for i, (block, *_) in enumerate(got):
            if (j := use[cut[i] : cut[i + 1]]).size:
                known = j[full[j]]
                ref = (told[cs][in_c[known]], at[cs][in_c[known]]) if spec.earlier else ()
                yield key, block, 0, B.pack(place[j].astype(np.uint32), state[j], *ref)

    return run


@dataclass
class Verdicts:
    """State of each group, and the first place (id, place of the anchor) of those that are elsewhere."""

    state: np.ndarray
    id: np.ndarray
    place: np.ndarray


def verdicts(spec: Windows, a: Anchors, n_buckets: int, replies) -> Verdicts:
    n = len(a.first)
    out = Verdicts(np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))
    to = B.Buckets((a.gram[a.first] % U64(n_buckets)).astype(np.int64))
    for bucket, payload in replies:
        place, s, *ref = B.unpack(payload)
        at = to.of(bucket)[place]
        out.state[at] = s
        if spec.earlier:
            known = at[s & FULL > 0]
            out.id[known], out.place[known] = ref
    return out


def spread_windows(spec: Windows, el: Elements, a: Anchors, state: np.ndarray):
    """Windows of hot groups: group, offset, number of the distinct window; and of the distinct ones their two hashes, least id with the anchor's place, and how many (up to 2)."""
    g = np.flatnonzero(state & SPLIT)
    i = a.first[g]
    o = np.arange(spec.window - spec.gram + 1)
    ok = (a.at[i] - a.lo[i])[:, None] >= o[None, :]
    ok &= (a.hi[i] - a.at[i])[:, None] >= spec.window - o[None, :]
    e, o = np.nonzero(ok)
    start = a.at[i[e]] - o
    h = digests(el.data.tobytes(), *el.span(start, start + spec.window))
    # a window can hold several anchors: it meets its like under the same one only
    second = mix(range_hash(prefix(el.values), start, start + spec.window) + mix(a.gram[i[e]] + o.astype(U64)))
    order = np.lexsort((a.place[i[e]], a.ids[i[e]], second, h))
    new = _groups([h[order], second[order]]) if len(order) else np.zeros(0, dtype=bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    f = order[new]
    return g[e], o, number, h[f], second[f], a.ids[i[e[f]]], a.place[i[e[f]]], np.minimum(np.bincount(number, minlength=len(f)), 2)


def send_boundaries(spec: Windows, n_buckets: int, n_second: int, n_spread: int):
    """Second exchange: the bytes around boundary anchors; of hot k-grams their distinct windows."""

    def run(block: int, payload: bytes, replies):
        el, a = find_anchors(spec, *read_anchored(payload))
        state = verdicts(spec, a, n_buckets, [(k, p) for _, k, p in replies]).state
        g = np.flatnonzero(state & FETCH)
        i = a.first[g]
        s, e = el.span(a.lo[i], a.hi[i])
        out = []
        for b, j in B.Buckets(((a.gram[i] >> U64(32)) % U64(n_second)).astype(np.int64)):
            size = (e - s)[j]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            flat = np.repeat(s[j] - begin, size) + np.arange(size.sum())
            out.append((b, block, 0, B.pack(a.gram[i[j]], g[j].astype(np.uint32), a.ids[i[j]], a.place[i[j]].astype(np.uint32), (a.at - a.lo)[i[j]].astype(np.int32), (a.hi - a.at)[i[j]].astype(np.int32), size, el.data[flat])))
        if (state & SPLIT).any():
            _, _, _, h, second, ids, place, many = spread_windows(spec, el, a, state)
            for b, j in B.Buckets((h % U64(n_spread)).astype(np.int64)):
                out.append((n_second + b, block, 1, B.pack(h[j], second[j], ids[j], place[j].astype(np.uint32), many[j].astype(np.uint8))))
        if out:
            yield B.rows_batch(out)

    return run


def _padded(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    at = start[:, None] + step * np.arange(width)[None, :]
    ok = np.arange(width)[None, :] < size[:, None]
    return np.where(ok, flat[np.clip(at, 0, max(len(flat) - 1, 0))], 0)


def _common(pre: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j, by binary search on prefix hashes."""
    low, high = np.zeros(len(i), dtype=np.int64), np.minimum(size[i], size[j]).astype(np.int64)
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = pre[i, mid] == pre[j, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(rows: np.ndarray, size: np.ndarray, values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within groups (given sorted) and each row's common prefix with its predecessor (-1 at a group's first).

    Merge sort over the groups' runs; all merges of a level are done at once,
    every comparison by the binary search of _common.
    """
    n, width = rows.shape
    pre = np.zeros((n, width + 1), dtype=U64)
    np.cumsum(values * powers(width)[0][None, :], axis=1, out=pre[:, 1:])
    starts = np.flatnonzero(_groups([group])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, n))
    base, count = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    order = np.arange(n)

    def less(i, j, or_equal):
        m = _common(pre, size, i, j)
        ended_i, ended_j = m >= size[i], m >= size[j]
        c = np.minimum(m, width - 1)
        return np.where(ended_i & ended_j, or_equal, np.where(ended_i, True, np.where(ended_j, False, rows[i, c] < rows[j, c])))

    run = 1
    while n and run < sizes.max():
        at = np.flatnonzero(count > run)
        inner = at - base[at]
        pair = base[at] + (inner // (2 * run)) * 2 * run
        second = (inner // run) % 2 == 1
        end = base[at] + count[at]
        o_lo = np.where(second, pair, np.minimum(pair + run, end))
        o_hi = np.where(second, np.minimum(pair + run, end), np.minimum(pair + 2 * run, end))
        low, high = o_lo.copy(), o_hi.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            me, other = order[at[open_]], order[mid]
            # of equal rows those of the first run come first
            before = less(other, me, second[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        own = at - np.where(second, np.minimum(pair + run, end), pair)
        new = order.copy()
        new[pair + own + (low - o_lo)] = order[at]
        order = new
        run *= 2
    lcp = np.full(n, -1, dtype=np.int64)
    if n > 1:
        i, j = order[:-1], order[1:]
        inside = group[i] == group[j]
        lcp[1:][inside] = _common(pre, size, i[inside], j[inside])
        # verification on the elements: the claimed extension is equal and can't be longer
        for a in range(0, n - 1, 4096):
            x, y, m = i[a : a + 4096], j[a : a + 4096], lcp[1:][a : a + 4096]
            differ = (rows[x] != rows[y]) | (np.arange(width)[None, :] >= np.minimum(size[x], size[y])[:, None])
            true = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            if ((true != m) & (m >= 0)).any():
                return _exact_sort(rows, size, group)
    return order, lcp


def _exact_sort(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same result from the elements alone, for the case of a hash collision."""
    keys = [(int(g), rows[k, : size[k]].tolist()) for k, g in enumerate(group)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    lcp = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order)):
        (g, x), (h, y) = keys[order[k - 1]], keys[order[k]]
        if g == h:
            m = 0
            while m < min(len(x), len(y)) and x[m] == y[m]:
                m += 1
            lcp[k] = m
    return order, lcp


def repeated_windows(spec: Windows, gram, ids, place, left, right, flat) -> tuple[np.ndarray, np.ndarray]:
    """Matrix (entry, offset): whether the window that starts offset elements before the entry's anchor is elsewhere too; and, by the smaller-id rule, the entry of its first place. Entries sorted by gram."""
    n, reach = len(gram), spec.window - spec.gram
    size = left + right
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    out = np.zeros((n, reach + 1), dtype=bool)
    ref = np.zeros((n, reach + 1), dtype=np.int64) if spec.earlier else np.zeros((0, 0), dtype=np.int64)
    if n < 2:
        return out, ref
    group = np.cumsum(_groups([gram])) - 1
    r = _padded(flat, start + left, right, spec.window, 1)
    r_order, r_lcp = suffix_sort(r, right, spec.value_of(r), group)
    del r
    m = _padded(flat, start + left - 1, left, reach, -1)
    l_order, l_lcp = suffix_sort(m, left, spec.value_of(m), group)
    del m
    r_id, l_id = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(reach + 1):
        r_id[r_order] = np.cumsum(r_lcp < spec.window - o)
        l_id[l_order] = np.cumsum(l_lcp < o)
        ok = (left >= o) & (right >= spec.window - o)
        # a window that is alone on either side is unique
        ok &= (np.bincount(r_id, minlength=n + 1)[r_id] > 1) & (np.bincount(l_id, minlength=n + 1)[l_id] > 1)
        i = np.flatnonzero(ok)
        if len(i) < 2:
            continue
        key = r_id[i] * (n + 1) + l_id[i]
        order = np.lexsort((place[i], ids[i], key))
        new = np.flatnonzero(_groups([key[order]]))
        many = np.diff(np.append(new, len(i)))
        if spec.earlier:
            least = np.repeat(i[order[new]], many)
            hit = ids[i[order]] > ids[least]
            ref[i[order[hit]], o] = least[hit]
        else:
            hit = np.repeat(many > 1, many)
        out[i[order[hit]], o] = True
    return out, ref


def decide(spec: Windows, n_second: int):
    def spread(key: int, rows):
        got = [(block, *B.unpack(p)) for block, _, p in rows]
        h, second, ids, place, many = (np.concatenate([x[j] for x in got]) for j in range(1, 6))
        order = np.lexsort((place, ids, second, h))
        new = _groups([h[order], second[order]])
        first = np.flatnonzero(new)
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(new) - 1
        total, cut = np.bincount(at, many), np.cumsum([0] + [len(x[1]) for x in got])
        for (block, *_), a, b in zip(got, cut[:-1], cut[1:]):
            mine = at[a:b]
            yield key - n_second, block, SPREAD, B.pack((total[mine] >= 2).astype(np.uint8), ids[order[first]][mine], place[order[first]][mine])

    def run(key: int, rows):
        if key >= n_second:
            yield from spread(key, rows)
            return
        got = [(block, *B.unpack(p)) for block, _, p in rows]
        src = np.repeat(np.arange(len(got)), [len(x[1]) for x in got])
        gram, group, ids, place, left, right, width = (np.concatenate([x[j] for x in got]) for j in range(1, 8))
        flat = spec.parse(np.concatenate([x[8] for x in got]), np.concatenate([[0], np.cumsum(width)]))
        size = (left + right).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.argsort(gram, kind="stable")
        hits = np.zeros((len(order), spec.window - spec.gram + 1), dtype=bool)
        refs = np.zeros(hits.shape if spec.earlier else (0, 0), dtype=np.int64)
        a = 0
        while a < len(order):  # whole grams of about 8,192 entries at a time; one gram has at most about HOT
            b = min(len(order), a + 8192)
            b = int(np.searchsorted(gram[order], gram[order[b - 1]], side="right"))
            j = order[a:b]
            at = np.repeat(start[j] - np.concatenate([[0], np.cumsum(size[j])[:-1]]), size[j]) + np.arange(size[j].sum())
            hits[j], ref = repeated_windows(spec, gram[j], ids[j], place[j], left[j].astype(np.int64), right[j].astype(np.int64), flat[at])
            if spec.earlier:
                refs[j] = j[ref]
            a = b
        use = np.flatnonzero(hits.any(axis=1))
        by = np.searchsorted(src[use], np.arange(len(got) + 1))
        for i, (block, *_) in enumerate(got):
            if (u := use[by[i] : by[i + 1]]).size:
                ref = refs[u][hits[u]] if spec.earlier else None
                yield key, block, SORTED, B.pack(group[u], np.packbits(hits[u], axis=1).ravel(), *(() if ref is None else (ids[ref], place[ref])))

    return run


class Found(NamedTuple):
    """Mask of elements that repeated windows cover; by the smaller-id rule also the windows' starts, reference ids and places."""

    mask: np.ndarray
    start: np.ndarray
    id: np.ndarray
    place: np.ndarray


def covered(spec: Windows, t: Texts, n_buckets: int, n_spread: int, replies, chosen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Elements, Found]:
    """The block's elements and what repeated windows cover."""
    el, a = find_anchors(spec, t, chosen)
    v = verdicts(spec, a, n_buckets, [(k, p) for kind, k, p in replies if kind == 0])
    n, W, reach = len(el.values), spec.window, spec.window - spec.gram
    mine = a.group
    known = (v.state & FULL > 0)[mine]
    if spec.earlier:
        full = known | (a.ids > a.ids[a.first][mine])
    else:
        full = known | (np.diff(np.append(a.first, len(a.at))) > 1)[mine]
    i = np.flatnonzero(full)
    edges = np.bincount(a.lo[i], minlength=n + 1) - np.bincount(a.hi[i], minlength=n + 1)
    # by the smaller-id rule: start, id and anchor's place for each window
    many = a.hi[i] - W - a.lo[i] + 1 if spec.earlier else np.zeros(len(i), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64) if len(i) else many
    starts = [np.repeat(a.lo[i] - begin, many) + np.arange(many.sum())]
    ref_id = [np.repeat(np.where(known[i], v.id[mine[i]], a.ids[a.first][mine[i]]), many)]
    ref_at = [np.repeat(np.where(known[i], v.place[mine[i]], a.place[a.first][mine[i]]) - a.at[i], many) + starts[0]]

    def add(anchor: np.ndarray, offset: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        p = a.at[anchor] - offset
        np.add(edges, np.bincount(p, minlength=n + 1), out=edges)
        np.subtract(edges, np.bincount(p + W, minlength=n + 1), out=edges)
        if spec.earlier:
            starts.append(p)
            ref_id.append(ids)
            ref_at.append(place - offset)

    # a step costs the block's length, so it takes many anchors and the replies of all buckets
    told = [B.unpack(p) for kind, _, p in replies if kind == SORTED]
    if told:
        group, bits, *ref = (np.concatenate(x) for x in zip(*told))
        bits = bits.reshape(len(group), -1)
        slot = np.full(len(a.first), -1, dtype=np.int64)
        slot[group] = np.arange(len(group))
        hits = lambda rows: np.unpackbits(bits[rows], axis=1)[:, : reach + 1].astype(bool)
        begin = np.cumsum([0] + [int(hits(slice(x, x + STEP)).sum()) for x in range(0, len(group), STEP)])
        own = np.flatnonzero((slot[mine] >= 0) & ~full)
        own = own[np.argsort(slot[mine[own]], kind="stable")]
        cut = np.searchsorted(slot[mine[own]], np.arange(0, len(group) + STEP, STEP))
        for k, x in enumerate(range(0, len(group), STEP)):
            hit = hits(slice(x, x + STEP))
            for y in range(cut[k], cut[k + 1], STEP):
                some = own[y : min(y + STEP, cut[k + 1])]
                row = slot[mine[some]] - x
                e, o = np.nonzero(hit[row])
                r = e
                if spec.earlier:
                    number = np.cumsum(hit.ravel()).reshape(hit.shape) - 1 + begin[k]
                    r = number[row[e], o]
                add(some[e], o, *((ref[0][r], ref[1][r].astype(np.int64)) if spec.earlier else (r, r)))
    spreads = [(k, p) for kind, k, p in replies if kind == SPREAD]
    if spreads:
        group, o, number, h, _, ids, _, _ = spread_windows(spec, el, a, v.state)
        hit, r_id, r_at = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        to = B.Buckets((h % U64(n_spread)).astype(np.int64))
        for k, payload in spreads:
            at = to.of(k)
            yes, r_id[at], r_at[at] = B.unpack(payload)
            hit[at] = yes > 0
        # a group's representative answers for its anchors that aren't found otherwise
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(len(a.first) + 1))
        own = np.flatnonzero((v.state & SPLIT > 0)[mine] & ~full)
        for x in range(0, len(own), STEP):
            some = own[x : x + STEP]
            many = cut[mine[some] + 1] - cut[mine[some]]
            w = order[np.repeat(cut[mine[some]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            some = np.repeat(some, many)
            yes = (a.ids[some] > r_id[number[w]]) if spec.earlier else hit[number[w]]
            some, w = some[yes], w[yes]
            add(some, o[w], r_id[number[w]], r_at[number[w]])
    mask = np.cumsum(edges[:-1]) > 0
    return el, Found(mask, np.concatenate(starts), np.concatenate(ref_id), np.concatenate(ref_at))


def search(spec: Windows, docs: DataFrame, id_col: str, text_col: str, density: float, finish, schema: str) -> DataFrame:
    """finish(Texts, Elements, Found) gives the record batches of the result for each block. density: anchors per byte, for the number of buckets only."""
    spark, path = docs.sparkSession, B.shared_dir(docs.sparkSession)
    blocks, _, n_bytes = B.write_blocks(docs, path, id_col, text_col, pack_anchored(spec))
    n_buckets = max(1, round(n_bytes * density / BUCKET_ROWS))
    known = B.written(B.reduce_buckets(B.map_blocks(blocks, send_representatives(spec, n_buckets)), n_buckets, classify(spec)), path, "known", "uncompressed")
    wanted, split = known.agg(F.coalesce(F.sum(F.when(F.col("kind") == -1, F.col("key"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("kind") == -2, F.col("key"))), F.lit(0))).first()
    B.dropped(spark, path)
    n_second = max(1, round(wanted * 2 * spec.window * (8 if spec.earlier else 1) / BOUNDARY_BYTES))
    n_spread = max(1, round(split * (spec.window - spec.gram + 1) / BUCKET_ROWS))
    first = known.where("kind = 0")
    near = B.join_blocks(blocks, [first], send_boundaries(spec, n_buckets, n_second, n_spread), B.ROWS)
    decided = B.reduce_buckets(near, n_second + n_spread, decide(spec, n_second))

    def last(block: int, payload: bytes, replies) -> list[pa.RecordBatch]:
        t, chosen = read_anchored(payload)
        return finish(t, *covered(spec, t, n_buckets, n_spread, replies, chosen))

    return B.join_blocks(blocks, [first, decided], last, schema)
