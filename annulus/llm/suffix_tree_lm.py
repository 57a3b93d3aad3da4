"""Operator 9: language-model scores from a probabilistic suffix tree.

Tokens are lower-cased words plus one end token per document; each word is a
symbol of its own.  States are contexts of 1, 2, 4, 8, ... words inside a
document; lengths double until no context of a length is kept, so the tree's
depth is found by the divergence test alone.  A context of at least LEAST
training occurrences is kept if its next-word distribution diverges from that of
its longest kept suffix: if the smoothed counts, each occurrence left out of its
own estimate, predict the words after it by at least DIVERGENCE nats an
occurrence better than the suffix does.  Distributions are smoothed towards the
suffix's, down to the root, which is the base model, with the weight of
PULL / length**2 occurrences and of those whose word occurred once after the
shorter context, which tell nothing of their own.  Without kept contexts the
score equals the base score.

Word, context and pair counts are exact over all training documents.  At each
length a block sends its distinct contexts and (context, word) pairs, with
training counts and the word's probability so far, to the context's bucket, which
returns the counts of pairs and of the contexts that it keeps.  A pair that
occurred once at one length isn't sent at the next, nor is a context whose part
one word shorter was rarer than LEAST.  Contexts of one or two words with WIDE
occurrences get the same test in parts: a context and its next word have a bucket
of their own, so no key gathers more than one row a block and WIDE pairs, and the
parts' gains and the occurrences without a pair, two whole numbers a context and
at most N / WIDE contexts, are summed by Spark and meet on the driver; longer
contexts that frequent have few next words.  WIDE changes no result.  HOT, off
unless set, keeps contexts of that many occurrences without a test.  Tables are bucketed by block: only counts move, and nothing of the tree
is on the driver.  Words get numbers, small ones to frequent words; contexts are
known by 56 bits of their hash.

Defined cases: null and empty texts are one end token; with no training
documents every word is unknown and scores are 0; repeated rows are separate
documents; a null id counts as the text 'null' for its fold and stays null; ties
don't arise; texts of any length are read whole; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B
from ._text import LOWER, U64, Texts, mix, prefix, range_hash, split_words, word_hashes

LEAST, DIVERGENCE, PULL = 4, 0.02, 20.0
HOT, WIDE = 1 << 62, 1 << 20
GAIN = 1 << 16  # steps of a nat in which parts of a gain are summed
END = U64(0x1F3D5B79A8C6E402)
FEWEST = 12  # buckets of long contexts, for parallel work
BUCKET = 1 << 19  # words, contexts or pairs that a bucket gets on average
TIMES = 3  # blocks of so many times the usual bytes: messages, one a block and bucket, are fewer and hold more
FINE, SENT = 2048, 64  # steps of a kept probability's logarithm by nat, and how many of them make a step of a sent one
STATE = "block long, kept long, open long, state binary"


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, the end token last in each document, and token offsets."""
    data = LOWER[t.data]
    w = split_words(data, t.off)
    h = word_hashes(data, w)
    off = w.off + np.arange(len(w.off))
    out = np.empty(off[-1], dtype=U64)
    ends = off[1:] - 1
    rest = np.ones(len(out), dtype=bool)
    rest[ends] = False
    out[rest], out[ends] = h, END
    return out, off


def held_out(t: Texts, parts: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if n else str(i).encode()) % parts == held for i, n in zip(t.ids.tolist(), t.null.tolist())], dtype=bool)


def pack_tokens(parts: int, held: int):
    """A block before words are counted."""

    def make(t: Texts) -> bytes:
        h, off = tokens(t)
        own, inverse = np.unique(h, return_inverse=True)
        return B.pack(t.ids, t.null.astype(np.uint8), np.diff(off), held_out(t, parts, held).astype(np.uint8), own, B.planes(inverse, 4))

    return make


class Tokens(NamedTuple):
    """A block: ids, their nulls, tokens by document, held-out documents, base scores, known tokens; its distinct tokens' numbers and counts; and of each token its place among them."""

    ids: np.ndarray
    null: np.ndarray
    size: np.ndarray
    out: np.ndarray
    base: np.ndarray
    known: np.ndarray
    own: np.ndarray
    total: np.ndarray
    inverse: np.ndarray

    @classmethod
    def read(cls, payload: bytes) -> "Tokens":
        *docs, own, total, inverse = B.unpack(payload)
        return cls(*docs, np.cumsum(B.from_planes(own, 6), dtype=U64), B.from_planes(total, 6).astype(np.int64), B.from_planes(inverse, 4).astype(np.int64))

    def pack(self) -> bytes:
        return B.pack(*self[:6], B.planes(np.diff(self.own, prepend=U64(0)), 6), B.planes(self.total, 6), B.planes(self.inverse, 4))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits, so that sorted hashes have sorted buckets."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _send_counts(n: int):
    def run(block: int, payload: bytes):
        _, _, size, out, own, inverse = B.unpack(payload)
        count = np.bincount(B.from_planes(inverse, 4).astype(np.int64), np.repeat(out == 0, size), len(own)).astype(np.int64)
        for k, i in B.Buckets(_bucket(own, n)):
            yield k, block, 0, B.pack(own[i], B.planes(count[i], 6))

    return run


def _total_counts(n: int):
    """Numbers and totals for the blocks; kinds -1 and -2 have the bucket's tokens and words in key."""

    def run(key: int, rows):
        got = [(block, *B.unpack(p)) for block, _, p in rows]
        words, at = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([B.from_planes(g[2], 6) for g in got]), len(words)).astype(np.int64)
        number = np.empty(len(words), dtype=np.int64)
        number[np.lexsort((words, -total))] = np.arange(len(words)) * n + key
        cut = np.cumsum([0] + [len(g[1]) for g in got])
        for (block, *_), a, b in zip(got, cut[:-1], cut[1:]):
            yield key, block, 0, B.pack(B.planes(number[at[a:b]], 6), B.planes(total[at[a:b]], 6))
        yield int(total.sum()), -1, -1, b""
        yield int((total > 0).sum()), -2, -2, b""
        yield int(total.max(initial=0)), -3, -3, b""

    return run


def _numbered(n: int, D: float):
    """The block with its words' numbers, base scores and counts."""

    def run(block: int, payload: bytes, replies) -> Iterator[pa.RecordBatch]:
        ids, null, size, out, own, inverse = B.unpack(payload)
        number, total, to = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64), B.Buckets(_bucket(own, n))
        for _, key, p in replies:
            i = to.of(key)
            number[i], total[i] = (B.from_planes(x, 6).astype(np.int64) for x in B.unpack(p))
        order = np.argsort(number)
        place = np.empty(len(own), dtype=np.int64)
        place[order] = np.arange(len(own))
        inverse = place[B.from_planes(inverse, 4).astype(np.int64)]
        number, total = number[order].astype(U64), total[order]
        doc = np.repeat(np.arange(len(ids)), size)
        base = np.bincount(doc, np.log10((total + 0.5) / D)[inverse], len(ids))
        known = np.bincount(doc, (total > 0)[inverse], len(ids)).astype(np.int64)
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([Tokens(ids, null, size, out, base, known, number, total, inverse).pack()], pa.binary())], names=["block", "payload"])

    return run


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log(p) * FINE), 0, 65535).astype(np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one of each, and each element's number."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(y), dtype=bool)
    new[1:] = y[1:] != y[:-1]
    at = np.empty(len(y), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return y[new], order[new], at


class Level:
    """A block's contexts of one length: positions that have one which may be frequent, distinct contexts, and distinct pairs.

    It comes from the block's payload at length 1, then from the state that the length before left: all documents' scores; the documents that hold such positions, with sizes, held-out flags and tokens; and of these positions places, codes, counts of the word after the shorter context, and counts of that context.
    """

    def __init__(self, data: bytes, length: int, hot: int, wide: int, D: float, wide_only: bool = False):
        """wide_only: stop at what is known of wide contexts, before anything is sorted."""
        if length == 1:
            b = Tokens.read(data)
            self.which, self.size, self.out, self.own, self.inverse = np.arange(len(b.ids)), b.size, b.out, b.own, b.inverse
            n = b.total[b.inverse]
            pos = np.flatnonzero(n[:-1] >= LEAST) + 1
            self.score, code, n, before = b.base, _code((b.total + 0.5) / D)[b.inverse[pos]], n[pos], n[pos - 1]
        else:
            self.score, self.which, self.size, self.out, own, inverse, pos, code, n, before = B.unpack(data)
            self.own, self.inverse = np.cumsum(B.from_planes(own, 6), dtype=U64), B.from_planes(inverse, 4).astype(np.int64)
            pos = np.cumsum(B.from_planes(pos, 4).astype(np.int64))
            code, n, before = B.from_planes(code, 2).astype(np.int64), B.from_planes(n, 6).astype(np.int64), B.from_planes(before, 6).astype(np.int64)
        self.off = off = np.concatenate([[0], np.cumsum(self.size)])
        doc = np.repeat(np.arange(len(self.size)), self.size)[pos]
        whole = pos - off[doc] >= length
        self.pos, self.code, self.doc = pos, code, doc = pos[whole], code[whole], doc[whole]
        n, before = n[whole], before[whole]
        h = mix(self.own + U64(1))[self.inverse]
        c = mix(range_hash(prefix(h), pos - length, pos) + U64(length))
        train = (self.out == 0)[doc]
        #: words after the context that occurred more than once after the shorter one
        self.sent = np.flatnonzero(n >= 2)
        none = np.zeros(len(pos), dtype=np.int64)
        self.hot = np.where(before >= hot, before, 0) if length <= 2 else none
        self.wide = np.where((before >= wide) & (self.hot == 0), before, 0) if length <= 2 else none
        self.parent = c >> U64(8)
        self.loose = train & (n < 2) & (self.wide > 0)
        if wide_only:
            return
        split = (self.hot > 0) | (self.wide > 0)
        if split.any():
            c = np.where(split, mix(c ^ mix(h[pos])), c)
        self.context, first, self.at = _distinct(c >> U64(8))
        #: of a wide context's part its context and that one's occurrences, else 0
        part = self.wide[first] > 0
        self.part_of, self.part_total = np.where(part, self.parent[first], U64(0)), self.wide[first]
        self.count = np.bincount(self.at, train, len(self.context)).astype(np.int64)
        key = self.at[self.sent].astype(U64) << U64(40) | self.own[self.inverse[pos[self.sent]]]
        # a word after a context has one code
        self.pair, first, self.pair_at = _distinct(key)
        self.pair_count = np.bincount(self.pair_at, train[self.sent], len(self.pair)).astype(np.int64)
        self.pair_code = code[self.sent[first]]

    def slices(self, n: int) -> Iterator[tuple[int, slice, slice]]:
        """Bucket, its contexts and its pairs."""
        bucket = _bucket(self.context << U64(8), n)
        owner = (self.pair >> U64(40)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
        last = np.append(first[1:], len(bucket))[: len(first)]
        for a, b, x, y in zip(first.tolist(), last.tolist(), np.searchsorted(owner, first).tolist(), np.searchsorted(owner, last).tolist()):
            yield int(bucket[a]), slice(a, b), slice(x, y)


def _send_level(length: int, n: int, D: float):
    def run(block: int, data: bytes):
        v = Level(data, length, HOT, WIDE, D)
        many = np.bincount((v.pair >> U64(40)).astype(np.int64), minlength=len(v.context))
        for k, c, p in v.slices(n):
            parts = ()
            if v.part_total[c].any():  # wide contexts are few: each once, and by context which it is a part of
                parent, one, which = np.unique(v.part_of[c], return_index=True, return_inverse=True)
                parts = (parent, v.part_total[c][one], B.narrow(which))
            yield k, block, 0, B.pack(B.planes(np.diff(v.context[c], prepend=U64(0)), 7), B.narrow(v.count[c]), B.narrow(many[c]), B.planes(v.pair[p], 5), B.narrow(v.pair_count[p]), B.narrow((v.pair_code[p] + SENT // 2) // SENT), *parts)

    return run


def _send_loose(length: int, D: float):
    """Of wide contexts, in key: in block how many of their training occurrences are of words that aren't sent (kind -3), and how many all blocks have (-4)."""

    def run(block: int, data: bytes):
        v = Level(data, length, HOT, WIDE, D, wide_only=True)
        context, at = np.unique(v.parent[v.wide > 0], return_inverse=True)
        total = np.zeros(len(context), dtype=np.int64)
        total[at] = v.wide[v.wide > 0]
        for c, k, n in zip(context.tolist(), np.bincount(at, v.loose[v.wide > 0], len(context)).astype(np.int64).tolist(), total.tolist()):
            yield c, k, -3, b""
            yield c, n, -4, b""

    return run


def _sums(rows: DataFrame, *kinds: int) -> list[dict[int, int]]:
    """For each kind block summed by key (of kind -4 the same in all): one row a wide context. The rows are made once for all kinds."""
    found: list[dict[int, int]] = [{} for _ in kinds]
    total = F.when(F.col("kind") == -4, F.max("block")).otherwise(F.sum("block")).alias("n")
    for r in rows.where(F.col("kind").isin(*kinds)).groupBy("kind", "key").agg(total).toLocalIterator():
        found[kinds.index(r["kind"])][r["key"]] = r["n"]
    return found


def _lookup(x: np.ndarray, table: dict[int, int]) -> np.ndarray:
    own, at = np.unique(x, return_inverse=True)
    return np.array([table.get(k, 0) for k in own.tolist()], dtype=np.int64)[at] if len(own) else np.zeros(0, dtype=np.int64)


def _judge(length: int, wide: dict[int, int]):
    """wide: the occurrences of wide contexts that no pair counts; kind -3 has parts of their gains, by context in key, in block.  For each block the counts of kept contexts (0: not kept), how many of these occurrences no pair counts, and the pairs' counts."""
    pull = PULL / length**2

    def run(key: int, rows):
        got = []
        for block, _, p in rows:
            c, count, many, succ, n, code, *parts = B.unpack(p)
            c = np.cumsum(B.from_planes(c, 7), dtype=U64)
            parts = (parts[0][parts[2]], parts[1][parts[2]]) if parts else (np.zeros(len(c), dtype=U64), np.zeros(len(c), dtype=np.int64))
            got.append((block, c, count, many, B.from_planes(succ, 5), n, code, *parts))
        context, where, at = np.unique(np.concatenate([g[1] for g in got]), return_index=True, return_inverse=True)
        part_of, part_total = (np.concatenate([g[k] for g in got])[where] for k in (7, 8))
        total = np.bincount(at, np.concatenate([g[2] for g in got]), len(context))
        own = np.repeat(at, np.concatenate([g[3] for g in got]).astype(np.int64))
        pair, first, pair_at = np.unique(own.astype(U64) << U64(40) | np.concatenate([g[4] for g in got]), return_index=True, return_inverse=True)
        n = np.bincount(pair_at, np.concatenate([g[5] for g in got]), len(pair))
        p = np.exp(np.concatenate([g[6] for g in got])[first].astype(np.float64) * SENT / -FINE)
        mine = (pair >> U64(40)).astype(np.int64)
        # each occurrence is predicted from the others
        loose = total - np.bincount(mine, n, len(context))
        some = n > 0
        if part_total.any():
            use = np.flatnonzero(some & (part_total[mine] > 0))
            all_, many = part_total[mine[use]], n[use]
            gain = many * np.log((many - 1 + (pull + _lookup(part_of[mine[use]], wide)) * p[use]) / ((all_ - 1 + pull) * p[use]))
            parents, of = np.unique(part_of[mine[use]], return_inverse=True)
            steps = np.zeros(len(parents), dtype=np.int64)
            np.add.at(steps, of, np.rint(gain * GAIN).astype(np.int64))
            for c, k in zip(parents.tolist(), steps.tolist()):
                yield c, k, -3, b""
        w = pull + loose[mine[some]]
        gain = np.bincount(mine[some], n[some] * np.log((n[some] - 1 + w * p[some]) / ((total[mine[some]] - 1 + pull) * p[some])), len(context))
        many = np.maximum(total, 1)
        gain += loose * np.log((pull + np.maximum(loose, 1) - 1) / (many - 1 + pull))
        kept = np.where((part_total == 0) & (total >= LEAST) & (gain >= DIVERGENCE * total), total, 0)
        unsent = np.where(kept > 0, loose, 0)
        cut, pair_cut = np.cumsum([0] + [len(g[1]) for g in got]), np.cumsum([0] + [len(g[4]) for g in got])
        for k, (block, *_) in enumerate(got):
            i = at[cut[k] : cut[k + 1]]
            yield key, block, 0, B.pack(B.narrow(kept[i]), B.narrow(unsent[i]), B.narrow(n[pair_at[pair_cut[k] : pair_cut[k + 1]]]))

    return run


def _kept_wide(length: int, wide: dict[int, int], total: dict[int, int], gains: dict[int, int]) -> dict[int, int]:
    """The wide contexts that pass the test, with their occurrences."""
    pull = PULL / length**2
    end = {c: wide.get(c, 0) * np.log((pull + max(wide.get(c, 0), 1) - 1) / (total[c] - 1 + pull)) for c in total}
    return {c: n for c, n in total.items() if gains.get(c, 0) / GAIN + end[c] >= DIVERGENCE * n}


def _deepen(length: int, n: int, D: float, wide: dict[int, int], kept_wide: dict[int, int]):
    """The block's state with the probabilities of this length's kept contexts."""
    pull = PULL / length**2

    def run(block: int, data: bytes, replies) -> Iterator[pa.RecordBatch]:
        v = Level(data, length, HOT, WIDE, D)
        kept, loose, pair_n = np.zeros(len(v.context), dtype=np.int64), np.zeros(len(v.context), dtype=np.int64), np.zeros(len(v.pair), dtype=np.int64)
        to = {k: (c, p) for k, c, p in v.slices(n)}
        for _, key, r in replies:
            c, p = to[key]
            kept[c], loose[c], pair_n[p] = B.unpack(r)
        total = np.where(v.hot > 0, v.hot, kept[v.at])
        weight = pull + np.where(v.hot > 0, 0, loose[v.at])
        if len(w := np.flatnonzero(v.wide > 0)):
            total[w], weight[w] = _lookup(v.parent[w], kept_wide), pull + _lookup(v.parent[w], wide)
        count = np.zeros(len(v.pos), dtype=np.int64)
        count[v.sent] = pair_n[v.pair_at]
        i = np.flatnonzero(total > 0)
        old = v.code[i]
        new = _code((count[i] + weight[i] * np.exp(old / -FINE)) / (total[i] + pull))
        code = v.code.copy()
        code[i] = new
        score = v.score + np.bincount(v.which[v.doc[i]], (old.astype(np.float64) - new) / (FINE * np.log(10)), len(v.score))
        # what no longer context needs is left out; a context of LEAST occurrences was one at this length too
        before = np.flatnonzero(count[:-1] >= LEAST)
        before = before[v.pos[before + 1] == v.pos[before] + 1]
        open_ = before + 1
        whole = v.pos[open_] - v.off[v.doc[open_]] >= 2 * length
        open_, before = open_[whole], before[whole]
        has = np.zeros(len(v.size), dtype=bool)
        has[v.doc[open_]] = True
        gone = np.cumsum(np.where(has, 0, v.size))  # tokens of left-out documents up to each
        inverse = v.inverse[np.repeat(has, v.size)]
        used = np.zeros(len(v.own), dtype=bool)
        used[inverse] = True
        inverse = (np.cumsum(used) - 1)[inverse]
        pos = v.pos[open_] - gone[v.doc[open_]]
        left = B.pack(score, v.which[has], v.size[has], v.out[has], B.planes(np.diff(v.own[used], prepend=U64(0)), 6), B.planes(inverse, 4), B.planes(np.diff(pos, prepend=0), 4), B.planes(code[open_], 2), B.planes(count[open_], 6), B.planes(count[before], 6))
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([len(i)], pa.int64()), pa.array([len(open_)], pa.int64()), pa.array([left], pa.binary())], names=["block", "kept", "open", "state"])

    return run


def score_documents(docs: DataFrame, parts: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, path = docs.sparkSession, B.shared_dir(docs.sparkSession)
    counted, n_blocks, n_bytes = B.write_blocks(docs, path, id_col, text_col, pack_tokens(parts, held), TIMES, B.halving_parts)
    tasks = most_tasks = B.halving_parts(n_blocks)
    first = None
    n_words = max(1, round(n_bytes / 48 / BUCKET))
    counts = B.written(B.reduce_buckets(B.map_blocks(counted, _send_counts(n_words)), n_words, _total_counts(n_words)), path, "counts", "uncompressed")
    N, V, most = counts.agg(*[F.coalesce(f(F.when(F.col("kind") == k, F.col("key"))), F.lit(0)) for f, k in ((F.sum, -1), (F.sum, -2), (F.max, -3))]).first()
    B.dropped(spark, path)
    D = N + 0.5 * (V + 1)
    blocks = B.bucketed(B.join_blocks(counted, [counts.where("kind = 0")], _numbered(n_words, D), "block long, payload binary"), path, "tokens", tasks)
    B.dropped(spark, path, "counts", "blocks")
    n, length, level, columns, state = max(1, round(n_bytes / 8 / BUCKET)), 1, blocks, ("payload",), None
    while N:
        wide, total, kept_wide = {}, {}, {}
        if length <= 2 and most >= WIDE:
            told = B.map_blocks(level, _send_loose(length, D), columns)
            wide, total = _sums(told, -3, -4)
        known = B.written(B.reduce_buckets(B.map_blocks(level, _send_level(length, n, D), columns), n, _judge(length, wide)), path, f"known{length}", "uncompressed")
        if total:
            kept_wide = _kept_wide(length, wide, total, *_sums(known, -3))
        B.dropped(spark, path)
        state = B.bucketed(B.join_blocks(level, [known.where("kind = 0")], _deepen(length, n, D, wide, kept_wide), STATE, columns), path, f"state{length}", tasks)
        kept, left = state.agg(F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0))).first()
        # buckets follow the positions that are left, else blocks send many empty messages; so do the state's files and tasks, which still have whole blocks
        n, first = min(n, max(FEWEST, round(left / BUCKET))), first or left
        while tasks % 2 == 0 and tasks // 2 >= max(FEWEST, most_tasks * left / max(first, 1)):
            tasks //= 2
        B.dropped(spark, path, f"known{length}", f"state{length // 2}")
        level, columns, length = state, ("state",), length * 2
        if not kept or not left:
            break

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Tokens.read(batch.column(0)[i].as_py())
                total = B.unpack(batch.column(1)[i].as_py())[0] if batch.num_columns > 1 else b.base
                yield pa.record_batch([pa.array(b.ids, pa.int64(), mask=b.null.astype(bool)), pa.array(b.out.astype(bool)), pa.array(b.size), pa.array(b.known), pa.array(np.full(len(b.ids), N, dtype=np.int64)), pa.array(b.base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = blocks.select("payload") if state is None else blocks.join(state, "block").select("payload", "state")
    return scored.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
