"""Operator 5: near-duplicate classes by HyperMinHash, banding and full-set verification.

A document's shingles are hashed once; the top bits choose one of REGISTERS
registers, which keeps the least of the rest as a leading-zero count (6 bits)
and MANTISSA mantissa bits.  Bands of ROWS_PER_BAND registers are the candidate
keys: with 42 bands of 3 a pair at a similarity of 0.8 has no common band with
probability (1 - 0.8**3)**42 = 8e-14.  Few shingles fill few bands, so sets of at
most FEW have exact keys besides: the set, and the set without any one or two
members as far as the threshold allows; linked sets of at most FEW at 80 percent
differ in two members at most and always share a key.

Candidates are resolved in rounds that never list all pairs of a group.  First
documents of equal shingle sets are linked with the least of them; those copies
need no bands, as they have the same links.  Documents of one sketch but
different sets have bands of their own.  Round one compares each other document
with the least one that heads SHARED of its band groups; what it leaves out falls
to round two.  That looks only at band groups that still hold several
components, and there at pairs across components whose sizes allow a link.  A
second sketch holds, for each of PARITIES slots, whether an odd number of the
set's shingles falls into it: two sketches differ in at most as many slots as
the sets differ in shingles, so a pair that differs in more slots than linked
sets may is refused without loss.  Pairs that are left leave the task if the
collision-corrected Jaccard estimate on the registers may reach the threshold
(a linked pair's estimate is below the bound with probability 1e-12).  A group
of more than PART rows is cut into classes of sizes, of which only neighbours
meet, and classes above PART into parts, of which each task takes two.  Every
link is confirmed on the full shingle sets, whose shingles are told apart on the
words' bytes; components come from alternating large-star and small-star steps
on written tables.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; fewer words than the shingle size make one shingle; of rows with equal
ids the links of any count for all; rows with a null id take no part (component
null, kept true); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import dropped, shared_dir, written
from ._text import LOWER, U64, column_bytes, distinct_by_doc, exact_shingles, ids_of, mix, shingles, slices, split_words, word_hashes

REGISTERS, MANTISSA, ROWS_PER_BAND = 128, 26, 3
PARITIES, FOLDS = 2048, 4  # slots of the second sketch; its folds are laid over each other for a first look
FEW = 13  # sets of at most so many shingles have exact keys
SLICE = 1 << 18
BITS = 1 << 23  # positions of the filter of wanted documents: 1 MB at any scale
PER_PIVOT = 2000  # documents that one task compares with a pivot before the pivot is salted
SHARED = 3  # keys that round one asks of a pair; one with fewer is left to round two, as most have nothing else in common
SMALL = 64  # rows of a band group up to which it is compared together with others
PART = 8192  # rows of a band group, or of one part of it, that one task takes whole
STEPS = 100  # star steps; each at least halves the longest path, so a graph of 2**64 nodes needs fewer


def shingle_sets(off: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of lower-cased texts and their offsets."""
    data = LOWER[data]
    w = split_words(data, off)
    h, doc, _, _ = shingles(word_hashes(data, w), w.off, size)
    return distinct_by_doc(h, doc, len(off) - 1)


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix (document, register) of compressed minima; 2**32 - 1 where a register is empty."""
    n = len(off) - 1
    out = np.full((n, REGISTERS), 0xFFFFFFFF, dtype=np.uint32)
    if len(h):
        h = mix(h ^ U64(0x5851F42D4C957F2D))
        doc = np.repeat(np.arange(n), np.diff(off))
        slot = doc * REGISTERS + (h >> U64(57)).astype(np.int64)
        least = np.full(n * REGISTERS, U64(1) << U64(57), dtype=U64)
        np.minimum.at(least, slot, h & U64((1 << 57) - 1))
        slot = np.flatnonzero(least < U64(1) << U64(57))
        rest = least[slot]
        # float64 exponent of rest = 57 bits minus leading zeros (exact below 2**53 after the shift)
        length = np.frexp((rest >> U64(4)).astype(np.float64))[1]
        zeros = np.minimum(53 - length, 53)
        top = np.where(length > MANTISSA, (rest >> U64(4)) >> np.maximum(length - 1 - MANTISSA, 0).astype(U64), (rest >> U64(4)) << np.maximum(MANTISSA + 1 - length, 0).astype(U64))
        # more zeros sort first, as the smaller minimum
        out.ravel()[slot] = ((np.uint32(53) - zeros.astype(np.uint32)) << np.uint32(MANTISSA)) | (top & U64((1 << MANTISSA) - 1)).astype(np.uint32)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows, registers in use, and how many of these differ."""
    full = (a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)
    same = ((a == b) & full).sum(axis=-1)
    used = np.maximum(full.sum(axis=-1), 1)
    # chance agreement of unrelated minima: about 1 / (3 * 2**MANTISSA) a register
    chance = 1 / (3 * 2.0**MANTISSA)
    return np.clip((same / used - chance) / (1 - chance), 0, 1), used, full.sum(axis=-1) - same


def parities(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix (document, byte) of PARITIES bits: whether an odd number of the set's hashes falls into the slot."""
    n = len(off) - 1
    slot = np.repeat(np.arange(n), np.diff(off)) * PARITIES + (mix(h ^ U64(0xA54FF53A5F1D36F1)) % U64(PARITIES)).astype(np.int64)
    odd = np.zeros(n * PARITIES, dtype=np.uint8)
    np.add.at(odd, slot, np.uint8(1))  # modulo 256, which keeps the parity
    return np.packbits(odd.reshape(n, PARITIES) & 1, axis=1)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, digest2, sketch, odd, few) of (doc_id, text); digests of the set, its registers and parities, and few: the hashes of a set of at most FEW."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, _, _ in slices(batch, "doc_id", "text", SLICE):
                h, off = shingle_sets(t.off, t.data, size)
                n, r, odd = np.diff(off), registers(h, off), parities(h, off)
                digest = [set_sums(mix(h ^ U64(k)), off).view(np.int64) for k in (0x3C6EF372FE94F82B, 0x510E527FADE682D1)]
                few = [h[a:b].tobytes() if a < b <= a + FEW else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.record_batch([t.id_column(), pa.array(n, pa.int64()), *(pa.array(x) for x in digest), *(pa.array([x.tobytes() if k else None for x, k in zip(y, n)], pa.binary()) for y in (r, odd)), pa.array(few, pa.binary())], names=["doc_id", "n_shingles", "digest", "digest2", "sketch", "odd", "few"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest long, digest2 long, sketch binary, odd binary, few binary")


def set_sums(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 by document."""
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(h, dtype=U64)])
    return total[off[1:]] - total[off[:-1]]


def few_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a small set: its own, and those of it without one or two members, where what is left may be linked with it."""
    h = mix(h ^ U64(0x1F83D9ABFB41BD6B))
    out = [h.sum(dtype=U64)[None]]
    if 100 * (len(h) - 1) >= percent * len(h):
        out.append(out[0] - h)
    if 100 * (len(h) - 2) >= percent * len(h):
        i, j = np.triu_indices(len(h), 1)
        out.append(out[0] - h[i] - h[j])
    return mix(np.concatenate(out) + U64(0x5BE0CD19137E2179))


def band_keys(sketches: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id) for every band that isn't empty, and the keys of small sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            r = np.frombuffer(column_bytes(batch.column(1))[1].tobytes(), np.uint32).reshape(len(ids), REGISTERS)
            r = r[:, : REGISTERS // ROWS_PER_BAND * ROWS_PER_BAND].reshape(len(ids), -1, ROWS_PER_BAND)
            empty = (r == 0xFFFFFFFF).all(axis=2)
            key = np.arange(r.shape[1], dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15) + U64(7)
            for k in range(ROWS_PER_BAND):
                key = mix(key ^ r[:, :, k].astype(U64))
            d, b = np.nonzero(~empty)
            yield pa.record_batch([pa.array(key[d, b].view(np.int64)), pa.array(ids[d])], names=["key", "doc_id"])
            own = [(i, few_keys(np.frombuffer(x, U64), percent)) for i, x in zip(ids.tolist(), batch.column(2).to_pylist()) if x]
            if own:
                yield pa.record_batch([pa.array(np.concatenate([k for _, k in own]).view(np.int64)), pa.array(np.repeat([i for i, _ in own], [len(k) for _, k in own]), pa.int64())], names=["key", "doc_id"])

    return sketches.where("sketch is not null and doc_id is not null").select("doc_id", "sketch", "few").mapInArrow(run, "key long, doc_id long")


def _wanted(ids: DataFrame) -> np.ndarray:
    """Bit table of 1 MB that holds every id's position."""
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("part")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).collect()
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows:
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. b's text is sent once per salted group, a's once per pair."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_PIVOT).alias("k"))
    p = pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("k"))).select("a", "b", "salt")
    ask = p.select("b", "salt").distinct().select(F.col("b").alias("doc_id"), "b", "salt", F.lit(0).alias("role")).unionByName(p.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("role")))
    bits = _wanted(ask)

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            use = np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1)
            text = batch.column(1).take(pa.array(use))
            off, data = column_bytes(text)
            raw = data.tobytes()
            yield pa.record_batch([batch.column(0).take(pa.array(use)), pa.array([c.compress(raw[x:y]) for x, y in zip(off[:-1], off[1:])], pa.binary())], names=["doc_id", "z"])

    small = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("at")).mapInArrow(squeeze, "doc_id long, z binary")

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of at most 256 texts or 1 MB of compressed ones (or one longer)."""
        end = np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + 256, max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + (1 << 20), side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        at, held = None, []  # the texts of the pivot that the rows belong to
        for batch in batches:
            for b in pieces(batch):
                texts = held + [d.decompress(z) for z in b.column(4).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                h, cut = exact_shingles(LOWER[np.frombuffer(b"".join(texts), np.uint8)], off, size)
                pivots, out = list(range(len(held))), []
                for i, (pivot, salt, role, doc) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4))), len(held)):
                    if (pivot, salt) != at:
                        at, pivots = (pivot, salt), []
                    if role == 0:
                        pivots.append(i)
                        continue
                    own = h[cut[i] : cut[i + 1]]
                    for k in pivots:
                        other = h[cut[k] : cut[k + 1]]
                        least, most = sorted((len(own), len(other)))
                        if 100 * least < percent * most:
                            continue
                        both = np.sort(np.concatenate([own, other]))
                        common = int((both[1:] == both[:-1]).sum())
                        if common and 100 * common >= percent * (least + most - common):
                            out.append((doc, pivot))
                            break
                held = [texts[k] for k in pivots]
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    sent = ask.join(small, "doc_id").select("b", "salt", "role", "doc_id", "z")
    return sent.repartition("b", "salt").sortWithinPartitions("b", "salt", "role").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, path: str, name: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node reachable."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), path, f"{name}0")
    seen = None
    for k in range(1, STEPS + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, path, f"{name}{k}large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, path, f"{name}{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges.sparkSession, path, f"{name}{k}large", f"{name}{k - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {STEPS} steps")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def across(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a key's rows (key, component, doc_id; g: how many) in different components whose sketches (doc_id, n_shingles, sketch, odd) don't rule out a link."""
    spread = 8.4 * (percent / 100 * (1 - percent / 100)) ** 0.5
    differ = (100 - percent) / (100 + percent)  # a linked pair differs in at most this share of n_a + n_b shingles

    def judged(i, j, comp, ids, n, r, odd):
        use = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
        i, j = i[use], j[use]
        for s in range(0, len(i), 1 << 12):
            x, y = i[s : s + (1 << 12)], j[s : s + (1 << 12)]
            # neither slots nor registers that differ can outnumber the differing shingles, at any size
            limit = differ * (n[x] + n[y]) + 1e-6
            use = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= limit
            x, y, limit = x[use], y[use], limit[use]
            j_hat, used, apart = estimate(r[x], r[y])
            ok = (j_hat >= percent / 100 - spread / np.sqrt(used)) & (apart <= limit)
            if ok.any():
                yield pa.record_batch([pa.array(f(ids[x[ok]], ids[y[ok]])) for f in (np.maximum, np.minimum)], names=["a", "b"])

    def within(own, *cols):
        """Pairs of one group, most of them refused by the folded slots of a block."""
        order = np.argsort(cols[2], kind="stable")  # rows of a cell's own class come first
        comp, ids, n, r, odd = (x[order] for x in cols)
        first = np.ascontiguousarray(np.bitwise_xor.reduce(odd.reshape(len(odd), FOLDS, -1), axis=1).T)
        most, top = int(own.sum()), np.searchsorted(n, 100 * n // percent, side="right")
        for lo in range(0, most, 64):
            hi = min(lo + 64, most)
            for at in range(lo, int(top[hi - 1]), 512):
                to = min(at + 512, int(top[hi - 1]))
                slots = np.zeros((hi - lo, to - at), dtype=np.uint16)
                for x in first:
                    slots += np.bitwise_count(x[lo:hi, None] ^ x[None, at:to])
                i, j = np.nonzero(slots <= differ * (n[lo:hi, None] + n[None, at:to]) + 1e-6)
                use = i + lo < j + at
                yield from judged(i[use] + lo, j[use] + at, comp, ids, n, r, odd)

    def small(start, end, own, *cols):
        """Pairs of all groups start[k]:end[k] at once."""
        i = np.arange(len(own))
        g = np.searchsorted(start, i, side="right") - 1
        last = np.where((g >= 0) & (i < end[g]), end[g], 0)
        for d in range(1, int((end - start).max(initial=0))):
            i = i[i + d < last[i]]
            use = own[i] | own[i + d]
            yield from judged(i[use], i[use] + d, *cols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # rows of the group that may go on

        def flush():
            if held:
                rows = [np.concatenate(x) for x in zip(*held)]
                held.clear()
                yield from within(*rows)

        for batch in batches:
            key, *cols = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            cols.append(np.frombuffer(column_bytes(batch.column(5))[1].tobytes(), np.uint32).reshape(-1, REGISTERS))
            cols.append(np.frombuffer(column_bytes(batch.column(6))[1].tobytes(), U64).reshape(-1, PARITIES // 64))
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            start, end = cuts[:-1], cuts[1:]
            # the first group may have begun before, and the last one may go on
            single = np.zeros(len(start), dtype=bool)
            single[1:-1] = (end - start <= SMALL)[1:-1]
            if single.any():
                yield from small(start[single], end[single], *cols)
            for x, y in zip(start[~single].tolist(), end[~single].tolist()):
                if x < y:
                    if key[x] != last:
                        yield from flush()
                        last = key[x]
                    held.append([c[x:y] for c in cols])
        yield from flush()

    # sizes that may be linked lie in one class or in neighbours: in a large group a cell holds a class and, not its own, the next
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    sizes = sketches.groupBy("doc_id").agg(F.explode(F.collect_set("n_shingles")).alias("n_shingles"))
    large = F.col("g") > PART
    level = F.floor(F.log("n_shingles") / width).cast("int")
    cells = F.when(large, F.array(F.struct(level.alias("cell"), F.lit(True).alias("own")), F.struct((level - 1).alias("cell"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("own"))))
    rows = groups.join(sizes, "doc_id").withColumn("at", F.explode(cells)).select("key", "at.cell", "at.own", "g", "component", "doc_id", "n_shingles")
    # a large cell's rows go to one of r parts, and every pair of parts to one task; there are at most 1 / PART as many such cells as rows
    size = rows.where(large).groupBy("key", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("r")).where("r > 1")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("r")).cast("int")
    both = F.explode(F.when(F.col("r").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda o: F.least(o, mine) * F.col("r") + F.greatest(o, mine))))
    tasks = rows.join(F.broadcast(size), ["key", "cell"], "left").withColumn("part", both).select(F.xxhash64("key", "cell", "part").alias("key"), "own", "component", "doc_id", "n_shingles")
    cols = tasks.join(sketches, ["doc_id", "n_shingles"]).select("key", "own", "component", "doc_id", "n_shingles", "sketch", "odd")
    return cols.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    path = shared_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(sketch(docs, shingle), path, "sketches")
    usable = sketches.where("sketch is not null and doc_id is not null")
    sets = usable.select("doc_id", "digest", "digest2")
    # of an id of several texts all sets are looked at
    single = sets.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.min("digest2").alias("digest2"), F.count_distinct("digest", "digest2").alias("k")).where("k = 1").drop("k")
    twins = single.groupBy("digest", "digest2").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b <> top").drop("top")
    same = written(single.join(twins, ["digest", "digest2"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"), path, "pairs0")
    copies = written(verify(same, docs, shingle, 100), path, "links0")
    bands = band_keys(usable.join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti"), percent)
    groups = bands.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b <> top").select("key", "b")
    grouped = written(bands.join(groups, "key").select("key", F.col("doc_id").alias("a"), "b"), path, "groups")
    first = grouped.where("a <> b").repartition("a").groupBy("a", "b").count().where(F.col("count") >= SHARED).groupBy("a").agg(F.min("b").alias("b"))
    links = written(verify(written(first, path, "pairs1"), docs, shingle, percent).unionByName(copies), path, "links1")
    dropped(docs.sparkSession, path)
    comp = components(links, path, "one")
    labelled = grouped.select("key", F.col("a").alias("node")).join(comp, "node", "left").select("key", F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("component"))
    labelled = written(labelled, path, "labelled")
    open_ = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("g")).where("x <> y").select("key", "g")
    left = labelled.join(open_, "key")
    pairs = written(across(left, usable.select("doc_id", "n_shingles", "sketch", "odd"), percent), path, "pairs2")
    more = written(verify(pairs, docs, shingle, percent), path, "links2")
    final = components(links.unionByName(more), path, "two")
    out = sketches.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)


__all__ = ["near_duplicates", "query"]
