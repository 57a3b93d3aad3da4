"""Block tables and exchanges of packed arrays.

Documents are written once as blocks of about ``BLOCK_BYTES`` of text (one
compressed binary value per row) into the shared folder, partitioned and
bucketed by block: later joins of replies to their block move the replies only.
Every step is a map over blocks, an exchange of ``(key, block, payload)`` rows
whose payloads are packed arrays, or such a join.  Blocks pre-aggregate before
they send, so a key that holds a third of all rows reaches its bucket at most
once per block, and the written tables survive the loss of executors.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_dir  # noqa: F401 - for the operators
from ._text import Texts, slices

BLOCK_BYTES = 2 << 20
MOST_TASKS = 8192  # tasks of an exchange; beyond, a task takes several buckets one after another
ROWS = "key long, block long, kind int, payload binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])


def written(df: DataFrame, path: str, name: str, compression: str = "zstd") -> DataFrame:
    """Write the rows below path and read them back: cuts lineage in the shared folder."""
    at = f"{path}/{name}"
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, path: str, name: str, n: int) -> DataFrame:
    """Write rows that are hash-partitioned by block into n buckets, one file each; joins on block then leave them in place."""
    spark, table = df.sparkSession, f"annulus_{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").option("path", f"{path}/{name}").format("parquet").bucketBy(n, "block").sortBy("block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # an external table's files stay, and the plan knows them
    return out


def dropped(spark: SparkSession, path: str, *names: str) -> None:
    """Delete written tables that no later step reads, and let Spark's cleaner remove the shuffle files of finished steps."""
    jvm = spark.sparkContext._jvm
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; unpack returns them with their types."""
    parts = [np.int64(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), np.int64(a.size).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(n):
        kind = np.dtype(raw[at : at + 8].strip().decode())
        size = int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(raw, kind, size, at + 16))
        at += 16 + size * kind.itemsize
    return out


def planes(x: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of 64-bit numbers, byte by byte: what compresses well of sorted or small ones."""
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).ravel()


def from_planes(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), dtype=np.uint8)
    out[:, :size] = x.reshape(size, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers that aren't negative, in the least unsigned type that holds them: cheaper than planes for short arrays."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def pack_texts(t: Texts) -> bytes:
    return pack(t.ids, t.null.astype(np.uint8), np.diff(t.off), t.data)


def unpack_texts(blob: bytes) -> Texts:
    ids, null, size, data = unpack(blob)
    return Texts(ids, null.astype(bool), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), data)


def joined_texts(held: list[Texts]) -> Texts:
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t.off) for t in held]))]).astype(np.int64)
    return Texts(np.concatenate([t.ids for t in held]), np.concatenate([t.null for t in held]), off, np.concatenate([t.data for t in held]))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def write_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", make: Callable[[Texts], bytes] = pack_texts, times: int = 1, tasks: Callable[[int], int] | None = None) -> tuple[DataFrame, int, int]:
    """The documents as bucketed rows (block, payload), payload = make(Texts); the number of blocks, about, and the bytes of text. times: blocks are so many times BLOCK_BYTES; tasks: number of blocks to that of partitions, else parts."""
    limit = times * BLOCK_BYTES

    def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[Texts] = []
        size = 0

        def flush():
            nonlocal held, size, n
            row = pa.record_batch([pa.array([base + n], pa.int64()), pa.array([make(joined_texts(held))], pa.binary())], names=["block", "payload"])
            held, size, n = [], 0, n + 1
            return row

        for batch in batches:
            for t, _, _ in slices(batch, "id", "text", limit):
                if size and size + len(t.data) > limit:
                    yield flush()
                held.append(t)
                size += len(t.data)
        if held:
            yield flush()

    n_bytes = text_bytes(docs, text_col)
    n_blocks = max(1, -(-n_bytes // limit))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = (tasks or parts)(n_blocks)
    return bucketed(src.mapInArrow(to_blocks, "block long, payload binary").repartition(n, "block"), path, "blocks", n), n_blocks, n_bytes


def rows_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    k, b, t, p = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32()), pa.array(p, pa.binary())], schema=_SCHEMA)


def map_blocks(blocks: DataFrame, fn: Callable[..., Iterable[tuple[int, int, int, bytes]]], columns: tuple[str, ...] = ("payload",)) -> DataFrame:
    """Rows (key, block, kind, payload) that fn(block, *columns) gives for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if out := list(fn(*(c[i].as_py() for c in batch.columns))):
                    yield rows_batch(out)

    return blocks.select("block", *columns).mapInArrow(run, ROWS)


def reduce_buckets(rows: DataFrame, n: int, fn: Callable[[int, list[tuple[int, int, bytes]]], Iterable[tuple[int, int, int, bytes]]]) -> DataFrame:
    """fn gets each key 0..n-1 with all its (block, kind, payload), sorted; a task takes its keys one after another."""
    tasks = min(n, MOST_TASKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != at:
                    if held:
                        yield rows_batch(list(fn(at, held)))
                    at, held = key, []
                held.append(tuple(row))
        if held:
            yield rows_batch(list(fn(at, held)))

    return rows.repartitionById(tasks, (F.col("key") % tasks).cast("int")).sortWithinPartitions("key", "block", "kind").select("key", "block", "kind", "payload").mapInArrow(run, ROWS)


def join_blocks(blocks: DataFrame, replies: list[DataFrame], fn: Callable[..., Iterable[pa.RecordBatch]], schema: str, columns: tuple[str, ...] = ("payload",)) -> DataFrame:
    """fn(block, *columns, replies) gets each block with the (kind, key, payload) replies sent to it; record batches of the schema come out. Only the replies move."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(right.column("kind").to_pylist(), right.column("key").to_pylist(), right.column("payload").to_pylist()), key=lambda r: r[:2])
        out = [b for row in zip(*(left.column(c).to_pylist() for c in ("block", *columns))) for b in fn(*row, got)]
        return pa.Table.from_batches(out) if out else empty.empty_table()

    got = replies[0].select("key", "block", "kind", "payload")
    for r in replies[1:]:
        got = got.unionByName(r.select("key", "block", "kind", "payload"))
    return blocks.select("block", *columns).groupBy("block").cogroup(got.groupBy("block")).applyInArrow(run, schema)


def parts(n_blocks: int, per: int = 4) -> int:
    """Partitions that hold about per blocks each."""
    return max(1, min(n_blocks, 12), -(-n_blocks // per))


def halving_parts(n_blocks: int) -> int:
    """parts, or a few more, so that halves of it down to 12 to 24 are whole numbers."""
    n = parts(n_blocks)
    step = 1 << max(0, (n // 12).bit_length() - 1)
    return -(-n // step) * step


class Buckets:
    """Elements by their bucket: only buckets that occur are visited, however many there are."""

    def __init__(self, key: np.ndarray):
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]])) if len(self.keys) else np.zeros(0, dtype=np.int64)
        for a, b in zip(first.tolist(), np.append(first[1:], len(self.keys)).tolist()):
            yield int(self.keys[a]), self.order[a:b]

    def of(self, bucket: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, [bucket, bucket + 1])
        return self.order[a:b]
