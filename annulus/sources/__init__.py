"""Binary vector files: one-dimension-per-row (fvecs, ivecs, bvecs) and header (fbin, ibin) formats, read and written by byte ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = {"fvecs": np.float32, "ivecs": np.int32, "bvecs": np.uint8}
_HEAD = {"fbin": np.float32, "ibin": np.int32}
RANGE_BYTES = 16 << 20  # of a file that one task reads


def decode(raw: bytes, kind: str) -> np.ndarray:
    """Matrix of one file's rows; a truncated file raises ValueError."""
    if kind in _HEAD:
        n, d = np.frombuffer(raw, np.int32, 2)
        x = np.frombuffer(raw, _HEAD[kind], offset=8)
        if len(x) != int(n) * int(d):
            raise ValueError("file size doesn't match its header")
        return x.reshape(n, d)
    t = np.dtype(_ROW[kind])
    if not raw:
        return np.zeros((0, 0), t)
    d = int(np.frombuffer(raw, np.int32, 1)[0])
    width = 4 + d * t.itemsize
    if d <= 0 or len(raw) % width:
        raise ValueError("file size doesn't match its rows")
    return np.frombuffer(raw, np.uint8).reshape(-1, width)[:, 4:].copy().view(t)


def encode(x: np.ndarray, kind: str) -> bytes:
    if kind in _HEAD:
        return np.array(x.shape, np.int32).tobytes() + np.ascontiguousarray(x, _HEAD[kind]).tobytes()
    x = np.ascontiguousarray(x, _ROW[kind])
    d = np.full((len(x), 1), x.shape[1], np.int32).view(np.uint8)
    return np.concatenate([d, x.view(np.uint8).reshape(len(x), -1)], axis=1).tobytes()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder inside spark.checkpoint.dir; only local sessions without the setting get a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="annulus-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/annulus-{uuid.uuid4().hex}"


def header(path: str, kind: str) -> tuple[int, int, int, int]:
    """Rows, dimension, bytes before the rows and bytes a row; checked against the file's size."""
    store, at = opened(path)
    size = store.get_file_info(at).size
    with store.open_input_file(at) as f:
        head = np.frombuffer(f.read_at(min(8, size), 0), np.int32)
    if kind in _HEAD:
        if len(head) < 2 or size != 8 + int(head[0]) * int(head[1]) * 4:
            raise ValueError("file size doesn't match its header")
        return int(head[0]), int(head[1]), 8, int(head[1]) * 4
    if size == 0:
        return 0, 0, 0, 4
    width = 4 + int(head[0]) * np.dtype(_ROW[kind]).itemsize
    if head[0] <= 0 or size % width:
        raise ValueError("file size doesn't match its rows")
    return size // width, int(head[0]), 0, width


def files_of(path: str, kind: str) -> list[str]:
    store, at = opened(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.type == fs.FileType.File and x.base_name.endswith(f".{kind}")]


def read_vectors(spark: SparkSession, path: str, kind: str, start: int = 0, count: int | None = None) -> DataFrame:
    """(path, pos, v) of the rows start..start+count of each file at path; tasks read byte ranges, so files of any size are split."""
    element, ranges = "float" if kind in ("fvecs", "fbin") else "int", []
    for p in files_of(path, kind):
        n, d, skip, width = header(p, kind)
        end = n if count is None else min(n, start + count)
        step = max(1, RANGE_BYTES // width)
        ranges += [(p, a, min(a + step, end), d, skip, width) for a in range(start, end, step)]
    schema = f"path string, pos long, v array<{element}>"
    if not ranges:
        return spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, a, b, d, skip, width in zip(*(batch.column(k).to_pylist() for k in range(6))):
                store, at = opened(p)
                with store.open_input_file(at) as f:
                    raw = f.read_at((b - a) * width, skip + a * width)
                x = np.frombuffer(raw, _HEAD[kind]).reshape(-1, d) if kind in _HEAD else decode(raw, kind)
                for lo in range(0, len(x), 8192):
                    part = x[lo : lo + 8192]
                    off = pa.array(np.arange(len(part) + 1) * d, pa.int32())
                    values = pa.array(part.ravel(), pa.float32() if element == "float" else pa.int32())
                    yield pa.record_batch([pa.array([p] * len(part)), pa.array(np.arange(a + lo, a + lo + len(part))), pa.ListArray.from_arrays(off, values)], names=["path", "pos", "v"])

    table = spark.createDataFrame(ranges, "path string, a long, b long, d long, skip long, width long")
    return table.repartition(min(len(ranges), 10_000)).mapInArrow(run, schema)


def write_vectors(rows: DataFrame, path: str, kind: str, order: str = "id", v: str = "v") -> int:
    """Rows sorted by `order` as files part-00000.kind, ... of one range partition each; the number of rows."""
    store, at = opened(path)
    store.create_dir(at, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            x, (to, base) = np.concatenate(parts), opened(path)
            name = f"{base}/part-{TaskContext.get().partitionId():05d}"
            with to.open_output_stream(f"{name}.tmp") as f:
                f.write(encode(x, kind))
            to.move(f"{name}.tmp", f"{name}.{kind}")  # a retried task writes the same file again
            yield pa.record_batch([pa.array([len(x)], pa.int64())], names=["n"])

    sized = rows.repartitionByRange(order).sortWithinPartitions(order).select(v)
    return sized.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, v): standard normal vectors, the same for a seed whatever the partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = [np.random.default_rng((seed, i)).standard_normal(dim) for i in ids]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "v"])

    return spark.range(n).mapInArrow(run, "id long, v array<double>")


def load_synthetic(spark: SparkSession, n: int, dim: int, queries: int, seed: int = 0, metric: str = "l2", k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, queries (qid, qv) and the exact k nearest of each query."""
    from ..operators.search import batch_search

    rows = synthetic(spark, n, dim, seed)
    q = synthetic(spark, queries, dim, seed + 1).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    return rows, q, batch_search(rows, q, k, metric)
