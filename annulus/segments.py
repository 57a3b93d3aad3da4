"""Append-only collections of immutable segments: buffered batches, atomic manifests, one writer, exact merged search."""

from __future__ import annotations

import fcntl
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Store
from .operators.hybrid import padded
from .operators.search import batch_search
from .plans import valid_metric


class SegmentedCollection:
    """Rows (label, v) in segments; the manifest lists what counts, other directories are orphans."""

    def __init__(self, spark: SparkSession, url: str, dim: int | None = None, metric: str = "l2", buffer_bytes: int = 512 << 20):
        self.spark, self.store, self.most = spark, Store(url), buffer_bytes
        self.pending: list[DataFrame] = []
        self.held = 0
        self._lock = None
        if self.store.exists("manifest.json"):
            m = self.store.read("manifest.json")
            self.dim, self.metric, self.segments = m["dim"], m["metric"], m["segments"]
        else:
            if dim is None:
                raise ValueError("a new collection needs a dimension")
            self.dim, self.metric, self.segments = dim, valid_metric(metric), []
            self._publish()

    def lock(self) -> None:
        """One writer at a time, on file systems that the driver can lock."""
        if self.store.fs.type_name == "local" and self._lock is None:
            f = open(f"{self.store.at}/.lock", "w")  # noqa: SIM115
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                f.close()
                raise RuntimeError("the collection is open for writing elsewhere") from None
            f.write(str(os.getpid()))
            self._lock = f

    def close(self) -> None:
        if self._lock is not None:
            self._lock.close()
            self._lock = None

    def _publish(self) -> None:
        self.store.write("manifest.json", {"dim": self.dim, "metric": self.metric, "segments": self.segments})

    def orphans(self) -> list[str]:
        known = {s["name"] for s in self.segments}
        return [n for n in self.store.names("segments") if n not in known]

    def add_batch(self, rows: DataFrame) -> int:
        """Buffer rows; wrong dimensions, components that aren't finite, and zero vectors under cosine raise ValueError, as does a full buffer."""
        self.lock()
        rows = rows.select(F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
        odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        zero = F.forall("v", lambda x: x == 0) if self.metric == "cos" else F.lit(False)
        bad = rows.where(F.col("v").isNull() | (F.size("v") != self.dim) | odd | zero).select("label").limit(1).collect()
        if bad:
            raise ValueError(f"invalid vector of label {bad[0][0]}")
        n = rows.count()
        if self.held + n * self.dim * 8 > self.most:
            raise ValueError("the buffer is full: flush first")
        self.pending.append(rows)
        self.held += n * self.dim * 8
        return n

    def flush(self) -> str | None:
        """Write the pending rows as a segment; a label that repeats or exists raises ValueError and leaves all as it was."""
        if not self.pending:
            return None
        rows = self.pending[0]
        for r in self.pending[1:]:
            rows = rows.unionByName(r)
        clash = rows.groupBy("label").count().where("count > 1").select("label")
        if self.segments:
            clash = clash.unionByName(rows.join(self.table(), "label", "left_semi").select("label"))
        if found := clash.limit(1).collect():
            raise ValueError(f"Duplicate label: {found[0][0]}")
        name = f"{len(self.segments):08d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.store.url}/segments/{name}"
        rows.write.parquet(path)
        self.segments.append({"name": name, "rows": self.spark.read.parquet(path).count(), "engine": "flat"})
        self._publish()
        self.pending, self.held = [], 0
        return name

    def import_segment(self, path: str, copy: bool = True) -> str:
        """Take a Parquet directory of (label, v) as a segment."""
        if not copy:
            raise NotImplementedError("segments are copied")
        self.add_batch(self.spark.read.parquet(path))
        return self.flush()

    def table(self) -> DataFrame:
        paths = [f"{self.store.url}/segments/{s['name']}" for s in self.segments]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], "label long, v array<double>")

    def size(self) -> int:
        return sum(s["rows"] for s in self.segments)

    def batch_search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist, rk) over all segments, by (dist, label)."""
        return batch_search(self.table().withColumnRenamed("label", "id"), queries, k, self.metric)

    def batch_search_padded(self, queries: DataFrame, k: int) -> DataFrame:
        return padded(self.batch_search(queries, k), queries, k)

    def delete(self, labels: list[int]) -> None:
        """Batch delete: unknown labels raise KeyError and nothing changes; else the segments are rewritten without them."""
        ask = self.spark.createDataFrame([(int(x),) for x in labels], "label long")
        missing = ask.join(self.table(), "label", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(missing[0][0])
        self.lock()
        name = f"{len(self.segments):08d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.store.url}/segments/{name}"
        self.table().join(F.broadcast(ask), "label", "left_anti").write.parquet(path)
        old, self.segments = self.segments, [{"name": name, "rows": self.spark.read.parquet(path).count(), "engine": "flat"}]
        self._publish()
        for s in old:
            self.store.drop(f"segments/{s['name']}")
