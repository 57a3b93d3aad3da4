"""A catalog of collections and indices in a directory, over Parquet with a change log and snapshots.

A collection is a keyed table (internal_id, item_id, document, embedding,
metadata); an index is one without documents.  Every mutation is written to the
log as a table first (prepare) and counts from its commit marker on; a table is
the published snapshot with the committed operations after it, of which the last
per key holds.  Replay stops at the first operation that is damaged.  Metadata
values keep their kinds: a field has one column a kind, so comparisons are typed
and reach the scan.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hybrid, mutations
from .operators.filters import Condition, Filter, kind_of, tree_of
from .plans import valid_capacity, valid_dtype, valid_id_type, valid_index, valid_metric, valid_neighbours, valid_quantiser, valid_threads, valid_vectors
from .sources import opened

_TYPES = {"long": "bigint", "double": "double", "string": "string", "boolean": "boolean"}
_KEYS = ("internal_id", "item_id", "document", "embedding")


class Store:
    """Small files of a directory on any file system; writes are published by a rename."""

    def __init__(self, url: str):
        self.url = url.rstrip("/")
        self.fs, self.at = opened(self.url)

    def exists(self, name: str = "") -> bool:
        return self.fs.get_file_info(f"{self.at}/{name}").type != fs.FileType.NotFound

    def read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.at}/{name}") as f:
            return json.loads(f.read())

    def write(self, name: str, value: dict) -> None:
        path = f"{self.at}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(tmp) as f:
            f.write(json.dumps(value, indent=1).encode())
        self.fs.move(tmp, path)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(f"{self.at}/{name}".rstrip("/"))))

    def drop(self, name: str = "") -> None:
        path = f"{self.at}/{name}".rstrip("/")
        kind = self.fs.get_file_info(path).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(path)
        elif kind == fs.FileType.File:
            self.fs.delete_file(path)


@dataclass
class Params:
    """Validated parameters; unknown names raise ValueError, missing ones take the defaults."""

    index_type: str = "hnsw"
    data_type: str = "float32"
    id_type: str = "uint32"
    quantization_type: str = "none"
    metric: str = "l2"
    capacity: int = 100_000
    max_nbrs: int = 32
    indexed_fields: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.index_type, self.data_type, self.id_type = valid_index(self.index_type), valid_dtype(self.data_type), valid_id_type(self.id_type)
        self.quantization_type, self.metric = valid_quantiser(self.quantization_type), valid_metric(self.metric)
        valid_capacity(self.capacity)
        valid_neighbours(self.max_nbrs)
        if self.quantization_type == "rabitq" and self.id_type != "uint32":
            raise ValueError("rabitq needs uint32 ids")
        if self.quantization_type != "none" and self.data_type != "float32":
            raise ValueError("quantization needs float32")

    @classmethod
    def from_kwargs(cls, **kw) -> "Params":
        known = {f.name for f in fields(cls)}
        if bad := set(kw) - known:
            raise ValueError(f"Unknown parameters: {sorted(bad)}")
        return cls(**kw)

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, d: dict) -> "Params":
        return cls(**{f.name: d[f.name] for f in fields(cls) if f.name in d})


class Collection:
    """A keyed table with vectors, documents and metadata."""

    def __init__(self, spark: SparkSession, url: str, params: Params | None = None, kind: str = "collection"):
        self.spark, self.store, self.kind = spark, Store(url), kind
        if self.store.exists("schema.json"):
            d = self.store.read("schema.json")
            self.params, self.dim = Params.from_json(d["params"]), d.get("dim")
            self.kinds: dict[str, list[str]] = d.get("kinds", {})
        else:
            self.params, self.dim, self.kinds = params or Params(), None, {}
        self.closed = False

    # state
    def _schema(self) -> None:
        self.store.write("schema.json", {"type": self.kind, "params": self.params.to_json(), "dim": self.dim, "kinds": self.kinds})

    def _current(self) -> dict:
        return self.store.read("current.json") if self.store.exists("current.json") else {"snapshot": 0, "applied": 0, "next_id": 0}

    def _columns(self) -> list[tuple[str, str]]:
        return [("internal_id", "bigint"), ("item_id", "string"), ("document", "string"), ("embedding", "array<double>")] + [(f"{f}__{k}", _TYPES[k]) for f in sorted(self.kinds) for k in self.kinds[f]]

    def _aligned(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in self._columns()])

    def committed(self) -> list[dict]:
        """Commit markers after the snapshot, in order, up to the first gap or damage."""
        applied, out = self._current()["applied"], []
        marks = {int(n.split(".")[0]): n for n in self.store.names("log") if n.endswith(".commit")}
        for op in sorted(marks):
            if op <= applied:
                continue
            try:
                mark = self.store.read(f"log/{marks[op]}")
                if self.spark.read.parquet(f"{self.store.url}/log/{op}").count() != mark["rows"]:
                    break
            except Exception:  # noqa: BLE001 - whatever makes a log unreadable ends the replay
                break
            out.append(mark)
        return out

    def table(self) -> DataFrame:
        """The live rows, with one column a metadata field and kind."""
        now = self._current()
        base = self._aligned(self.spark.read.parquet(f"{self.store.url}/snapshots/{now['snapshot']}")) if now["snapshot"] else self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in self._columns()))
        marks = self.committed()
        if not marks:
            return base
        log = None
        for m in marks:
            op = self._aligned(self.spark.read.parquet(f"{self.store.url}/log/{m['op_id']}")).withColumn("op", F.lit(m["op"])).withColumn("op_id", F.lit(m["op_id"]).cast("long"))
            log = op if log is None else log.unionByName(op)
        # rows without a key are never replaced
        keyed, free = log.where(F.coalesce("item_id", F.lit("")) != ""), log.where((F.coalesce("item_id", F.lit("")) == "") & (F.col("op") != "delete")).drop("op", "op_id")
        return mutations.replay(base, keyed, "item_id").select(*base.columns).unionByName(free.select(*base.columns))

    def _append(self, op: str, rows: DataFrame, next_id: int | None = None) -> int:
        """Prepare, then commit: the operation's number."""
        marks = [int(n.split(".")[0]) for n in self.store.names("log") if n.split(".")[0].isdigit()]
        number = max([self._current()["applied"], *marks]) + 1
        path = f"{self.store.url}/log/{number}"
        rows.write.mode("overwrite").parquet(path)
        self.store.write(f"log/{number}.commit", {"op_id": number, "op": op, "rows": self.spark.read.parquet(path).count(), "next_id": self._next_id() if next_id is None else next_id})
        return number

    def _numbered(self, op: str, rows: DataFrame, start: int, n: int) -> None:
        """Append rows with internal ids from `start` in the order of `pos`; n ids are used up."""
        name = f"sorted-{uuid.uuid4().hex}"
        self._append(op, self._aligned(mutations.numbered(rows, ["pos"], f"{self.store.url}/{name}", "internal_id", start)), start + n)
        self.store.drop(name)

    def _next_id(self) -> int:
        marks = self.committed()
        return max([self._current()["next_id"], *(m["next_id"] for m in marks)])

    # rows of a call
    def _rows(self, items) -> tuple[DataFrame, int]:
        """Items, (id, document, embedding, metadata) tuples or a DataFrame of these columns, as aligned rows."""
        if isinstance(items, DataFrame):
            meta = [(c, dict(items.dtypes)[c]) for c in items.columns if c not in ("item_id", "document", "embedding", "metadata", "pos")]
            kind = {t: k for k, t in _TYPES.items()} | {"int": "long", "smallint": "long", "float": "double"}
            for c, t in meta:
                if t in kind and kind[t] not in self.kinds.setdefault(c, []):
                    self.kinds[c].append(kind[t])
            df = items.select(F.col("item_id").cast("string"), F.col("document").cast("string"), F.col("embedding").cast("array<double>"), *[F.col(f"`{c}`").cast(_TYPES[kind[t]]).alias(f"{c}__{kind[t]}") for c, t in meta if t in kind], F.col("pos") if "pos" in items.columns else F.monotonically_increasing_id().alias("pos"))
            first = df.select(F.size("embedding").alias("d")).groupBy("d").count().limit(2).collect()
            if len(first) > 1 or first and self.dim not in (None, first[0]["d"]):
                raise ValueError(f"Vector dimension mismatch: expected {self.dim}")
            self.dim = first[0]["d"] if first else self.dim
            return df, df.count()
        items = list(items)
        if not items:
            raise ValueError("items must not be empty")
        vectors = valid_vectors([x[2] for x in items], self.dim)
        self.dim = len(vectors[0])
        data = []
        for pos, (x, v) in enumerate(zip(items, vectors)):
            row = {"item_id": str(x[0]), "document": x[1], "embedding": v, "pos": pos}
            for name, value in (x[3] or {}).items():
                if isinstance(value, (bool, int, float, str)):  # other kinds are dropped
                    k = kind_of(value)
                    if k not in self.kinds.setdefault(name, []):
                        self.kinds[name].append(k)
                    row[f"{name}__{k}"] = value
            data.append(row)
        schema = ", ".join(f"`{n}` {t}" for n, t in self._columns() if n != "internal_id") + ", pos long"
        names = [n for n, _ in self._columns() if n != "internal_id"] + ["pos"]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schema), len(data)

    def insert(self, items) -> int:
        """Append; an id that repeats or exists raises ValueError and changes nothing."""
        rows, n = self._rows(items)
        now, start = self.table(), self._next_id()
        if start + n > self.params.capacity:
            raise RuntimeError("The index is full")
        clash = mutations.repeated_keys(rows, "item_id").unionByName(rows.where("item_id <> ''").join(now, "item_id", "left_semi").select("item_id")).limit(1).collect()
        if clash:
            raise ValueError(f"Duplicate item_id: {clash[0][0]}")
        self._schema()
        self._numbered("upsert", rows, start, n)
        return n

    def upsert(self, items) -> int:
        """Replace or append; the last of repeated ids counts, and rows get new internal ids."""
        rows, n = self._rows(items)
        start = self._next_id()
        self._schema()
        self._numbered("upsert", mutations.last_of(rows.withColumn("_o", F.col("pos")), "item_id", "_o"), start, n)
        return n

    def delete_by_id(self, ids: list | DataFrame) -> None:
        """Ids in a list, or a table's item_id; unknown ones are skipped."""
        keys = ids.select(F.col("item_id").cast("string")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "item_id string")
        self._append("delete", self._aligned(keys.join(self.table().select("item_id"), "item_id", "left_semi").distinct()))

    def delete_by_filter(self, spec: dict | Filter) -> int:
        gone = self.matching(spec).select("item_id")
        op = self._append("delete", self._aligned(gone))
        return self.store.read(f"log/{op}.commit")["rows"]

    def remove(self, internal_id: int) -> None:
        """Delete by internal id."""
        self._append("delete", self._aligned(self.table().where(F.col("internal_id") == internal_id).select("item_id")))

    # queries
    def _condition(self, c: Condition) -> Column:
        """Typed over the field's columns; plain comparisons where one kind decides."""
        have = self.kinds.get(c.name, [])
        if not have:
            return F.lit(False)
        if c.op in ("ne", "not_in"):
            there = F.lit(False)
            for k in have:
                there = there | F.col(f"`{c.name}__{k}`").isNotNull()
            same = Condition(c.name, "eq" if c.op == "ne" else "in", c.value)
            return there & ~F.coalesce(self._condition(same), F.lit(False))
        values = c.value if c.op == "in" else [c.value]
        out = F.lit(False)
        for k in sorted({kind_of(v) for v in values} & set(have)):
            mine = [v for v in values if kind_of(v) == k]
            out_k = Condition(c.name, c.op, mine if c.op == "in" else mine[0]).bare({c.name: (F.col(f"`{c.name}__{k}`"), k)})
            out = out_k if len(have) == 1 or len(values) == 1 else out | out_k
        return out

    def _tree(self, f: Filter, top: bool = True) -> Column:
        parts = [self._condition(c) for c in f.conditions] + [self._tree(x, top and f.logic != "not") for x in f.filters]
        if not parts:
            return F.lit(True)
        if f.logic == "not":
            return ~F.coalesce(parts[0], F.lit(False))
        out = parts[0]
        for p in parts[1:]:
            out = out & p if f.logic == "and" else out | p
        return out

    def matching(self, spec: dict | Filter | None) -> DataFrame:
        return self.table().where(self._tree(tree_of(spec)))

    def filter_query(self, spec: dict | Filter | None, limit: int = 100) -> DataFrame:
        """Matching rows in the order of their internal ids."""
        if limit <= 0:
            raise ValueError("limit must be positive")
        return self.matching(spec).orderBy("internal_id").limit(limit)

    def get_by_id(self, ids: list) -> DataFrame:
        """Rows in the order of the request; repeats repeat, misses are skipped."""
        return mutations.get_by_key(self.table(), [str(i) for i in ids], "item_id")

    def contains(self, item_id) -> bool:
        return mutations.contains_key(self.table(), str(item_id), "item_id")

    def vector_of(self, item_id) -> list[float] | None:
        r = self.table().where(F.col("item_id") == str(item_id)).select("embedding").first()
        return r[0] if r else None

    def count(self) -> int:
        return self.table().count()

    def _queries(self, vectors) -> DataFrame:
        q = valid_vectors(vectors, self.dim, self.params.metric)
        return self.spark.createDataFrame(list(enumerate(q)), "qid long, qv array<double>")

    def hybrid_query(self, vectors, limit: int = 10, metadata_filter: dict | Filter | None = None, hint: str | None = None, num_threads: int = 1) -> DataFrame:
        """(qid, item_id, rk) of the nearest matching rows."""
        valid_threads(num_threads)
        rows = self.matching(metadata_filter).select(F.col("internal_id").alias("id"), F.col("embedding").alias("v"), "item_id")
        from .plans import normalize_hint

        normalize_hint(hint)
        hits = hybrid.hybrid_search(rows.select("id", "v"), self._queries(vectors), limit, None, self.params.metric)
        return hits.join(rows.select("id", "item_id"), "id").select("qid", "item_id", "rk")

    def batch_query(self, vectors, limit: int = 10, ef_search: int = 100, num_threads: int = 1) -> DataFrame:
        """(qid, item_id, document, distance, rk and metadata columns) of the nearest rows."""
        valid_threads(num_threads)
        if ef_search < limit:
            raise ValueError("ef_search must be at least the limit")
        rows = self.table()
        hits = hybrid.hybrid_search(rows.select(F.col("internal_id").alias("id"), F.col("embedding").alias("v")), self._queries(vectors), limit, None, self.params.metric)
        return hits.withColumnRenamed("id", "internal_id").join(rows.drop("embedding"), "internal_id").withColumnRenamed("dist", "distance")

    # durability
    def save(self) -> int:
        """Publish a snapshot of the live rows; logs that it holds and older snapshots go."""
        now, marks = self._current(), self.committed()
        number = now["snapshot"] + 1
        self.table().repartitionByRange(F.col("internal_id")).write.mode("overwrite").parquet(f"{self.store.url}/snapshots/{number}")
        applied = max([now["applied"], *(m["op_id"] for m in marks)])
        self._schema()
        self.store.write("current.json", {"snapshot": number, "applied": applied, "next_id": self._next_id()})
        for n in self.store.names("snapshots"):
            if n.isdigit() and int(n) != number:
                self.store.drop(f"snapshots/{n}")
        for n in self.store.names("log"):
            if n.split(".")[0].isdigit() and int(n.split(".")[0]) <= applied:
                self.store.drop(f"log/{n}")
        return number

    def reindex(self) -> None:
        """Rewrite the live rows with fresh dense ids, in their order."""
        name = f"sorted-{uuid.uuid4().hex}"
        rows = mutations.numbered(self.table().withColumnRenamed("internal_id", "_old"), ["_old"], f"{self.store.url}/{name}", "internal_id")
        number, n = self._current()["snapshot"] + 1, self.count()
        self._aligned(rows).write.mode("overwrite").parquet(f"{self.store.url}/snapshots/{number}")
        applied = max([self._current()["applied"], *(m["op_id"] for m in self.committed())])
        self.store.write("current.json", {"snapshot": number, "applied": applied, "next_id": n})
        self.store.drop(name)

    def set_metric(self, metric: str) -> None:
        if self.dim is not None:
            raise RuntimeError("the metric is fixed by the first insert")
        self.params.metric = valid_metric(metric)
        self._schema()

    def close(self) -> None:
        self.closed = True


class Index(Collection):
    """A bare vector set; a row's position is its id."""

    def __init__(self, spark: SparkSession, url: str, params: Params | None = None):
        super().__init__(spark, url, params, "index")

    def fit(self, vectors) -> int:
        if self.dim is not None:
            raise RuntimeError("fit may be called once")
        return self.insert([(i, None, v, None) for i, v in enumerate(valid_vectors(vectors, None))])

    def add(self, vector) -> int:
        """Append one vector; its id."""
        n = self._next_id()
        self.insert([(n, None, vector, None)])
        return n

    def search(self, query, topk: int = 10) -> list[tuple[int, float]]:
        return [(r["id"], r["dist"]) for r in self.batch_search([query], topk).orderBy("rk").collect()]

    def batch_search(self, queries, topk: int = 10) -> DataFrame:
        return hybrid.hybrid_search(self.table().select(F.col("internal_id").alias("id"), F.col("embedding").alias("v")), self._queries(queries), topk, None, self.params.metric)


class Client:
    """Collections and indices by name in a directory; names are shared by both kinds."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.store = spark, Store(url)
        self.store.fs.create_dir(self.store.at, recursive=True)
        self.held: dict[str, Collection] = {}
        for n in self.store.names():
            if self.store.exists(f"{n}/schema.json"):  # other directories are skipped
                kind = self.store.read(f"{n}/schema.json")["type"]
                self.held[n] = (Index if kind == "index" else Collection)(spark, f"{self.store.url}/{n}")

    def _list(self, kind: str) -> list[str]:
        return [n for n, c in self.held.items() if c.kind == kind]

    def list_collections(self) -> list[str]:
        return self._list("collection")

    def list_indices(self) -> list[str]:
        return self._list("index")

    def _get(self, name: str, kind: str) -> Any:
        c = self.held.get(name)
        return c if c is not None and c.kind == kind else None

    def get_collection(self, name: str = "default") -> Collection | None:
        return self._get(name, "collection")

    def get_index(self, name: str = "default") -> Index | None:
        return self._get(name, "index")

    def _create(self, name: str, make, **kw):
        if name in self.held:
            raise RuntimeError(f"{name} already exists")
        self.held[name] = make(self.spark, f"{self.store.url}/{name}", Params.from_kwargs(**kw))
        return self.held[name]

    def create_collection(self, name: str = "default", **kw) -> Collection:
        return self._create(name, Collection, **kw)

    def create_index(self, name: str = "default", **kw) -> Index:
        return self._create(name, Index, **kw)

    def get_or_create_collection(self, name: str = "default", **kw) -> Collection:
        return self.get_collection(name) or self.create_collection(name, **kw)

    def get_or_create_index(self, name: str = "default", **kw) -> Index:
        return self.get_index(name) or self.create_index(name, **kw)

    def _drop(self, name: str, kind: str, on_disk: bool) -> None:
        if self._get(name, kind) is None:
            raise RuntimeError(f"{name} does not exist")
        del self.held[name]
        if on_disk:
            self.store.drop(name)

    def delete_collection(self, name: str, delete_on_disk: bool = False) -> None:
        self._drop(name, "collection", delete_on_disk)

    def delete_index(self, name: str, delete_on_disk: bool = False) -> None:
        self._drop(name, "index", delete_on_disk)

    def reset(self, delete_on_disk: bool = False) -> None:
        for n, c in list(self.held.items()):
            self._drop(n, c.kind, delete_on_disk)

    def save_collection(self, name: str) -> None:
        if (c := self.get_collection(name)) is None:
            raise RuntimeError(f"{name} does not exist")
        c.save()

    def save_index(self, name: str) -> None:
        if (c := self.get_index(name)) is None:
            raise RuntimeError(f"{name} does not exist")
        c.save()
