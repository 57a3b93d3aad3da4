"""Registered queries of the vector engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cosine_distance, dot, l2_squared, normalize, pack_nibbles, sortable_hex
from .operators import chunkers, hybrid, index, mutations, search, statistics
from .operators.filters import Condition, Filter, matching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# lengths differ (the table's vectors are unit vectors), so that metrics rank differently
_V = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 7)) AS v FROM embeddings"
_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("v"))


def first_queries(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.where(F.col("id") < n).select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def stated_queries(rows: DataFrame) -> DataFrame:
    """The whole query set of a search: every row whose id is divisible by 50."""
    return rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _knn_sql(dist: str, where: str = "true", k: int = 10, extra: str = "") -> str:
    return f"""WITH v AS ({_V}), d AS (SELECT q.id AS qid, r.id, {dist.format(a='r.v', b='q.v')} AS dist{extra} FROM v r, v q WHERE q.id < 10 AND ({where})),
    t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rk FROM d) SELECT qid, id, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS rk FROM t WHERE rk <= {k}"""


_COS = f"-({_DOT}) / (sqrt({_DOT.format(a='{a}', b='{a}')}) * sqrt({_DOT.format(a='{b}', b='{b}')}))"
_SQL = {"l2": _L2, "ip": f"-({_DOT})", "cos": _COS}


def _out(d: DataFrame) -> DataFrame:
    return d.select("qid", "id", F.round("dist", 6).alias("dist"), "rk")


for _m in ("l2", "ip", "cos"):
    register(f"dist_{_m}", f"WITH v AS ({_V}) SELECT a.id, round({_SQL[_m].format(a='a.v', b='b.v')}, 6) AS dist FROM v a, v b WHERE b.id = 0")(
        lambda s, d, m=_m: vectors(s, d).crossJoin(F.broadcast(vectors(s, d).where("id = 0").select(F.col("v").alias("w")))).select("id", F.round({"l2": l2_squared, "ip": lambda a, b: -dot(a, b), "cos": cosine_distance}[m]("v", "w"), 6).alias("dist"))
    )
    register(f"knn_{_m}", _knn_sql(_SQL[_m]))(lambda s, d, m=_m: _out(search.batch_search(vectors(s, d), first_queries(vectors(s, d)), 10, m)))

_FILTERS = {
    "hybrid_eq": ({"label": 3}, "r.label = 3"),
    "hybrid_in": ({"label": {"$in": [1, 4, 7]}}, "r.label IN (1, 4, 7)"),
    "hybrid_range": ({"label": {"$gt": 2, "$le": 6}}, "r.label > 2 AND r.label <= 6"),
    "hybrid_or": ({"label": 1, "$or": [{"label": 2}, {"label": {"$ge": 8}}]}, "r.label = 1 OR r.label = 2 OR r.label >= 8"),
    "hybrid_residual": ({"label": {"$in": [1, 2]}, "id": {"$gt": 100}}, "r.label IN (1, 2) AND r.id > 100"),
}
for _n, (_f, _w) in _FILTERS.items():
    register(_n, _knn_sql(_L2, _w))(lambda s, d, f=_f: _out(search.batch_search(vectors(s, d), first_queries(vectors(s, d)), 10, "l2", f)))


@register("knn_single", f"WITH v AS ({_V}) SELECT r.id, round({_L2.format(a='r.v', b='q.v')}, 6) AS dist FROM v r, v q WHERE q.id = 5 ORDER BY {_L2.format(a='r.v', b='q.v')}, r.id LIMIT 7")
def knn_single(s, d):
    q = vectors(s, d).where("id = 5").select("v").first()["v"]
    return search.single_search(vectors(s, d), q, 7).select("id", F.round("dist", 6).alias("dist"))


@register("knn_payload", f"WITH k AS ({_knn_sql(_L2, k=5)}) SELECT k.qid, k.id, k.rk, e.label FROM k JOIN embeddings e ON e.vec_id = k.id")
def knn_payload(s, d):
    v = vectors(s, d)
    return search.with_payload(search.batch_search(v, first_queries(v), 5), v, ["label"]).select("qid", "id", "rk", "label")


@register("knn_self_graph", f"""WITH v AS ({_V}), d AS (SELECT a.id AS src, b.id AS dst, {_L2.format(a='b.v', b='a.v')} AS dist FROM v a, v b WHERE a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos FROM d) SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM t WHERE pos <= 4""")
def knn_self_graph(s, d):
    return search.neighbour_graph(vectors(s, d), 4).select("src", "dst", "pos")


@register("normalize", f"WITH v AS ({_V}) SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt({_DOT.format(a='v', b='v')}))), 6) AS total FROM v")
def normalized(s, d):
    return vectors(s, d).select("id", F.round(F.aggregate(normalize("v"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_DIM = f"SELECT pos, min(x) AS low, max(x) AS high, avg(x) AS mean FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({_V})) GROUP BY pos"


@register("dim_statistics", f"SELECT CAST(pos AS INTEGER) AS pos, low, high, round(mean, 6) AS mean FROM ({_DIM})")
def dim_statistics(s, d):
    return statistics.by_dimension(vectors(s, d)).withColumn("mean", F.round("mean", 6))


@register("medoid", f"WITH v AS ({_V}), m AS (SELECT list(mean ORDER BY pos) AS m FROM ({_DIM})) SELECT id FROM v, m ORDER BY {_L2.format(a='v', b='m')}, id LIMIT 1")
def medoid(s, d):
    return statistics.medoid(vectors(s, d)).select("id")


def _codes_sql(levels: int) -> str:
    return f"""WITH v AS ({_V}), m AS (SELECT list(low ORDER BY pos) AS l, list(high ORDER BY pos) AS h FROM ({_DIM})),
    c AS (SELECT id, list_transform(list_zip(v, l, h), lambda z: CASE WHEN z[3] = z[2] THEN 0 ELSE CAST(greatest(0, least({levels}, floor((z[1] - z[2]) / (z[3] - z[2]) * {levels}))) AS INTEGER) END) AS codes FROM v, m)"""


@register("sq8_encode", _codes_sql(255) + " SELECT id, array_to_string(codes, ',') AS codes FROM c")
def sq8(s, d):
    return statistics.quantised(vectors(s, d), 255).select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@register("sq4_encode", _codes_sql(15) + " SELECT id, array_to_string(list_transform(range(0, len(codes), 2), lambda i: codes[i + 1] * 16 + codes[i + 2]), ',') AS packed FROM c")
def sq4(s, d):
    return statistics.quantised(vectors(s, d), 15).select("id", F.array_join(pack_nibbles("codes").cast("array<string>"), ",").alias("packed"))


@register("sq8_knn_rerank", _knn_sql(_L2))
def sq8_knn(s, d):
    v = vectors(s, d)
    return _out(statistics.quantised_search(v, first_queries(v), 10, 255, 60))


@register("cell_sizes", f"""WITH v AS ({_V}), d AS (SELECT r.id, c.id AS cell, row_number() OVER (PARTITION BY r.id ORDER BY {_L2.format(a='r.v', b='c.v')}, c.id) AS rk FROM v r, v c WHERE c.id % 50 = 7)
SELECT cell, count(*) AS n FROM d WHERE rk = 1 GROUP BY cell""")
def cell_sizes(s, d):
    v = vectors(s, d)
    c = v.where("id % 50 = 7").select(F.col("id").alias("cell"), F.col("v").alias("c"))
    return statistics.assign_cells(v, c).groupBy("cell").agg(F.count("*").alias("n"))


@register("reverse_edges", f"""WITH v AS ({_V}), d AS (SELECT a.id AS src, b.id AS dst, {_L2.format(a='b.v', b='a.v')} AS dist FROM v a, v b WHERE a.id <> b.id),
t AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos FROM d) WHERE pos <= 3),
b AS (SELECT src, dst, round(dist, 9) AS dist FROM t UNION SELECT dst, src, round(dist, 9) FROM t)
SELECT src, dst, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos FROM b) WHERE pos <= 4""")
def reverse_edges(s, d):
    g = search.neighbour_graph(vectors(s, d), 3).withColumn("dist", F.round("dist", 9))
    return search.with_reverse(g, 4).select("src", "dst", "pos")


# The searches over their whole query set; the ten-query forms above are held against SQL, these against brute force in tests.
for _m in ("l2", "ip", "cos"):
    register(f"knn_{_m}_all_queries")(lambda s, d, m=_m: _out(search.batch_search(vectors(s, d), stated_queries(vectors(s, d)), 10, m)))
for _n, (_f, _w) in _FILTERS.items():
    register(f"{_n}_all_queries")(lambda s, d, f=_f: _out(search.batch_search(vectors(s, d), stated_queries(vectors(s, d)), 10, "l2", f)))


@register("knn_payload_all_queries")
def knn_payload_all(s, d):
    v = vectors(s, d)
    return search.with_payload(search.batch_search(v, stated_queries(v), 5), v, ["label"]).select("qid", "id", "rk", "label")


@register("sq8_knn_rerank_all_queries")
def sq8_knn_all(s, d):
    v = vectors(s, d)
    return _out(statistics.quantised_search(v, stated_queries(v), 10, 255, 60))


@register("cells_probed_recall_all_queries", "SELECT true AS enough")
def cells_probed(s, d):
    """Whether searching 10 of 32 trained cells finds at least nine tenths of the true neighbours."""
    v = vectors(s, d).select("id", "v")
    c = index.kmeans(v, 32, seed=1)
    found = index.probed_search(v, index.cells_of(v, c), c, stated_queries(v), 10, 10)
    return search.recall(found, search.batch_search(v, stated_queries(v), 10), 10).select((F.col("recall") >= 0.9).alias("enough"))


@register("hybrid_iterative", _knn_sql(_L2, "r.label IN (1, 4, 7)"))
def hybrid_iterative(s, d):
    return _out(hybrid.hybrid_search(vectors(s, d), first_queries(vectors(s, d)), 10, {"label": {"$in": [1, 4, 7]}}, "l2", "iterative_filter"))


@register("knn_padded", f"""WITH k AS ({_knn_sql(_L2, "r.id < 7")}), q AS (SELECT DISTINCT qid FROM k)
SELECT qid, array_to_string(list_transform(range(1, 11), lambda i: coalesce(CAST(list_extract(ids, CAST(i AS INT)) AS VARCHAR), '-')), ',') AS ids FROM (SELECT qid, list(id ORDER BY rk) AS ids FROM k GROUP BY qid)""")
def knn_padded(s, d):
    v = vectors(s, d)
    q = first_queries(v)
    got = hybrid.padded(search.batch_search(v, q, 10, "l2", {"id": {"$lt": 7}}), q, 10)
    return got.select("qid", F.array_join(F.transform("ids", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("ids"))


def documents(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


_DOCS = {
    "filter_eq": ({"lang": "de"}, "lang = 'de'"),
    "filter_range": ({"n_chars": {"$ge": 500, "$lt": 3000}}, "n_chars >= 500 AND n_chars < 3000"),
    "filter_in": ({"source": {"$in": ["src1", "src2"]}}, "source IN ('src1', 'src2')"),
    "filter_and": ({"lang": "en", "n_chars": {"$gt": 1000}}, "lang = 'en' AND n_chars > 1000"),
    "filter_or_contagion": ({"lang": "fr", "$or": [{"source": "src3"}], "$and": [{"source": "src4"}]}, "lang = 'fr' OR source = 'src3' OR source = 'src4'"),
    "filter_type_strict": ({"n_chars": {"$gt": 5.0}}, "false"),
    "filter_missing_field": ({"nothing": 1}, "false"),
    "filter_empty": ({}, "true"),
}
for _n, (_f, _w) in _DOCS.items():
    register(_n, f"SELECT doc_id, n_chars FROM documents WHERE {_w}")(lambda s, d, f=_f: matching(documents(s, d), f).select("doc_id", "n_chars"))
_TREES = {
    "filter_ne": (Filter("and", [Condition("lang", "ne", "de")]), "lang <> 'de'"),
    "filter_ne_other_type": (Filter("and", [Condition("lang", "ne", 1)]), "lang IS NOT NULL"),
    "filter_not_in": (Filter("and", [Condition("source", "not_in", ["src0", "src1"])]), "source NOT IN ('src0', 'src1')"),
    "filter_contains": (Filter("and", [Condition("text", "contains", "License")]), "contains(text, 'License')"),
    "filter_not": (Filter("not", [], [Filter("or", [Condition("lang", "eq", "en"), Condition("n_chars", "lt", 100)])]), "NOT (lang = 'en' OR n_chars < 100)"),
    "filter_not_missing": (Filter("not", [Condition("nothing", "eq", 1)]), "true"),
}
for _n, (_t, _w) in _TREES.items():
    register(_n, f"SELECT doc_id, n_chars FROM documents WHERE {_w}")(lambda s, d, f=_t: matching(documents(s, d), f).select("doc_id", "n_chars"))


@register("filter_query_limit", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def filter_query_limit(s, d):
    return mutations.filter_query(documents(s, d), {"lang": "en"}, 100, "doc_id").select("doc_id", "n_chars")


@register("get_by_id", "SELECT CAST(p - 1 AS INTEGER) AS pos, doc_id, n_chars FROM (SELECT unnest([7, 3, 7, -1, 11]) AS k, unnest([1, 2, 3, 4, 5]) AS p) JOIN documents ON doc_id = k")
def get_by_id(s, d):
    return mutations.get_by_key(documents(s, d), [7, 3, 7, -1, 11], "doc_id").select("pos", "doc_id", "n_chars")


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("p"))


@register("upsert", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'N' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 10 = 0 THEN 1.5 ELSE o_totalprice END AS p FROM orders")
def upsert(s, d):
    o = orders(s, d)
    return mutations.upsert(o, o.where("k % 10 = 0").select("k", F.lit("N").alias("st"), F.lit(1.5).alias("p")), "k")


@register("delete_by_id", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 3 <> 0")
def delete_by_id(s, d):
    return mutations.delete_keys(orders(s, d), orders(s, d).where("k % 3 = 0"), "k").select("k", "p")


@register("delete_by_filter", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_by_filter(s, d):
    return mutations.delete_where(orders(s, d), {"st": "F"}).select("k", "p")


@register("log_replay", """WITH e AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id)
SELECT ev.user_id, ev.event_type, ev.value FROM e JOIN events ev ON ev.event_id = e.m WHERE ev.event_type <> 'error'""")
def log_replay(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("event_id").alias("op_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "user_id", "event_type", "value")
    return mutations.replay(log.select("user_id", "event_type", "value").limit(0), log, "user_id")


# DuckDB's patterns have no look-behind: cuts are the places after an end mark that no abbreviation's pattern ends at
_SENTENCES = r"""WITH c AS (SELECT doc_id, text, list_filter(range(1, length(text) + 1), lambda i: contains('.?!。？！', substr(text, i, 1))
  AND NOT (i >= 4 AND regexp_full_match(substr(text, i - 3, 4), '[\pL\pN_]\.[\pL\pN_][^\n]')) AND NOT (i >= 3 AND regexp_full_match(substr(text, i - 2, 3), '[A-Z][a-z]\.'))) AS e FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(list_zip(list_prepend(0, e), list_append(e, length(text))), lambda z: regexp_replace(regexp_replace(substr(text, z[1] + 1, z[2] - z[1]), '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS p FROM c)
SELECT doc_id, len(range(0, len(p), 2)) AS n, sha256(array_to_string(list_transform(range(0, len(p), 2), lambda i: array_to_string(p[i + 1:i + 3], ' ')), chr(10) || '--' || chr(10))) AS digest FROM s"""


@register("sentence_chunk", _SENTENCES)
def sentence_chunk(s, d):
    """The number of chunks and a digest of all of them."""
    c = chunkers.whole_sentence_chunks(documents(s, d), "text", 3, 1)
    return c.select("doc_id", F.size("chunks").cast("long").alias("n"), F.sha2(F.array_join("chunks", "\n--\n"), 256).alias("digest"))


@register("sentence_chunk_whole")
def sentence_chunk_whole(s, d):
    """All chunks, held against Python's re in tests."""
    return chunkers.whole_sentence_chunks(documents(s, d), "text", 3, 1).select("doc_id", "chunks")


@register("semantic_chunk")
def semantic_chunk(s, d):
    return chunkers.semantic_chunks(documents(s, d).select("doc_id", "text"), "text", 3).select("doc_id", "chunks")


@register("sortable_keys", "SELECT doc_id, lpad(lower(to_hex(CAST(doc_id AS HUGEINT) + 9223372036854775808)), 16, '0') AS k FROM documents")
def sortable_keys(s, d):
    return documents(s, d).select("doc_id", sortable_hex("doc_id").alias("k"))


@register("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"))


@register("duplicate_keys", "SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(s, d):
    return mutations.repeated_keys(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k")), "k")


@register("members_by_value", "SELECT lang, list(doc_id ORDER BY doc_id) AS members FROM documents GROUP BY lang")
def members_by_value(s, d):
    return mutations.members_by_value(documents(s, d), "lang", "doc_id")


@register("sortable_doubles", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS place FROM events")
def sortable_doubles(s, d):
    """Events in the order of their values' keys."""
    from .functions import sortable_double
    from .sources import shared_dir

    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    return mutations.numbered(e, [sortable_double("value"), "event_id"], f"{shared_dir(s)}/sorted", "place", 1, ["value", "event_id"]).select("event_id", "place")


@register("collection_reopened", """SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE lang END AS lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents
WHERE doc_id % 5 <> 0 AND n_chars > 300 AND (CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE lang END) IN ('new', 'en')""")
def collection_reopened(s, d):
    """A collection that is filled, changed, saved, changed again, reopened from its log, and queried."""
    import tempfile

    from .catalog import Client

    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="annulus-")
    url = f"{base.rstrip('/')}/catalog-{s.sparkContext.applicationId}-{abs(hash(d)) % 10**9}-{int(__import__('time').time() * 1000)}"
    docs = documents(s, d).select(F.col("doc_id").alias("item_id"), F.lit(None).cast("string").alias("document"), F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"), "lang", F.col("n_chars").cast("long").alias("n_chars"), F.col("doc_id").alias("pos"))
    c = Client(s, url).create_collection("docs", capacity=10**9)
    c.insert(docs)
    c.delete_by_id([])
    c.save()
    c.upsert(docs.where("item_id % 6 = 0").withColumn("lang", F.lit("new")))
    c.delete_by_filter({"n_chars": {"$le": 300}})
    c.delete_by_id(docs.where("item_id % 5 = 0"))
    again = Client(s, url).get_collection("docs")
    return again.matching({"lang": {"$in": ["new", "en"]}, "n_chars": {"$gt": 300}}).select("item_id", F.col("lang__string").alias("lang"), F.col("n_chars__long").alias("n_chars"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Filtered nearest neighbours of the whole query set."""
    return QUERIES["hybrid_in_all_queries"](s, d)
