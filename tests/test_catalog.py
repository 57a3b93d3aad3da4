import pytest
from pyspark.sql import functions as F

from annulus.catalog import Client, Params
from annulus.operators.filters import Condition, Filter
from annulus.segments import SegmentedCollection


def ids(df):
    return [r.item_id for r in df.collect()]


def test_collection_life(spark, tmp_path):
    url = str(tmp_path)
    c = Client(spark, url).create_collection("notes", metric="l2", capacity=50)
    c.insert([(1, "one", [0.0, 1.0], {"tag": "x", "n": 1}), (2, "two", [1.0, 1.0], {"tag": "y", "n": 2.5}), ("three", "three", [2.0, 1.0], {"tag": "x", "flag": True, "bad": [1]})])
    with pytest.raises(ValueError, match="Duplicate item_id: 1"):
        c.insert([(9, "nine", [0.0, 0.0], None), (1, "again", [0.0, 0.0], None)])
    with pytest.raises(ValueError, match="dimension"):
        c.insert([(9, "nine", [0.0], None)])
    with pytest.raises(RuntimeError):
        c.set_metric("ip")
    assert c.count() == 3 and c.contains(2) and not c.contains(9) and c.vector_of("three") == [2.0, 1.0]
    assert ids(c.filter_query({"tag": "x"})) == ["1", "three"]
    assert ids(c.filter_query({"n": {"$gt": 0}})) == ["1"]  # an integer is not compared with a double
    assert ids(c.filter_query({"n": {"$ge": 2.0}})) == ["2"] and ids(c.filter_query({"flag": True})) == ["three"]
    assert ids(c.filter_query(Filter("not", [Condition("n", "eq", 1)]))) == ["2", "three"] and ids(c.filter_query(Filter("and", [Condition("n", "ne", 1)]))) == ["2"]
    assert [r.item_id for r in c.get_by_id(["three", 1, "no", 1]).collect()] == ["three", "1", "1"]
    c.upsert([(1, "one b", [5.0, 5.0], {"tag": "z"}), (1, "one c", [6.0, 6.0], {"tag": "z"})])
    assert ids(c.filter_query({})) == ["2", "three", "1"] and c.get_by_id([1]).first().document == "one c"
    assert c.delete_by_filter({"tag": "y"}) == 1
    c.delete_by_id(["unknown"])
    again = Client(spark, url).get_collection("notes")  # from the log alone
    assert sorted(ids(again.table())) == ["1", "three"]
    again.save()
    again.insert([(4, "four", [2.0, 1.5], {"tag": "x"})])
    third = Client(spark, url).get_collection("notes")
    assert ids(third.filter_query({"tag": "x"})) == ["three", "4"]
    assert [r.item_id for r in third.hybrid_query([2.0, 1.0], 2, {"tag": "x"}).orderBy("rk").collect()] == ["three", "4"]
    got = third.batch_query([[2.0, 1.0], [6.0, 6.0]], 1).orderBy("qid").collect()
    assert [(r.item_id, r.distance) for r in got] == [("three", 0.0), ("1", 0.0)]
    third.reindex()
    assert [r.internal_id for r in third.filter_query({}).collect()] == [0, 1, 2]


def test_replay_stops_at_damage(spark, tmp_path):
    c = Client(spark, str(tmp_path)).create_collection("a")
    for k in range(3):
        c.insert([(k, None, [float(k)], None)])
    c.store.drop("log/2")
    assert ids(Client(spark, str(tmp_path)).get_collection("a").table()) == ["0"]
    c.store.drop("log/3.commit")  # prepared, not committed
    assert len(c.committed()) == 1


def test_catalog(spark, tmp_path):
    c = Client(spark, str(tmp_path))
    c.create_collection("a")
    i = c.create_index("b", metric="cosine")
    with pytest.raises(RuntimeError):
        c.create_index("a")
    with pytest.raises(RuntimeError):
        c.delete_collection("b")
    assert i.fit([[1.0, 0.0], [0.0, 2.0], [3.0, 3.0]]) == 3 and i.add([5.0, 0.1]) == 3
    assert [x for x, _ in i.search([1.0, 0.0], 2)] == [0, 3]
    i.remove(0)
    assert [x for x, _ in i.search([1.0, 0.0], 2)] == [3, 2]
    c.save_index("b")
    d = Client(spark, str(tmp_path))
    assert d.list_indices() == ["b"] and d.list_collections() == [] and d.get_index("b").params.metric == "cos" and d.get_index("a") is None
    d.reset(delete_on_disk=True)
    assert Client(spark, str(tmp_path)).list_indices() == []
    assert Params.from_json(Params(metric="ip").to_json()) == Params(metric="ip")
    for bad in ({"metric": "manhattan"}, {"max_nbrs": 1000}, {"capacity": 0}, {"data_type": "float64"}, {"colour": 1}, {"quantization_type": "rabitq", "id_type": "uint64"}):
        with pytest.raises(ValueError):
            Params.from_kwargs(**bad)


def test_segments(spark, tmp_path):
    c = SegmentedCollection(spark, str(tmp_path), 2, "cos")
    row = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "label long, v array<double>")
    c.add_batch(row((1, [1.0, 0.0]), (2, [0.0, 1.0])))
    c.flush()
    for bad in ((3, [0.0, 0.0]), (3, [1.0]), (3, [float("nan"), 1.0])):
        with pytest.raises(ValueError, match="label 3"):
            c.add_batch(row(bad))
    c.add_batch(row((2, [1.0, 1.0])))
    with pytest.raises(ValueError, match="Duplicate label: 2"):
        c.flush()
    c.pending, c.held = [], 0
    c.add_batch(row((7, [1.0, 1.0])))
    c.flush()
    with pytest.raises(RuntimeError):
        SegmentedCollection(spark, str(tmp_path)).lock()
    (tmp_path / "segments" / "left-over").mkdir()
    c.close()
    d = SegmentedCollection(spark, str(tmp_path))
    assert d.orphans() == ["left-over"] and d.size() == 3
    q = spark.createDataFrame([(0, [2.0, 1.9])], "qid long, qv array<double>")
    got = d.batch_search_padded(q, 4).first()
    assert got.ids == [7, 1, 2, None] and got.dists[3] != got.dists[3]
    with pytest.raises(KeyError):
        d.delete([1, 99])
    d.delete([1])
    assert d.size() == 2 and d.orphans() == ["left-over"]


def test_filters_reach_the_scan(spark, tmp_path):
    from annulus.operators.filters import matching, predicate

    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("n"), F.col("id").cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda spec: matching(df, spec)._jdf.queryExecution().executedPlan().toString()
    for spec, want in (({"n": 3}, "EqualTo(n,3)"), ({"n": {"$in": [1, 2]}}, "In(n, [1,2])"), ({"id": {"$ge": 10, "$lt": 20}}, "GreaterThanOrEqual(id,10)"), ({"s": {"$contains": "9"}}, "StringContains(s,9)"), ({"$or": [{"n": 1}, {"id": {"$gt": 90}}]}, "Or(EqualTo(n,1),GreaterThan(id,90))")):
        assert want in plan(spec).split("PushedFilters: ")[1].split("]\n")[0] + "]", spec
    for spec in ({"x": {"$gt": 3.0, "$le": 20.0}}, {"x": {"$ne": 1.0}}, {"n": {"$not_in": [1, 2]}}, {"$or": [{"x": 1.5}, {"x": {"$ge": 30.0}}]}, {"n": 2.0}, {"nothing": 1}, {}):
        assert sorted(r.id for r in matching(df, spec).collect()) == sorted(r.id for r in df.where(predicate(df, spec)).collect()), spec
