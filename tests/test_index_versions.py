import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators import stats
from lodestone.operators import versions as V
from lodestone.streaming import feed
from tests.conftest import rows


@pytest.fixture(scope="module")
def people(spark):
    data = [(i, f"city{i % 10:02d}", i % 50, f"name-{i}") for i in range(200)]
    return spark.createDataFrame(data, "_id long, city string, qty int, name string").cache()


def ids(df):
    return [r._id for r in df.collect()]


def test_scans(people):
    index = ix.create(people, "_id", "i", ["city", "qty"])
    assert len(ids(index.lookup(ix.Scan(("city03",))))) == 20
    got = index.covering(ix.Scan(("city03",), "ge", 23)).collect()
    assert [(r.v1, r.v2) for r in got] == sorted((r.v1, r.v2) for r in got) and all(r.v2 >= 23 for r in got)
    assert ids(index.lookup(ix.Scan(reverse=True))) == ids(index.lookup())[::-1]
    names = ix.create(people, "_id", "n", ["name"])
    assert len(ids(names.lookup(ix.Scan((), "starts", "name-1")))) == 111
    assert [r.name for r in names.fetch(people, "_id", ix.Scan(("name-7",))).collect()] == ["name-7"]


def test_every_path_gives_what_a_scan_gives(people):
    indexes = [ix.create(people, "_id", n, f) for n, f in (("a", ["city", "qty"]), ("b", ["qty"]), ("c", ["name"]))]
    planner = ix.Planner(people, "_id", indexes)
    assert planner.choose({"city": "city01"}, "qty").name == "a" and planner.choose({"nope": 1}) is None
    for equal, ranged, op, value, upper in (({"city": "city01"}, "qty", "lt", 20, None), ({"qty": 7}, None, None, None, None), ({}, "qty", "between", 3, 5), ({"city": "city02", "name": "name-2"}, "qty", "ge", 1, None), ({"name": "none"}, None, None, None, None)):
        want = ix.Planner(people, "_id", []).find(equal, ranged, op, value, upper)
        assert rows(planner.find(equal, ranged, op, value, upper)) == rows(want)
    for i in indexes:
        i.stale = True
    assert planner.choose({"city": "city01"}) is None
    with pytest.raises(ValueError):
        indexes[0].fetch(people, "_id")


def test_unique(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "_id long, email string")
    with pytest.raises(ix.UniqueViolation):
        ix.create(docs, "_id", "u", ["email"], unique=True)
    good = ix.create(docs.where("_id <> 2"), "_id", "u", ["email"], unique=True)
    changed = spark.createDataFrame([(1,)], "_id long")
    assert rows(ix.maintain(good, docs.where("_id <> 2"), "_id", changed).covering()) == [("a", 1), (None, 3), (None, 4)]
    with pytest.raises(ix.UniqueViolation):
        ix.maintain(good, docs, "_id", spark.createDataFrame([(2,)], "_id long"))


def test_statistics(people):
    index = ix.create(people, "_id", "i", ["qty"])
    got = rows(stats.histogram(index.entries, "v1"))
    values = sorted(i % 50 for i in range(200))
    assert sorted(got) == [(values[k - 1], k) for k in sorted({*range(4, 201, 4), 200})]
    assert stats.rows_at_or_below(stats.histogram(index.entries, "v1"), 10).first()[0] == 44
    assert stats.histogram(index.entries.limit(0), "v1").count() == 0
    assert stats.selectivity(0, 0) is None and stats.selectivity(100, 50) == 0.02
    assert stats.most_selective([("a", 100, 10), ("b", 100, 50), ("c", 100, 50), ("d", 0, 0)]) == "b"
    assert abs(stats.distinct_estimate(index.entries, F.col("v1")).first()[0] - 50) <= 2


SCHEMA = "tree_id int, key long, seq long, op string, value string, expiry_ms long, end_key long"


def log(spark, *data):
    return spark.createDataFrame([(1, *r) for r in data], SCHEMA)


def test_versions(spark):
    data = log(spark, (1, 1, "put", "a", None, None), (1, 2, "put", "b", None, None), (1, 3, "delete", None, None, None), (2, 4, "put", "x", None, None), (1, 5, "put", "c", None, None))
    seen = lambda s: [(r.key, r.value) for r in V.scan(data, 1, snapshot=s).collect()]
    assert [seen(s) for s in range(6)] == [[], [(1, "a")], [(1, "b")], [], [(2, "x")], [(1, "c"), (2, "x")]]
    for s in (3, 4, 5):
        assert rows(V.read(V.compact(data, 3), s).select("key", "value")) == rows(V.read(data, s).select("key", "value"))
    assert rows(V.read(V.compact(data)).select("key", "value")) == [(1, "c"), (2, "x")]


@pytest.mark.parametrize("most", [10_000, 0])
def test_range_deletes(spark, monkeypatch, most):
    monkeypatch.setattr(V, "MOST_RANGES", most)
    puts = [(k, k + 1, "put", f"v{k}", None, None) for k in range(40)]
    data = log(spark, *puts, (10, 41, "range_delete", None, None, 20), (5, 42, "range_delete", None, None, 12), (15, 43, "put", "again", None, None))
    assert V.read(data, 40).count() == 40 and V.read(data, 41).count() == 30 and V.read(data, 42).count() == 25
    assert [(r.key, r.value) for r in V.scan(data, 1, 10, 20).collect()] == [(15, "again")]
    assert V.read(data).count() == 26
    assert [r.key for r in V.scan(data, 1, 0, 8).collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("most", [10_000, 3])
def test_any_ranges_hide_what_a_plain_loop_hides(spark, monkeypatch, most):
    """Of several trees, overlapping, nested and touching; swept on the driver or bin by bin."""
    import random

    monkeypatch.setattr(V, "MOST_RANGES", most)
    monkeypatch.setattr(V, "BINS", 12)
    monkeypatch.setattr(V, "IN_BIN", 3)
    r = random.Random(8)
    ranges = []
    for seq in range(1, 80):
        low = r.randint(0, 300)
        ranges.append((r.randint(1, 3), low, seq * 3, low + r.choice([1, 2, 5, 40, 250])))
    puts = [(t, k, r.randint(1, 240)) for t in (1, 2, 3, 4) for k in range(-3, 560, 2)]
    schema = "tree_id int, key long, seq long, op string, value string, expiry_ms long, end_key long"
    data = spark.createDataFrame([(t, k, s, "put", "v", None, None) for t, k, s in puts] + [(t, low, s, "range_delete", None, None, high) for t, low, s, high in ranges], schema)
    want = sorted((t, k) for t, k, s in puts if not any(t == t2 and low <= k < high and s2 > s for t2, low, s2, high in ranges))
    assert rows(V.read(data).select("tree_id", "key")) == sorted(want, key=repr)
    touched = data.where("op = 'put'").select("tree_id", "key")
    hit = {(t, k) for t, k, s in puts if s > 200 or any(t == t2 and low <= k < high and s2 > 200 for t2, low, s2, high in ranges)}
    assert {tuple(x) for x in V.conflicts(data, touched, 200).collect()} == hit


def test_expiry_hides_and_never_reveals(spark):
    data = log(spark, (1, 1, "put", "old", None, None), (1, 2, "put", "new", 100, None), (2, 3, "put", "x", 101, None))
    at = lambda now: rows(V.read(data, now_ms=now).select("key", "value"))
    assert at(99) == [(1, "new"), (2, "x")] and at(100) == [(2, "x")] and at(101) == [] and at(50) == [(1, "new"), (2, "x")]


def test_checkpoints(spark):
    data = log(spark, (1, 1, "put", "a", None, None), (1, 2, "put", "b", None, None), (1, 4, "put", "d", None, None))
    c = V.Checkpoints()
    c.create("one", 1, 0, expires=10)
    c.create("two", 2, 0)
    with pytest.raises(ValueError):
        c.create("one", 1, 0)
    with pytest.raises(ValueError):
        c.create("three", 1, 0, pinned_share=0.3)
    c.create("three", 1, 0, pinned_share=0.3, force=True)
    c.restore("one", 3)
    assert rows(V.read(data.where(c.visible())).select("value")) == [("d",)]
    assert rows(V.read(data.where(c.visible()), 3).select("value")) == [("a",)]
    assert rows(c.open_at(data, "two").select("value")) == [("b",)]
    assert c.expire(10) == ["one"] and "two" in c.rows


def test_transactions(spark):
    data = log(spark, (1, 1, "put", "a", None, None), (2, 5, "put", "b", None, None), (20, 6, "range_delete", None, None, 30))
    t = V.Transaction(3)
    t.write(1, 1, "put", "mine")
    assert t.read(1, 1) == ("put", "mine") and t.read(1, 9) is None
    t.savepoint("s")
    t.write(1, 2, "put", "clash")
    with pytest.raises(V.Conflict):
        t.commit(data, 10)
    t.rollback_to("s")
    t.rollback_to("s")
    assert rows(t.commit(data, 10).select("key", "seq", "op", "value")) == [(1, 10, "put", "mine")]
    reader = V.Transaction(3, "serializable")
    reader.read(1, 25)
    reader.write(1, 1, "delete")
    with pytest.raises(V.Conflict):
        reader.commit(data, 10)
    last = V.Transaction(3, "read_committed")
    last.write(1, 2, "put", "wins")
    assert last.commit(data, 10).count() == 1
    with pytest.raises(ValueError):
        V.Transaction(3, "read_only").write(1, 1)
    with pytest.raises(ValueError):
        V.Transaction(3, "none")
    t.abort()
    assert t.commit(data, 10).count() == 0


def test_backpressure():
    assert V.backpressure_ms({"l0": 0.5, "debt": 1.0}) == (0.0, None)
    assert V.backpressure_ms({"l0": 3.0, "debt": 2.0}) == (400.0, "l0")


def test_feed(spark, tmp_path):
    data = log(spark, *[(k, k, "put", "v", None, None) for k in range(1, 11)])
    changes = feed.feed_of(data, [1])
    assert [r.seq for r in feed.read(changes, 1, 3, 6).collect()] == [3, 4, 5]
    assert feed.feed_of(data, []).count() == 0
    assert feed.retain(changes, 4).count() == 5
    timed = changes.withColumn("at", F.col("seq") * 100)
    assert feed.retain(timed, 100, "at", 1000, 250).count() == 3
    assert feed.retain(changes.limit(0)).count() == 0
    data.where("seq <= 5").write.parquet(f"{tmp_path}/log/a")
    seen = []
    q = feed.deliver(feed.stream(spark, f"{tmp_path}/log", data.schema, 1), lambda b, n: seen.extend(r.seq for r in b.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    data.where("seq > 5").unionByName(log(spark, (1, 11, "delete", None, None, None))).write.parquet(f"{tmp_path}/log/b")
    q = feed.deliver(feed.stream(spark, f"{tmp_path}/log", data.schema, 1), lambda b, n: seen.extend(r.seq for r in b.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sorted(seen) == list(range(1, 12))
    feed.latest_state(spark, feed.stream(spark, f"{tmp_path}/log", data.schema), f"{tmp_path}/state", f"{tmp_path}/cp2").awaitTermination()
    newest = sorted((tmp_path / "state").iterdir())[-1]
    assert {(r.key, r.op) for r in spark.read.parquet(str(newest)).collect()} == {(1, "delete"), *((k, "put") for k in range(2, 11))}
