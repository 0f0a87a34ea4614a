import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import keys
from lodestone.functions.values import Num, index_range
from lodestone.operators import index as ix
from lodestone.operators import scan, stats
from lodestone.plans import registry
from lodestone.sources import profiles, repairlog
from tests.conftest import TESTDATA, rows


def test_seeks_and_pages(spark):
    df = spark.range(0, 100, 10).withColumnRenamed("id", "k")
    got = lambda x: [r.k for r in x.collect()]
    assert [got(scan.seek(df, "k", 30, w)) for w in ("floor", "lower", "ceiling", "higher")] == [[30], [20], [30], [40]]
    assert got(scan.seek(df, "k", 90, "higher")) == [] and got(scan.seek(df, "k", 35, "floor")) == [30]
    with pytest.raises(ValueError):
        scan.seek(df, "k", 1, "near")
    assert got(scan.first(df, "k")) == [0] and got(scan.last(df, "k")) == [90]
    assert got(scan.page(df, "k", 3, 2)) == [30, 40] and got(scan.page(df, "k", 0, 2, reverse=True)) == [90, 80]
    pages = [[r.k for r in p] for p in scan.walk(df, "k", 4)]
    assert pages == [[0, 10, 20, 30], [40, 50, 60, 70], [80, 90]]
    assert [r.k for p in scan.walk(df, "k", 3, reverse=True) for r in p] == [*range(90, -1, -10)]


def test_every_row_has_its_place(spark):
    df = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3000).alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    for order, want in ((F.asc_nulls_first("k"), [None, *range(3000)]), (F.desc_nulls_last("k"), [*range(2999, -1, -1), None])):
        got = sorted((r.place, r.k) for r in scan.numbered(df, [order]).collect())
        assert got == [(i + 1, k) for i, k in enumerate(want)]
    assert scan.numbered(df.where("k < 0"), [F.asc("k")]).count() == 0


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")
@pytest.mark.parametrize("name, key", [("reverse_scan", lambda r: r._id), ("index_full_scan_reverse", lambda r: (r.v1, r.v2, r._id))])
def test_reverse_scans_give_every_entry(spark, name, key):
    got = registry.QUERIES[name](spark, TESTDATA).collect()
    assert len(got) == registry.table(spark, TESTDATA, "orders").count() > 1000
    assert [r.place for r in got] == [*range(1, len(got) + 1)] and [*map(key, got)] == sorted(map(key, got), reverse=True)


def test_counters(spark):
    df, seen = scan.counted(spark.createDataFrame([(1, "ab"), (2, None), (3, "ä")], "_id long, t string"))
    df.collect()
    assert seen.get == {"rows": 3, "bytes": 4}


def test_key_columns(spark):
    data = [(1, (5, None)), (2, (None, 5.0)), (3, (None, 5.5)), (4, (6, None)), (5, None), (6, (-1, None))]
    df = keys.with_key(spark.createDataFrame(data, "_id long, v struct<l:long,d:double>"), ["v"], "_id").cache()
    ids = lambda *a, **k: [r._id for r in keys.id_of(df.select("key")).where(keys.in_range(F.col("key"), index_range(*a, **k))).orderBy("key").collect()]
    assert ids([Num(5)], any_number=True) == [1, 2]
    assert ids([Num(5)]) == [1]
    assert ids([], "gt", 5) == [3, 4]
    assert ids([], "lt", 5) == [5, 6]
    assert ids([], "between", 5, 6) == [1, 2, 3, 4]
    assert ids([None]) == [5]
    assert ids([]) == [5, 6, 1, 2, 3, 4]


def test_repair_log(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "_id long, name string")
    index = ix.create(docs, "_id", "n", ["name"])
    log = spark.createDataFrame([(1, 2, ("x",)), (2, 2, ("y",)), (3, 3, None), (4, 9, ("z",))], "seq long, _id long, after struct<name:string>")
    once = repairlog.replay(index, log)
    assert rows(once.entries) == [("a", 1), ("y", 2), ("z", 9)]
    assert rows(repairlog.replay(once, log).entries) == rows(once.entries)
    assert rows(repairlog.rebuild(once, docs).entries) == rows(index.entries)


def test_profiles(spark, tmp_path):
    before = profiles.apply(spark, "small")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    for k, v in before.items():
        spark.conf.set(k, v)
    with pytest.raises(ValueError):
        profiles.apply(spark, "none")
    profiles.write_sorted(spark.range(100), f"{tmp_path}/sorted", "id", ["id"])
    assert spark.read.parquet(f"{tmp_path}/sorted").where("id = 7").count() == 1


def test_opaque(spark):
    df = spark.createDataFrame([("int",), ("blob",), ("blob",), ("ext",)], "type string")
    assert rows(stats.opaque_count(df, "type", ["int"])) == [("blob", 2), ("ext", 1)]
