import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions.paths import expand, resolve, split_path
from tests.conftest import rows


def test_split_path():
    assert split_path("a.b.c") == ["a", "b", "c"]
    assert split_path("a\\.b.c") == ["a.b", "c"]
    assert split_path("a\\\\b") == ["a\\b"]
    for bad in ("a\\x", "a\\"):
        with pytest.raises(ValueError):
            split_path(bad)


DOCS = [(1, ["red", "blue"]), (2, ["red", "red"]), (3, None), (4, []), (5, [None, "x"])]


def test_array_entries(spark):
    df = spark.createDataFrame(DOCS, "_id long, tags array<string>")
    assert rows(expand(df, "_id", ["tags"])) == sorted([("red", 1), ("blue", 1), ("red", 2), (None, 3), (None, 5), ("x", 5)], key=repr)
    assert rows(expand(df, "_id", ["tags"], sparse=True)) == sorted([("red", 1), ("blue", 1), ("red", 2), (None, 5), ("x", 5)], key=repr)
    assert rows(expand(df.limit(0), "_id", ["tags"])) == []


def test_missing_field_is_null_or_left_out(spark):
    df = spark.createDataFrame([(1, "a")], "_id long, x string")
    assert rows(expand(df, "_id", ["nope"])) == [(None, 1)]
    assert rows(expand(df, "_id", ["nope"], sparse=True)) == []


def test_nested_flattening(spark):
    df = spark.createDataFrame([(1, [([("s1",), ("s2",)],), ([("s1",)],)])], "_id long, orders array<struct<items:array<struct<sku:string>>>>")
    assert rows(expand(df, "_id", ["orders.items.sku"])) == [("s1", 1), ("s2", 1)]
    assert resolve(df, "orders.nope") is None


def test_literal_dot(spark):
    df = spark.createDataFrame([(1, ("v",))], "_id long, `a.b` struct<c:string>")
    assert rows(expand(df, "_id", ["a\\.b.c"])) == [("v", 1)]


def test_product_and_cap(spark):
    df = spark.createDataFrame([(1, "in", ["a", "b"])], "_id long, country string, city array<string>")
    assert rows(expand(df, "_id", ["country", "city"])) == [("in", "a", 1), ("in", "b", 1)]
    big = spark.createDataFrame([(1, list(range(40)), list(range(40)))], "_id long, a array<int>, b array<int>")
    with pytest.raises(Exception, match="more than 1024 index entries"):
        expand(big, "_id", ["a", "b"]).collect()


def test_null_is_lowest(spark):
    df = spark.createDataFrame([(None,), (1,), (5,), (9,)], "x int")
    got = lambda c: [r.x for r in df.where(c).orderBy("x").collect()]
    x = F.col("x")
    assert got(P.below(x, 5)) == [None, 1]
    assert got(P.below(x, 5, True)) == [None, 1, 5]
    assert got(P.above(x, 5)) == [5, 9]
    assert got(P.above(x, 5, False)) == [9]
    assert got(P.equal(x, None)) == [None]
    assert got(P.above(x, None)) == [None, 1, 5, 9]
    assert got(P.below(x, None)) == []
    assert got(P.between(x, 1, 5)) == [1, 5]


def test_exact_numbers(spark):
    big = 2**53
    data = [(5, 5.0), (big + 1, float(big)), (big, float(big)), (2**63 - 1, 2.0**63), (1, 1.5), (1, float("nan")), (-(2**63), -(2.0**63)), (None, 1.0), (1, None), (-2, -1.5)]
    df = spark.createDataFrame(data, "l long, d double")
    got = df.select(P.exact_equal(F.col("l"), F.col("d")).alias("e"), P.exact_less(F.col("l"), F.col("d")).alias("s")).collect()
    from fractions import Fraction

    for (x, y), r in zip(data, got):
        if x is None or y is None:
            assert r.e is False
        elif y != y:
            assert r.e is False and r.s is True
        else:
            assert r.e == (Fraction(x) == Fraction(y)), (x, y)
            assert r.s == (Fraction(x) < Fraction(y)), (x, y)
