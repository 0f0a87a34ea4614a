"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import registry
from tests.conftest import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(TESTDATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "none"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, TESTDATA)
    want = db.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda data, names: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in data)
    assert as_rows([tuple(r) for r in got.collect()], got.columns) == as_rows(want.fetchall(), want.columns)


def test_flagship(spark):
    assert registry.flagship(spark, TESTDATA).count() > 0


def test_pushdown(spark):
    plan = registry.table(spark, TESTDATA, "orders").where("o_orderkey >= 100").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_index_predicates_reach_the_scan(spark):
    """Fields with one value aren't exploded: equality and range on an index are the scan's own filters, stored or not."""
    t = lambda name: registry.table(spark, TESTDATA, name)
    wanted = registry.ix.Scan((7,), "ge", 1000.0)
    for index, filters in ((registry._orders_index(t), ("EqualTo(o_custkey,7)", "GreaterThanOrEqual(o_totalprice,1000.0)")), (registry.ix.save(registry._orders_index(t), registry.new_path(spark, "index")), ("EqualTo(v1,7)", "GreaterThanOrEqual(v2,1000.0)"))):
        plan = index.covering(wanted)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert all(f in plan for f in filters) and "Generate" not in plan
    plan = index.fetch(t("orders"), "o_orderkey", wanted)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderkey, [" in plan


def test_analyzed_terms_are_a_plain_count(spark, db):
    from collections import Counter

    df, ttf = Counter(), Counter()
    for text in (r[0] for r in db.sql("SELECT text FROM documents").fetchall()):
        words = [w for w, _ in registry.ENGLISH.analyze(text)]
        ttf.update(words)
        df.update(set(words))
    got = {r.token: (r.df, r.ttf) for r in registry.QUERIES["fts_analyzed_terms"](spark, TESTDATA).collect()}
    assert got == {w: (df[w], ttf[w]) for w in ttf} and len(got) > 100
    assert registry.QUERIES["fts_analyzed_phrase"](spark, TESTDATA).count() == sum(_next_to(registry.ENGLISH.analyze(r[0])) for r in db.sql("SELECT text FROM documents").fetchall())


def _next_to(found) -> bool:
    at = {p: w for w, p in found}
    return any(w == "with" and at.get(p + 1) == "that" for p, w in at.items())


def test_lists_find_most_neighbours(spark):
    import numpy as np

    from lodestone.operators import vector

    v = registry._vectors(lambda name: registry.table(spark, TESTDATA.replace("0.001", "0.01"), name))
    path = registry.new_path(spark, "lists")
    vector.save_lists(v, path, 32)
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r._id for r in rows])
    found = total = 0
    for r in rows[::50]:
        far = np.sqrt(((x - np.array(r.embedding, float)) ** 2).sum(axis=1))
        want = set(ids[np.lexsort((ids, far))[:10]].tolist())
        got = {g._id for g in vector.search_lists(spark, path, list(r.embedding), 10, 24).collect()}
        found, total = found + len(got & want), total + len(want)
        exact = {g._id for g in vector.search_lists(spark, path, list(r.embedding), 10, 32).collect()} if r is rows[0] else want
        assert exact == want
    assert found / total >= 0.9
