"""The pipeline's stages and the registered queries on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import queries
from tests.conftest import TESTDATA
from tests.llm import brute

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(TESTDATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{f}'")
    return c


def counted(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, TESTDATA), db.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got, want.columns) == Counter(want.fetchall())


def test_brute(spark, db):
    docs = db.sql("SELECT doc_id, text FROM documents").fetchall()
    items = db.sql("SELECT item_id, text FROM benchmark").fetchall()
    q = {n[: n.index("_")]: f for n, f in queries.QUERIES.items()}
    assert counted(q["op4"](spark, TESTDATA), ["doc_id", "n_shingles", "component_id"]) == Counter(brute.jaccard_components(docs, 4, 85))
    assert counted(q["op5"](spark, TESTDATA), ["doc_id", "start", "n_tokens", "ids_crc32"]) == Counter(brute.sstable(docs))
    assert counted(q["op9"](spark, TESTDATA), ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]) == Counter(brute.edited(docs))
    assert counted(q["op10"](spark, TESTDATA), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == Counter(brute.decontamination(docs, items))


def test_packing_query_by_brute(spark, db):
    """The query's own columns, without the ids: pieces of each document in order, sequences without gaps, the longest first."""
    pieces = {}
    rows = queries.QUERIES["op7_packing"](spark, TESTDATA).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    docs = db.sql("SELECT doc_id, text FROM documents").fetchall()
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = brute.ids(text), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0) and r.length in [1 << b for b in range(13)]
            assert r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    rows.sort(key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == [*range(len(rows))]
    assert [r.length for r in rows] == sorted((r.length for r in rows), reverse=True)


def test_quality_on_held_out_rows(spark, db):
    labels = dict(db.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in queries.QUERIES["op6_quality"](spark, TESTDATA).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 10 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_stages(spark, db):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = dict(db.sql("SELECT doc_id, quality FROM labels").fetchall())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near copies", "benchmark leaks", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, TESTDATA)
        after = made.collect()
        if name != "packing":
            assert made.columns == docs.columns
        if name == "quality":
            kept = {r.doc_id for r in after}
            assert kept < {r.doc_id for r in before}
            assert all((d in kept) == (q == 1) for d, q in labels.items())
        elif name == "line dedup":
            want = brute.without_boilerplate([(r.text, r.source) for r in before], 10, 20)
            assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((r.doc_id, t, len(t)) for r, t in zip(before, want))
            assert sum(r.text != t for r, t in zip(before, want)) > 3
        elif name == "near copies":
            components = brute.jaccard_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert {r.doc_id for r in after} == {d for d, n, c in components if d == c}
        elif name == "benchmark leaks":
            items = db.sql("SELECT item_id, text FROM benchmark").fetchall()
            assert {r.doc_id for r in after} == {x[0] for x in brute.decontamination([(r.doc_id, r.text) for r in before], items) if not x[5]}
        else:
            pieces = {}
            for r in after:
                pieces.setdefault(r.doc_id, []).append(r)
            for d in before:
                assert [x for r in sorted(pieces[d.doc_id], key=lambda r: r.start) for x in r.ids] == brute.ids(d.text)
        docs = spark.createDataFrame(after, made.schema)
        before = after


def test_run_and_entry(spark):
    assert corpus_pipeline.run(spark, TESTDATA).count() > 100
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_take_odd_rows(spark):
    data = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (None, "x y z", None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, TESTDATA).collect() is not None
