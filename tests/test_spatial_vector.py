import math
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.operators import spatial, vector
from tests.conftest import rows

TRIANGLE = G.Geometry(G.POLYGON, (((0.0, 0.0), (12.0, 0.0), (0.0, 12.0), (0.0, 0.0)),))
DONUT = G.Geometry(G.POLYGON, (((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)), ((3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0), (3.0, 3.0))))


def line(*points):
    return G.Geometry(G.LINE, tuple((float(x), float(y)) for x, y in points))


@pytest.mark.parametrize("g", [G.point(1, 2), line((0, 0), (1, 1)), TRIANGLE, DONUT, G.Geometry(G.POINTS, ((1.0, 2.0), (3.0, 4.0))), G.Geometry(G.LINES, (((0.0, 0.0), (1.0, 1.0)),)), G.Geometry(G.POLYGONS, (TRIANGLE.content, DONUT.content)), G.Geometry(G.COLLECTION, (G.point(1, 2), TRIANGLE)), G.Geometry(G.POINT, (1.0, 2.0, 3.0, 4.0), "XYZM"), G.Geometry(G.POINT, (1.0, 2.0, 3.0), "XYM"), G.Geometry(G.POINT, ())])
def test_wkb_round_trip(g):
    assert G.decode(G.encode(g)) == g


def test_wkb_refusals():
    good = G.encode(G.point(1, 2))
    for bad in (good[:-1], good + b"\0", struct.pack("<BI", 1, 0x20000001) + good[5:], struct.pack("<BI", 1, 9) + good[5:], struct.pack("<BII", 1, 2, 10**9), b"\2" + good[1:]):
        with pytest.raises(G.WkbError):
            G.decode(bad)
    assert G.decode(struct.pack(">BIdd", 0, 1, 1.0, 2.0)) == G.point(1, 2)


def test_envelopes():
    assert G.envelope(DONUT) == (0, 0, 10, 10)
    assert G.envelope(G.Geometry(G.POINT, ())) is None
    assert G.envelope(G.Geometry(G.POINT, (1.0, 2.0, 3.0), "XYZ"), 3) == (1, 2, 3, 1, 2, 3)
    with pytest.raises(G.WkbError):
        G.envelope(G.point(1, 2), 3)


def test_predicates():
    assert G.intersects(DONUT, G.point(1, 1)) and not G.intersects(DONUT, G.point(5, 5))
    assert G.intersects(DONUT, G.point(3, 5)) and G.intersects(DONUT, line((5, 5), (5, 20)))
    assert not G.intersects(DONUT, line((4, 4), (6, 6)))
    assert G.contains(DONUT, G.point(0, 0)) and G.contains(DONUT, line((0, 0), (10, 0)))
    assert not G.contains(DONUT, line((1, 5), (9, 5))) and not G.contains(DONUT, G.box(2, 2, 8, 8))
    assert G.contains(DONUT, G.box(1, 1, 3, 3)) and G.contains(TRIANGLE, G.box(0, 0, 6, 6)) and not G.contains(TRIANGLE, G.box(0, 0, 7, 7))
    assert G.contains(line((0, 0), (2, 2)), G.point(1, 1)) and not G.contains(line((0, 0), (2, 2)), line((0, 0), (1, 1)))
    assert G.contains(G.point(1, 1), G.point(1, 1)) and not G.contains(G.point(1, 1), G.point(1, 2))
    assert not G.contains(TRIANGLE, G.Geometry(G.POINT, ()))
    assert G.contains(G.box(0, 0, 4, 4), G.Geometry(G.POINTS, ((1.0, 1.0), (4.0, 4.0))))


def test_distances():
    assert G.distance(G.point(0, 0), G.point(3, 4)) == 5
    assert G.distance(DONUT, G.point(5, 5)) == 2 and G.distance(DONUT, G.point(1, 1)) == 0
    assert G.distance(line((0, 0), (0, 10)), line((3, 5), (9, 5))) == 3
    assert G.distance(G.point(0, 0), G.Geometry(G.POINT, ())) == math.inf
    circle = G.circle(0, 0, 2, 64)
    assert len(circle.content[0]) == 65 and G.contains(circle, G.point(1.9, 0))
    with pytest.raises(ValueError):
        G.circle(0, 0, 1, 2)


@pytest.fixture(scope="module")
def shapes(spark):
    data = [(i, G.encode(G.point(i, i))) for i in range(50)] + [(100, G.encode(TRIANGLE)), (101, G.encode(G.Geometry(G.POINT, ()))), (102, None)]
    return spatial.with_boxes(spark.createDataFrame(data, "_id long, geom binary")).cache()


def ids(df):
    return [r._id for r in df.select("_id").orderBy("_id").collect()]


def test_search(shapes):
    assert ids(spatial.within(shapes, G.box(-1, -1, 3.5, 3.5))) == [0, 1, 2, 3]
    assert ids(spatial.contains(shapes, G.point(5, 6))) == [100]
    assert ids(spatial.contains(shapes, G.point(8, 8))) == [8]  # the triangle's box covers it, its area doesn't
    assert ids(spatial.near(shapes.where("_id < 100"), 0, 0, 5)) == [0, 1, 2, 3]
    assert ids(spatial.intersects(shapes, G.box(10, 10, 12, 12))) == [10, 11, 12]
    assert ids(spatial.candidates(shapes, G.box(10, 10, 12, 12))) == [10, 11, 12, 100]
    assert [tuple(r) for r in spatial.nearest(shapes, 20.2, 20.2, 2).collect()][0][0] == 20
    assert spatial.nearest(shapes, 0, 0, 0).count() == 0
    assert ids(spatial.nearest(shapes, 0, 0, 1000)) == [*range(50), 100]
    assert spatial.verify(shapes).count() == 0
    assert ids(spatial.intersects(shapes, G.Geometry(G.POINT, ()))) == []


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 21)] + [(99, None)], "_id long, embedding array<float>")


def test_vectors(vectors):
    top = lambda *a, **k: [r._id for r in vector.search(vectors, *a, **k).collect()]
    assert top([0.0, 0.0], 3) == [1, 2, 3]
    assert top([0.0, 0.0], 3, where=F.col("_id") % 2 == 0) == [2, 4, 6]
    assert top([1.0, 0.0], 2, "dot") == [20, 19]
    assert top([1.0, 0.0], 2, "cosine") == [1, 2]
    assert top([0.0, 0.0], 0) == []
    assert [r.distance for r in vector.search(vectors, [0.0, 0.0], 1, "cosine").collect()] == [1.0]
    with pytest.raises(Exception, match="dimensions"):
        vector.search(vectors, [0.0], 1).collect()
    with pytest.raises(ValueError):
        vector.search(vectors, [0.0, 0.0], 1, "l1")


def test_quantised_and_slots(spark, vectors):
    df = spark.createDataFrame([(1, bytes(memoryview(struct.pack("<2e", 1.5, -2.0))))], "_id long, q binary")
    assert vector.decode_f16(df, "q").first().embedding == [1.5, -2.0]
    first = vector.assign_slots(vectors.where("_id < 4"))
    assert rows(first) == [(1, 1), (2, 2), (3, 3)]
    more = vector.assign_slots(vectors.where("_id < 6"), first)
    assert rows(more) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert vector.verify_maps(first, more).count() == 2


def test_stored_shapes_lie_along_a_curve(spark, tmp_path):
    from lodestone.functions import geometry as G

    grid = spark.range(4096).selectExpr("id as _id", "double(id % 64) as x", "double(id div 64) as y")
    shapes = spatial.with_boxes(spatial.encoded(grid, lambda i, x, y: G.point(x, y)))
    stored = spatial.save(shapes.repartition(3), f"{tmp_path}/shapes")
    assert rows(stored.select("_id", *spatial.BOX)) == rows(shapes.select("_id", *spatial.BOX))
    files = [spark.read.parquet(f).agg(*(g(c) for c in ("xmin", "ymin") for g in (F.min, F.max))).first() for f in stored.inputFiles()]
    area = sum((f["max(xmin)"] - f["min(xmin)"] + 1) * (f["max(ymin)"] - f["min(ymin)"] + 1) for f in files)
    assert len(files) == 4 and area < 2 * 4096  # rows dealt at random would cover the square four times
    assert spatial.verify(stored).count() == 0
    none = spark.createDataFrame([(1, None)], "_id long, geom binary")
    assert spatial.save(spatial.with_boxes(none), f"{tmp_path}/none").count() == 1


def test_tables_of_queries_and_lists(spark, tmp_path):
    import numpy as np

    from lodestone.operators import vector

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 1, (80, 8)) for c in range(0, 40, 8)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "_id long, embedding array<float>")
    queries = df.where("_id % 50 = 0").selectExpr("_id as query_id", "embedding")
    for metric in vector.METRICS:
        far = {"l2": lambda q: np.sqrt(((x.astype(float) - q) ** 2).sum(1)), "dot": lambda q: -x.astype(float) @ q, "cosine": lambda q: 1 - x.astype(float) @ q / np.linalg.norm(x.astype(float), axis=1) / np.linalg.norm(q)}[metric]
        got = {}
        for g in vector.search_many(df, queries, 5, metric, block=3).collect():
            got.setdefault(g.query_id, {})[g.place] = g._id
        assert {q: [p[i] for i in range(1, 6)] for q, p in got.items()} == {q: np.lexsort((np.arange(len(x)), far(x[q].astype(float)).round(12)))[:5].tolist() for q in range(0, 400, 50)}
    vector.save_lists(df, f"{tmp_path}/lists", 10)
    assert spark.read.parquet(f"{tmp_path}/lists/rows").count() == 400
    near = [g._id for g in vector.search_lists(spark, f"{tmp_path}/lists", x[7].tolist(), 5, 10).collect()]
    assert near == [g._id for g in vector.search(df, x[7].tolist(), 5).collect()]
    book = vector.train_codebook(df, 4, 16)
    coded = vector.quantise(df, book).collect()
    assert len(coded) == 400 and all(len(c.code) == 4 and max(c.code) < 16 for c in coded)
    with pytest.raises(ValueError):
        vector.search_many(df, queries.limit(0), 5, "near")
    assert vector.search_many(df, queries.limit(0), 5).count() == 0
