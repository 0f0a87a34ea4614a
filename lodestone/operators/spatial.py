"""Spatial search over WKB columns: boxes first, by pushed-down comparisons, then exact predicates on what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..work import free

BOX = ["xmin", "ymin", "xmax", "ymax"]


#: A little-endian point of two coordinates.
_POINT, _POINT_BYTES = b"\1\1\0\0\0", 21


def _boxes(shapes: list[bytes | None], dims: int) -> list:
    """Points are taken all at once; other geometries one by one."""
    out: list = [None] * len(shapes)
    points = [i for i, x in enumerate(shapes) if x is not None and len(x) == _POINT_BYTES and x[:5] == _POINT] if dims == 2 else []
    for i, xy in zip(points, np.frombuffer(bytearray(b"".join(shapes[i][5:] for i in points)), "<f8").reshape(-1, 2).tolist()):
        if xy[0] == xy[0] and xy[1] == xy[1]:
            out[i] = (*xy, *xy)
    known = set(points)
    for i, x in enumerate(shapes):
        if x is not None and i not in known:
            out[i] = G.envelope(G.decode(x), dims)
    return out


def with_boxes(df: DataFrame, wkb: str = "geom", dims: int = 2) -> DataFrame:
    """df with the box of each geometry (null where empty): stored beside it, it prunes files and row groups."""
    names = BOX if dims == 2 else ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"] if dims == 3 else ["xmin", "ymin", "zmin", "mmin", "xmax", "ymax", "zmax", "mmax"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in names)])
    at = df.columns.index(wkb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = _boxes(batch.column(at).to_pylist(), dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([b and b[i] for b in boxes], pa.float64()) for i in range(2 * dims))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def encoded(df: DataFrame, shape: Callable[[object, float, float], G.Geometry], wkb: str = "geom") -> DataFrame:
    """Of (_id, x, y): _id, and as WKB the geometry that shape gives for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [G.encode(shape(*row)) for row in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["_id", wkb])

    return df.select("_id", "x", "y").mapInArrow(run, f"_id {df.schema['_id'].dataType.simpleString()}, {wkb} binary")


GRID = 16


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes geometries with their boxes (as with_boxes gives them) in the order of a space-filling curve over the centres of the boxes, so that files and
    row groups hold what lies close together and box predicates read few of them. Empty geometries come first. Returns the table as it is read back."""
    bounds = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in BOX)).first()
    (curve,) = free(df.columns, "curve")

    def cell(low: str, high: str):
        least, most = bounds[f"min_{low}"], bounds[f"max_{high}"]
        wide = (most - least) if least is not None and most > least else 1.0
        return F.least(F.lit((1 << GRID) - 1), F.floor(((F.col(low) + F.col(high)) / 2 - (least or 0.0)) / wide * (1 << GRID))).cast("long")

    place = F.lit(0).cast("long")
    for column, shift in ((cell("xmin", "xmax"), 0), (cell("ymin", "ymax"), 1)):
        for i in range(GRID):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(column, i).bitwiseAND(F.lit(1)), 2 * i + shift))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn(curve, place)
    placed.repartitionByRange(parts, F.col(curve).asc_nulls_first()).sortWithinPartitions(F.col(curve).asc_nulls_first()).drop(curve).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def box_meets(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Boxes that share a point with the query's; a null box never does."""
    return (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)


def box_within(x0: float, y0: float, x1: float, y1: float) -> Column:
    return (F.col("xmin") >= x0) & (F.col("xmax") <= x1) & (F.col("ymin") >= y0) & (F.col("ymax") <= y1)


def candidates(df: DataFrame, query: G.Geometry, grow: float = 0.0) -> DataFrame:
    found = G.envelope(query)
    if found is None:
        return df.where(F.lit(False))
    x0, y0, x1, y1 = found
    return df.where(box_meets(x0 - grow, y0 - grow, x1 + grow, y1 + grow))


def _refine(df: DataFrame, wkb: str, keep: Callable[[G.Geometry], bool]) -> DataFrame:
    at = df.columns.index(wkb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keep(G.decode(x)) for x in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def intersects(df: DataFrame, query: G.Geometry, wkb: str = "geom") -> DataFrame:
    return _refine(candidates(df, query), wkb, lambda g: G.intersects(g, query))


def within(df: DataFrame, query: G.Geometry, wkb: str = "geom") -> DataFrame:
    """Stored geometries that the query covers."""
    found = G.envelope(query)
    return _refine(df.where(box_within(*found) if found else F.lit(False)), wkb, lambda g: G.contains(query, g))


def contains(df: DataFrame, query: G.Geometry, wkb: str = "geom") -> DataFrame:
    """Stored geometries that cover the query."""
    return _refine(candidates(df, query), wkb, lambda g: G.contains(g, query))


def with_distance(df: DataFrame, query: G.Geometry, wkb: str = "geom") -> DataFrame:
    at = df.columns.index(wkb)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "distance double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [None if x is None else G.distance(G.decode(x), query) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.float64())], names=[*batch.schema.names, "distance"])

    return df.mapInArrow(run, schema)


def near(df: DataFrame, x: float, y: float, radius: float, wkb: str = "geom") -> DataFrame:
    return with_distance(candidates(df, G.point(x, y), radius), G.point(x, y), wkb).where(F.col("distance") <= radius)


def box_distance(x: float, y: float) -> Column:
    """Distance of a point to each box: never more than to the geometry in it."""
    dx = F.greatest(F.col("xmin") - x, F.lit(0.0), F.lit(x) - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - y, F.lit(0.0), F.lit(y) - F.col("ymax"))
    return F.sqrt(dx * dx + dy * dy)


def nearest(df: DataFrame, x: float, y: float, k: int, id_col: str = "_id", wkb: str = "geom") -> DataFrame:
    """(id, distance) of the k nearest, by exact distance, then id.

    The exact distances of the k nearest boxes bound the answer; only boxes within the bound are decoded.
    """
    if k <= 0:
        return with_distance(df, G.point(x, y), wkb).select(id_col, "distance").where(F.lit(False))
    boxed = df.where(F.col("xmin").isNotNull()).withColumn("low", box_distance(x, y))
    first = with_distance(boxed.orderBy("low", id_col).limit(k), G.point(x, y), wkb)
    bound = first.agg(F.max("distance").alias("d"), F.count("*").alias("n")).first()
    left = boxed.where(F.col("low") <= (bound.d if bound.n == k else float("inf")))
    return with_distance(left, G.point(x, y), wkb).select(id_col, "distance").orderBy("distance", id_col).limit(k)


# --- points, by DataFrame functions alone ---------------------------------------------------


def points_near(df: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """For columns x and y."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return df.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)).withColumn("distance", d).where(F.col("distance") <= radius)


def points_nearest(df: DataFrame, x: float, y: float, k: int, id_col: str = "_id") -> DataFrame:
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("distance", d).orderBy("distance", id_col).limit(max(0, k))


def verify(df: DataFrame, wkb: str = "geom") -> DataFrame:
    """Rows whose stored box isn't that of their geometry."""
    again = with_boxes(df.drop(*BOX), wkb).select(*df.columns)
    return df.exceptAll(again)
