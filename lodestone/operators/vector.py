"""Vector search: exact distances in double precision by DataFrame functions, filters before the top k; tables of queries; lists around centroids and product quantisers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import decode_codebook, encode_codebook
from ..work import written
from . import scan

METRICS, QUERIES = ("l2", "dot", "cosine"), 4096


def _sum(column: Column, f) -> Column:
    return F.aggregate(F.transform(column, f), F.lit(0.0), lambda s, x: s + x)


def distance(column: Column, query: list[float], metric: str = "l2") -> Column:
    """l2 is the root; dot the negated inner product; cosine 1 - cos, and 1 if a norm is 0. Another dimension is an error."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    q = F.array(*(F.lit(float(x)) for x in query))
    checked = F.when(F.size(column) == len(query), column).otherwise(F.raise_error(F.lit(f"a vector has not {len(query)} dimensions")).cast("array<float>"))
    pairs = F.zip_with(checked, q, lambda a, b: F.struct(a.cast("double").alias("a"), b.alias("b")))
    dot = _sum(pairs, lambda p: p["a"] * p["b"])
    if metric == "dot":
        return -dot
    if metric == "l2":
        return F.sqrt(_sum(pairs, lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"])))
    norms = F.sqrt(_sum(pairs, lambda p: p["a"] * p["a"])) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot / norms)


def search(df: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None, id_col: str = "_id", vector: str = "embedding") -> DataFrame:
    """id, distance of the k nearest, then by id: partial top k in each task, no sort of the whole."""
    rows = df if where is None else df.where(where)
    return rows.where(F.col(vector).isNotNull()).select(id_col, distance(F.col(vector), query, metric).alias("distance")).orderBy("distance", id_col).limit(max(0, k))


def _far(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances (a row a query) as distance() has them."""
    dot = queries @ vectors.T
    if metric == "dot":
        return -dot
    if metric == "l2":
        return np.sqrt(((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1.0, norms))


def _matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    size = size if size is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != size).any():
        raise ValueError(f"a vector has not {size} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def search_many(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "_id", vector: str = "embedding", query_id: str = "query_id", block: int = QUERIES) -> DataFrame:
    """query_id, id, distance of the k nearest to each of a table of queries, by distance, then id, against all rows.

    Queries go to the rows in blocks of at most `block`, each one scan; every task keeps k rows a query of each batch, so k of them a query and
    batch are shuffled."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = scan.numbered(queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")), [F.col("q").asc_nulls_first()], "n")
    asked = written(asked, "queries")
    found, many = None, asked.count()
    for b in range(-(-many // block)):
        table = asked.where((F.col("n") > b * block) & (F.col("n") <= (b + 1) * block)).select("q", "v").toArrow()
        sent = df.sparkSession.sparkContext.broadcast((table["q"].to_numpy(), _matrix(table["v"].combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            for batch in batches:
                for low in range(0, batch.num_rows, 2048):
                    part = batch.slice(low, 2048)
                    ids, vectors = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), wanted.shape[1])
                    for q in range(0, len(names), 32):
                        far = _far(vectors, wanted[q : q + 32], metric)
                        out = [(np.lexsort((ids, d))[:k]) for d in far]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[q : q + 32], [len(o) for o in out])), pa.array(np.concatenate([ids[o] for o in out])), pa.array(np.concatenate([d[o] for d, o in zip(far, out)]))], names=["query_id", "id", "distance"])

        part = rows.mapInArrow(run, "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", F.col("id").alias(id_col), "distance", "place")


# --- approximate search: lists around centroids, true distances ------------------------------


def train_centroids(df: DataFrame, lists: int, vector: str = "embedding", sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """k-means of at most `sample` rows, chosen by a hash of their vectors; it only says where rows are kept, never a distance."""
    table = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(sample).toArrow()
    x = _matrix(table["v"].combine_chunks())
    return _kmeans(x, lists, rounds)


def _kmeans(x: np.ndarray, many: int, rounds: int) -> np.ndarray:
    r = np.random.default_rng(5)
    centres = x[r.choice(len(x), min(many, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(len(centres)):
            if (own := near == c).any():
                centres[c] = x[own].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def assign_lists(df: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every row of df that has a vector, with the number of its list."""
    at, schema = df.columns.index(vector), T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column(at), sent.value.shape[1]), sent.value) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=schema.names)

    return df.where(F.col(f"`{vector}`").isNotNull()).mapInArrow(run, schema)


def save_lists(df: DataFrame, path: str, lists: int = 64, vector: str = "embedding", **how) -> np.ndarray:
    """Writes rows by lists, sorted, so that a search reads the lists it asks for; returns the centroids, which are stored beside as a codebook."""
    centroids = train_centroids(df, lists, vector, **how)
    assign_lists(df, centroids, vector).repartitionByRange("list").sortWithinPartitions("list").write.parquet(f"{path}/rows")
    book = encode_codebook(centroids[None, :, :].astype(np.float32), "none")
    df.sparkSession.createDataFrame([(book,)], "book binary").write.parquet(f"{path}/book")
    return centroids


def search_lists(spark: SparkSession, path: str, query: list[float], k: int, probes: int = 48, metric: str = "l2", where: Column | None = None, id_col: str = "_id", vector: str = "embedding") -> DataFrame:
    """As search, among the rows of the `probes` lists whose centroids are nearest to the query: true distances, some neighbours may be missed.
    With as many probes as lists it is exact."""
    _, book = decode_codebook(spark.read.parquet(f"{path}/book").first()["book"])
    centroids = book[0].astype(np.float64)
    wanted = np.argsort(_far(centroids, np.array([query], np.float64), metric if metric != "dot" else "l2")[0], kind="stable")[:probes].tolist()
    return search(spark.read.parquet(f"{path}/rows").where(F.col("list").isin(wanted)), query, k, metric, where, id_col, vector)


def train_codebook(df: DataFrame, subspaces: int, centroids: int = 256, vector: str = "embedding", sample: int = 20_000, rounds: int = 8) -> bytes:
    """A product quantiser's codebook, trained on at most `sample` rows."""
    table = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(sample).toArrow()
    x = _matrix(table["v"].combine_chunks())
    if x.shape[1] % subspaces:
        raise ValueError("dimensions must be a multiple of the subspaces")
    parts = [_kmeans(p, centroids, rounds) for p in np.split(x, subspaces, axis=1)]
    return encode_codebook(np.stack(parts).astype(np.float32))


def quantise(df: DataFrame, book: bytes, vector: str = "embedding", out: str = "code") -> DataFrame:
    """df with a byte a subspace: the number of its nearest centroid."""
    at, schema = df.columns.index(vector), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = decode_codebook(book)[1].astype(np.float64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(at), centroids.shape[0] * centroids.shape[2])
                codes = np.stack([_nearest(p, c) for p, c in zip(np.split(x, len(centroids), axis=1), centroids)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=schema.names)

    return df.where(F.col(f"`{vector}`").isNotNull()).mapInArrow(run, schema)


def dequantise(column: Column, scale: float, zero: float) -> Column:
    return F.transform(column, lambda x: x.cast("double") * scale + zero)


def decode_f16(df: DataFrame, data: str, out: str = "embedding") -> DataFrame:
    """Little-endian half floats in a binary column as array<float>."""
    at = df.columns.index(data)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` array<float>"])

    def run(batches):
        for batch in batches:
            lists = [None if x is None else np.frombuffer(x, "<f2").astype(np.float32).tolist() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def assign_slots(ids: DataFrame, used: DataFrame | None = None, id_col: str = "_id") -> DataFrame:
    """(slot, id): new ids get slots after the highest used, in order of ids; slot 0 is never used. Numbered within ranges of ids, whose counts are a row each."""
    fresh, base = ids.select(id_col).distinct(), 0
    if used is not None:
        fresh = fresh.join(used, id_col, "left_anti")
        base = used.agg(F.max("slot")).first()[0] or 0
    made = scan.numbered(fresh, [F.col(id_col).asc_nulls_first()], "slot").select((F.col("slot") + base).cast("long").alias("slot"), id_col)
    return made if used is None else used.select("slot", id_col).unionByName(made)


def verify_maps(slot_of: DataFrame, id_of: DataFrame, id_col: str = "_id") -> DataFrame:
    """Pairs that only one of the two maps (slot, id) has."""
    a, b = slot_of.select("slot", id_col), id_of.select("slot", id_col)
    return a.exceptAll(b).withColumn("finding", F.lit("only slot to id")).unionByName(b.exceptAll(a).withColumn("finding", F.lit("only id to slot")))
