"""The change feed: an ordered log of puts, deletes and range deletes of chosen trees, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETAIN = 100_000


def feed_of(log: DataFrame, trees: list[int]) -> DataFrame:
    """tree_id, seq, op, key of the trees that have the feed on; it is off for all others."""
    return log.where(F.col("tree_id").isin(trees) if trees else F.lit(False)).select("tree_id", "seq", "op", "key")


def read(feed: DataFrame, tree_id: int, from_seq: int, to_seq: int | None = None) -> DataFrame:
    """Changes of [from_seq, to_seq) of one tree, in order."""
    out = feed.where((F.col("tree_id") == tree_id) & (F.col("seq") >= from_seq))
    return (out if to_seq is None else out.where(F.col("seq") < to_seq)).orderBy("seq")


def retain(feed: DataFrame, by_seq: int = RETAIN, written: str | None = None, now_ms: int | None = None, by_ms: int | None = None) -> DataFrame:
    """What stays: not further than by_seq behind the newest and not older than by_ms, whichever comes first."""
    newest = feed.agg(F.max("seq")).first()[0]
    if newest is None:
        return feed
    out = feed.where(F.col("seq") >= newest - by_seq)
    return out if by_ms is None else out.where(F.col(written) >= now_ms - by_ms)


def stream(spark: SparkSession, path: str, schema: T.StructType, tree_id: int | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The log's folder as a stream; each file once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)
    return rows if tree_id is None else rows.where(F.col("tree_id") == tree_id)


def deliver(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Calls handle with each batch of changes, in order within it; a batch that comes again has its old number, so handlers can skip it."""
    query = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(batch.dropDuplicates(["tree_id", "seq"]).sortWithinPartitions("tree_id", "seq"), n))
    return (query.trigger(availableNow=True) if once else query).start()


def latest_state(spark: SparkSession, changes: DataFrame, target: str, checkpoint: str):
    """Keeps the newest change of each key: every batch is reduced to one row a key and joined to what is there, in a new numbered folder."""

    def handle(batch: DataFrame, n: int) -> None:
        from ..operators.versions import newest

        fresh = newest(batch)
        if n:
            fresh = newest(fresh.unionByName(spark.read.parquet(f"{target}/batch={n - 1:09d}")))
        fresh.write.mode("overwrite").parquet(f"{target}/batch={n:09d}")

    return deliver(changes, handle, checkpoint)
