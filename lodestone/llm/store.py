"""Written tables in the folder that driver and executors share, with small batches for Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..work import discard, new_path, release, scratch, shared_dir

__all__ = ["discard", "materialize", "new_path", "release", "scratch", "shared_dir"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_RECORDS = 2000


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors.

    While it is written, Python gets at most MOST_RECORDS rows at once, as rows hold whole texts.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), MOST_RECORDS) if int(before) > 0 else MOST_RECORDS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
