"""Presets of Spark settings for kinds of work. They tune; no preset changes a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILES: dict[str, dict[str, str]] = {
    "small": {"spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "32m"},
    "cluster": {"spark.sql.shuffle.partitions": "4000", "spark.sql.files.maxPartitionBytes": "256m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m"},
    "lookups": {"spark.sql.parquet.filterPushdown": "true", "spark.sql.files.maxPartitionBytes": "64m", "spark.sql.files.openCostInBytes": "1m"},
    "bulk_load": {"spark.sql.shuffle.partitions": "8000", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m"},
}


def apply(spark: SparkSession, name: str) -> dict[str, str]:
    """Sets a profile and returns what was set before."""
    if name not in PROFILES:
        raise ValueError(f"no profile {name!r}")
    before = {k: spark.conf.get(k) for k in PROFILES[name]}
    for k, v in PROFILES[name].items():
        spark.conf.set(k, v)
    return before


def write_sorted(df: DataFrame, path: str, key: str, bloom: list[str] | None = None) -> None:
    """Ranges of keys in files sorted by key, with Bloom filters for columns that are looked up by equality."""
    writer = df.repartitionByRange(key).sortWithinPartitions(key).write
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
