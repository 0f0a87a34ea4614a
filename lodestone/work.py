"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER = "lodestone-work"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset and Spark runs in one JVM (tests), a temporary folder is made and
    set; where it is unset on a cluster this raises, as no local folder is visible to all.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:  # Spark's default file system, said in full for readers other than Spark
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = re.sub("^file:/(?!/)", "file:///", base)
    return base.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{FOLDER}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to new paths inside is deleted at the end; results go to a path made before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/{FOLDER}/" in folder:
            delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Deletes all work tables in the shared folder; call it when no returned DataFrame is needed any more."""
    delete(spark, f"{shared_dir(spark)}/{FOLDER}")


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with an underscore more in front while a column is called so."""
    taken, out = {x.lower() for x in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
