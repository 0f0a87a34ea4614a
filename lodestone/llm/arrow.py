"""Adds columns to a DataFrame from Python over Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..work import free

__all__ = ["annotate", "free", "lists", "ready", "refuse_clash"]

_ROOT = Path(__file__).resolve().parents[2]


def ready(spark: SparkSession) -> None:
    """Lets the executors' Python import this package: by path on one machine, as a shipped zip file on a cluster."""
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT) in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(_ROOT), *filter(None, paths)])
    if not sc.master.startswith("local["):
        target = Path(tempfile.mkdtemp()) / "lodestone.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in (_ROOT / "lodestone").rglob("*.py"):
                z.write(f, f.relative_to(_ROOT))
        sc.addPyFile(str(target))


def refuse_clash(columns: list[str], new: list[str]) -> None:
    if clash := {x.lower() for x in columns} & {x.lower() for x in new}:
        raise ValueError(f"columns {sorted(clash)} are there already; rename them or leave them out of keep")


def annotate(df: DataFrame, inputs: list[str], make: Callable, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """df's columns in keep (all by default) and the new fields.

    make() runs once a task and returns a function from the Arrow columns named in inputs to
    the Arrow columns of fields. fields whose names clash with kept columns are refused.
    """
    keep = df.columns if keep is None else keep
    refuse_clash(keep, [f.name for f in fields])
    wanted = [*keep, *(x for x in inputs if x not in keep)]
    schema = T.StructType([*(df.schema[x] for x in keep), *fields])
    at = [wanted.index(x) for x in inputs]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = work(*(batch.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=schema.names)

    ready(df.sparkSession)
    return df.select(*(df[f"`{x}`"] for x in wanted)).mapInArrow(run, schema)


def lists(values: list, kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array a row."""
    import numpy as np

    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
