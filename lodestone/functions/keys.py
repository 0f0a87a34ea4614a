"""Order-preserving keys as a column: for fields of mixed types, which no typed column can hold in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import DocId, KeyRange, Num, decode_key, encode_key

#: What Arrow types stand for as numbers.
_WIDTHS = {"int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "float": "f32", "double": "f64"}


def _reader(kind: pa.DataType) -> Callable:
    """Turns values of a column into the store's."""
    width = _WIDTHS.get(str(kind))
    if width:
        return lambda x: None if x is None else Num(x, width)
    if pa.types.is_list(kind):
        inner = _reader(kind.value_type)
        return lambda x: None if x is None else [inner(v) for v in x]
    if pa.types.is_struct(kind):  # one of several typed fields: the first that isn't null
        parts = [(f.name, _reader(f.type)) for f in kind]
        return lambda x: next((r(x[n]) for n, r in parts if x and x[n] is not None), None)
    return lambda x: x


def with_key(df: DataFrame, columns: list[str], id_col: str | None = None, out: str = "key") -> DataFrame:
    """df with the key of an array of its columns' values, and of the document id at the end if one is named.

    A struct column is a value of mixed type: its first field that isn't null.
    """
    at = [df.columns.index(c) for c in columns]
    id_at = None if id_col is None else df.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers = [_reader(batch.schema.field(i).type) for i in at]
            values = [[r(x) for x in batch.column(i).to_pylist()] for r, i in zip(readers, at)]
            if id_at is not None:
                values.append([DocId(x) for x in batch.column(id_at).to_pylist()])
            keys = [encode_key(list(row)) for row in zip(*values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` binary"])
    return df.mapInArrow(run, schema)


def in_range(key: Column, wanted: KeyRange) -> Column:
    """Half-open, on bytes: pushed to files that are sorted by key."""
    low = F.lit(True) if not wanted.lower else key >= F.lit(wanted.lower)
    return low if wanted.upper is None else low & (key < F.lit(wanted.upper))


def id_of(df: DataFrame, key: str = "key", out: str = "_id") -> DataFrame:
    """df with the document id that ends each key."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [decode_key(x)[-1].value for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` long"])
    return df.mapInArrow(run, schema)
