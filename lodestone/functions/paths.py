"""Field paths and what they reach in nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ENTRIES = 1024


def split_path(path: str) -> list[str]:
    """Names of a path: a dot separates, \\. is a dot and \\\\ a backslash; any other escape is an error."""
    names, name, at = [], "", 0
    while at < len(path):
        c = path[at]
        if c == "\\":
            if path[at + 1 : at + 2] not in (".", "\\") or at + 1 == len(path):
                raise ValueError(f"a path may escape only a dot or a backslash: {path!r}")
            name += path[at + 1]
            at += 2
        elif c == ".":
            names.append(name)
            name, at = "", at + 1
        else:
            name += c
            at += 1
    return [*names, name]


def _field(kind: T.DataType, name: str) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        return kind[name].dataType if name in kind.names else None
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return kind.valueType
    return None


def resolve(df: DataFrame, path: str) -> tuple[Column, T.DataType, bool] | None:
    """(column, type, whether it is an array of values) that a path reaches; None if the schema has no such field.

    Arrays on the way apply the rest of the path to each element and flatten; an array at the
    end yields its elements.
    """
    first, *rest = split_path(path)
    if first not in df.columns:
        return None
    column, kind, many = F.col(f"`{first}`"), df.schema[first].dataType, False

    def flat(column, kind, many):
        while isinstance(kind, T.ArrayType):
            column = F.flatten(F.filter(column, lambda x: x.isNotNull())) if many else column
            kind, many = kind.elementType, True
        return column, kind, many

    def member(name):
        return lambda x: x.getField(name)

    for name in rest:
        column, kind, many = flat(column, kind, many)
        inner = _field(kind, name)
        if inner is None:
            return None
        column = F.transform(column, member(name)) if many else column.getField(name)
        kind = inner
    return flat(column, kind, many)


def values_of(df: DataFrame, path: str, sparse: bool = False) -> tuple[Column, T.DataType]:
    """Array of the distinct values under a path, as an index sees them.

    Absent and null give one null; a sparse index has none for a missing field (a field whose
    column is null, as typed rows don't tell absent from null); an empty array gives none.
    """
    found = resolve(df, path)
    if found is None:
        nothing = F.array().cast("array<string>") if sparse else F.array(F.lit(None).cast("string"))
        return nothing, T.StringType()
    column, kind, many = found
    one = F.array(F.lit(None).cast(kind))
    if many:
        return F.when(column.isNull(), F.array().cast(T.ArrayType(kind)) if sparse else one).otherwise(F.array_distinct(column)), kind
    if sparse:
        return F.when(column.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(column)), kind
    return F.array(column), kind


def expand(df: DataFrame, id_col: str, paths: list[str], sparse: bool = False, most: int = MOST_ENTRIES) -> DataFrame:
    """Index entries v1..vk, _id of each document: the product of the values of its fields; over `most` is an error.

    Fields that hold one value are columns as they are, so that predicates on them reach the scan; only arrays are exploded."""
    found = [resolve(df, p) for p in paths]
    ident, out = F.col(f"`{id_col}`").cast("long"), df
    for p, f in zip(paths, found):
        if sparse:
            out = out.where(f[0].isNotNull() if f else F.lit(False))
    many = {i: values_of(df, p, sparse)[0] for i, (p, f) in enumerate(zip(paths, found)) if f and f[2]}
    size = F.lit(1).cast("long")
    for a in many.values():
        size = size * F.size(a)
    if many:
        ident = F.when(size > most, F.raise_error(F.concat(F.lit(f"more than {most} index entries for document "), ident.cast("string"))).cast("long")).otherwise(ident)
    one = lambda f: f[0] if f else F.lit(None).cast("string")
    out = out.select(ident.alias("_id"), *((many[i] if i in many else one(f)).alias(f"v{i + 1}") for i, f in enumerate(found)))
    for i in many:
        out = out.withColumn(f"v{i + 1}", F.explode(f"v{i + 1}"))
    return out.select(*(f"v{i + 1}" for i in range(len(paths))), "_id")
