"""Ordered access by key: seeks, reverse scans, pages, walks, and scans with counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..work import free, written


def seek(df: DataFrame, key: str, k, which: str) -> DataFrame:
    """The row of the floor (<= k), lower (< k), ceiling (>= k) or higher (> k) key, or none: a partial top 1."""
    c = F.col(f"`{key}`")
    tests = {"floor": c <= k, "lower": c < k, "ceiling": c >= k, "higher": c > k}
    if which not in tests:
        raise ValueError(f"no seek {which!r}")
    return df.where(tests[which]).orderBy(c.desc() if which in ("floor", "lower") else c.asc()).limit(1)


def first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(f"`{key}`").asc_nulls_first()).limit(1)


def last(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(f"`{key}`").desc_nulls_last()).limit(1)


def page(df: DataFrame, key: str, skip: int, take: int, reverse: bool = False) -> DataFrame:
    """By position: costs a partial top of skip + take rows. For walks, next_page costs take."""
    c = F.col(f"`{key}`")
    return df.orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_first()).offset(skip).limit(take)


def next_page(df: DataFrame, key: str, after, take: int, reverse: bool = False) -> DataFrame:
    """The rows after a unique key: a range predicate that is pushed to the files, then a partial top of take rows."""
    c = F.col(f"`{key}`")
    rows = df if after is None else df.where(c < after if reverse else c > after)
    return rows.orderBy(c.desc() if reverse else c.asc()).limit(take)


def walk(df: DataFrame, key: str, take: int, reverse: bool = False) -> Iterator[list]:
    """Pages of rows until none is left: one ordered pass, of which a task's rows are held at a time. To go on elsewhere, use next_page."""
    c = F.col(f"`{key}`")
    rows = df.orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_first()).toLocalIterator(prefetchPartitions=True)
    while page := list(islice(rows, take)):
        yield page


def bounds_below(value: Column, bounds: list[Column], inclusive: bool = False, fine: int = 16) -> Column:
    """How many of the sorted literal bounds are below value (or equal, if inclusive): among every fine-th of every fine-th first, so that few are looked at."""
    if not bounds:
        return F.lit(0)
    levels = [bounds]
    while len(levels[-1]) > fine:
        levels.append(levels[-1][::fine])
    below = F.lit(0)
    for level in reversed(levels):
        base = F.greatest(below - 1, F.lit(0)) * fine
        below = base + F.size(F.filter(F.slice(F.array(*level), base + 1, F.lit(fine)), lambda b: b <= value if inclusive else b < value))
    return below


def ranged(df: DataFrame, order: list[Column], part: str, name: str) -> DataFrame:
    """df as a table written in ranges of this order, with the number of its range in column part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), name)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows with their places from 1 in this order: places within written ranges of keys, after the counts of the ranges before."""
    part, count, base, inner = free([*df.columns, name], "part", "count", "base", "inner")
    table = ranged(df, order, part, "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = table.groupBy(part).agg(F.count("*").alias(count)).select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    within = table.withColumn(inner, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return within.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(inner)).select(*(f"`{c}`" for c in df.columns), name)


def counted(df: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """df, and an observation with rows and the bytes of its string and binary columns, there once df has been read."""
    seen = Observation(name)
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(0).cast("long")
    for w in wide:
        size = size + F.coalesce(w, F.lit(0))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen
