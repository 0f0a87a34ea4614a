"""Planner statistics of an index: counts, distinct values, bounds, equi-depth histograms, selectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

BUCKETS = 64


def summary(index: DataFrame, columns: list[str]) -> DataFrame:
    """entries, nulls (any column null), min_key, max_key, in one pass."""
    anything = F.lit(False)
    for c in columns:
        anything = anything | F.col(c).isNull()
    key = F.struct(*columns)
    whole = F.when(~anything, key)
    return index.agg(F.count("*").alias("entries"), F.count_if(anything).alias("nulls"), F.min(whole).alias("min_key"), F.max(whole).alias("max_key"))


def distinct_sketch(index: DataFrame, column: Column, lg_k: int = 12) -> DataFrame:
    """A mergeable sketch of 4096 registers of the distinct values (hll_union_agg merges, hll_sketch_estimate reads)."""
    return index.agg(F.hll_sketch_agg(column.cast("string"), lg_k).alias("sketch"))


def distinct_estimate(index: DataFrame, column: Column) -> DataFrame:
    return index.agg(F.approx_count_distinct(column, 0.016).alias("distinct_values"))


def histogram(index: DataFrame, column: str, buckets: int = BUCKETS, closed: bool = True) -> DataFrame:
    """(bound, cumulative): every quota-th value in order, quota = ceil(n / buckets), 1 if n <= buckets; closed adds the last.

    Order comes from counts of distinct values, whose running sums are taken in ranges of values, so
    that no task sorts the whole index; the sums of ranges are a row each.
    """
    n = index.count()
    quota = 1 if n <= buckets else -(-n // buckets)
    counts = index.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = scan.ranged(counts, [F.col("value").asc_nulls_first()], "part", "value-counts")
    bases = ranged.groupBy("part").agg(F.sum("n").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("inner", F.sum("n").over(before)).join(F.broadcast(bases.select("part", "base")), "part").select("value", "n", (F.col("base") + F.col("inner")).alias("upto"))
    # the last position of each quota within a value's run, and the end of all
    first = F.col("upto") - F.col("n")
    steps = F.sequence(F.floor(first / quota) + 1, F.floor(F.col("upto") / quota))
    marks = upto.where(F.floor(F.col("upto") / quota) > F.floor(first / quota)).select(F.col("value").alias("bound"), F.explode(steps).alias("q")).select("bound", (F.col("q") * quota).alias("cumulative"))
    if closed and n % quota:
        marks = marks.unionByName(upto.where(F.col("upto") == n).select(F.col("value").alias("bound"), F.lit(n).cast("long").alias("cumulative")))
    return marks.select("bound", F.col("cumulative").cast("long").alias("cumulative"))


def rows_at_or_below(bounds: DataFrame, value) -> DataFrame:
    return bounds.where(F.col("bound").isNull() | (F.col("bound") <= value)).agg(F.coalesce(F.max("cumulative"), F.lit(0)).alias("rows"))


def selectivity(entries: int, distinct: int) -> float | None:
    """Share of entries that one value is expected to have; None if nothing is known."""
    if not entries:
        return None
    return (entries / distinct if distinct else entries) / entries


def most_selective(candidates: list[tuple[str, int, int]]) -> str | None:
    """Of (name, entries, distinct): the least selectivity, the first of equals; None if none has statistics."""
    rated = [(s, i, name) for i, (name, entries, distinct) in enumerate(candidates) if (s := selectivity(entries, distinct)) is not None]
    return min(rated)[2] if rated else None


def percentiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    return values.agg(F.percentile_approx(column, F.array(*(F.lit(s) for s in shares)), F.lit(10_000)).alias("percentiles"))


def opaque_count(df: DataFrame, type_column: str, known: list[str]) -> DataFrame:
    """How many values are of a type that isn't known here, by type: they are kept but neither compared nor indexed."""
    return df.where(~F.col(type_column).isin(known)).groupBy(type_column).agg(F.count("*").alias("values"))


def features(df: DataFrame, column: str) -> DataFrame:
    """Union of the feature bits of all rows."""
    return df.agg(F.bit_or(column).alias(column))
