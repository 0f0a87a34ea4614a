"""Document fingerprints: canonical exact digests, by DataFrame functions alone.

A text's canonical form is its NFKC normalisation with full case folding (both by the ICU
library that Spark ships, called through reflect) and runs of white space as one space,
trimmed. Two 64-bit xxhashes of it make a 128-bit bucket. Inside a bucket the canonical bytes are compared:
least and greatest text of a bucket are kept while aggregating, before and after the
shuffle, so a group of any number of copies sends one row a task. A bucket whose least and
greatest differ holds different texts; there the fingerprint gets the rank of the text.

Equal texts thus have equal fingerprints, and different canonical texts different ones.

Defined results: a null text counts as empty; repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ICU = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    filled = F.coalesce(text, F.lit(""))
    call = lambda *a: F.call_function("reflect", *(x if isinstance(x, Column) else F.lit(x) for x in a))
    normal = call(_ICU[0], "compose", filled, True)
    folded = call(_ICU[0], "compose", call(_ICU[1], "foldCase", normal, True), True)
    plain = F.when(filled.rlike("[^\\x00-\\x7f]"), folded).otherwise(F.lower(filled))
    return F.trim(F.regexp_replace(plain, "[\\s\\p{Z}\\x1c-\\x1f\\x85]+", " "))


def hashes(canon: Column) -> list[Column]:
    """Two independent xxhashes: the second is salted."""
    return [F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)]


def as_text(h1: Column, h2: Column, rank: Column) -> Column:
    wide = F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))
    return F.when(rank > 0, F.concat(wide, F.lit("-"), rank.cast("string"))).otherwise(wide)


def shared_buckets(digests: DataFrame) -> DataFrame:
    """(h1, h2) of the buckets with several rows."""
    return digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")


def collisions(rows: DataFrame) -> DataFrame:
    """Of (h1, h2, canon): each canonical text of a bucket that holds different ones, with its rank from 0 by bytes."""
    from pyspark.sql import Window

    spread = rows.groupBy("h1", "h2").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("h1", "h2")
    texts = rows.join(spread, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "canon").agg(F.count("*").alias("n"))
    return texts.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1).drop("n")


def ranked(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows with column fingerprint; clashes are the few texts whose bucket holds others."""
    return rows.join(clashes, ["h1", "h2", "canon"], "left").withColumn("fingerprint", as_text(F.col("h1"), F.col("h2"), F.coalesce("rank", F.lit(0)))).drop("rank")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), canonical(docs[f"`{text}`"]).alias("canon"))
    rows = rows.select("doc_id", "canon", *(h.alias(n) for n, h in zip(("h1", "h2"), hashes(F.col("canon")))))
    shared = shared_buckets(rows.select("h1", "h2"))
    clashes = collisions(rows.select("h1", "h2", "canon").join(shared, ["h1", "h2"], "left_semi"))
    return ranked(rows, clashes).select("doc_id", "fingerprint")
