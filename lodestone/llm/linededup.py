"""Cross-site boilerplate lines, by DataFrame functions alone.

A line that stands on `min_sites` different sites or more is boilerplate and goes. Sites are
counted by a HyperLogLog sketch for each 128-bit line hash; sketches merge while aggregating,
before and after the shuffle, so a line of any number of documents sends one sketch a task.
Lines whose estimate is within MARGIN standard errors of the threshold get an exact distinct
count instead. Lines shorter than `min_chars` are left alone: short sentences repeat by chance.

Defined results: a null text stays null and has no lines; an empty text has one empty line; a
null site counts as one site of its own; rows equal in id and text lose the same lines; columns called
__lines or __removed are refused, all others stay as they are. Lines are
compared as they stand, by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import free, refuse_clash
from .store import discard, materialize

MIN_SITES, MIN_CHARS, LG_K, MARGIN = 10, 20, 12, 5.0


def _lines(docs: DataFrame, doc_id: str, site: str, text: str, min_chars: int) -> DataFrame:
    """A written table of each line that is long enough: id, hash (of the text), site, pos, h1, h2. Texts are cut and hashed once; all counts are taken from it."""
    parts = F.transform(F.split(docs[f"`{text}`"], "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    parts = F.filter(parts, lambda x: F.length(x["line"]) >= min_chars)
    key = [docs[f"`{doc_id}`"].alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("hash"), F.coalesce(docs[f"`{site}`"].cast("string"), F.lit("")).alias("site")]
    rows = docs.select(*key, F.explode(parts).alias("x"))
    return materialize(rows.select("id", "hash", "site", "x.pos", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit("line"), "x.line").alias("h2")), "lines")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines on min_sites sites or more, as a written table. lines: site, h1, h2."""
    error = MARGIN * 1.04 / 2 ** (lg_k / 2)
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    rated = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - error) - 1)
    rated = materialize(rated, "line-sites")
    near = rated.where(F.col("sites") <= min_sites * (1 + error) + 1)
    exact = lines.select("site", "h1", "h2").join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    clear = rated.where(F.col("sites") > min_sites * (1 + error) + 1)
    return materialize(clear.select("h1", "h2").unionByName(exact.select("h1", "h2")), "boilerplate")


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K) -> DataFrame:
    """All of docs' columns, text without boilerplate lines, and __lines and __removed, the numbers of lines before and taken away."""
    refuse_clash(docs.columns, ["__lines", "__removed"])
    lines = _lines(docs, doc_id, site, text, min_chars)
    hit = lines.drop("site").join(boilerplate(lines, min_sites, lg_k), ["h1", "h2"], "left_semi")
    own_id, own_hash, gone_id, gone_hash, places = free(docs.columns, "__id", "__hash", "__gone_id", "__gone_hash", "__gone")
    gone = hit.groupBy("id", "hash").agg(F.collect_set("pos").alias(places)).select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash), places)
    gone = materialize(gone, "gone")
    discard(lines)
    keyed = docs.withColumns({own_id: docs[f"`{doc_id}`"], own_hash: F.xxhash64(docs[f"`{text}`"])})
    same = keyed[own_id].eqNullSafe(gone[gone_id]) & (keyed[own_hash] == gone[gone_hash])
    out = keyed.join(gone.hint("shuffle_hash"), same, "left").drop(own_id, own_hash, gone_id, gone_hash)
    whole, taken = F.col(f"`{text}`"), F.col(places)
    parts = F.split(whole, "\n")
    count = lambda column, there: F.when(there, F.size(column)).otherwise(0).cast("long")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(taken, i)), "\n")
    out = out.withColumns({"__lines": count(parts, whole.isNotNull()), "__removed": count(taken, taken.isNotNull())})
    return out.withColumn(text, F.when(taken.isNotNull(), kept).otherwise(whole)).drop(places)
