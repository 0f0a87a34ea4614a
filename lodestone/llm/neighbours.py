"""Each document's edited text, whose end is taken from the next document, and fingerprints of both.

The next document in descending order of ids is found without one global window: the order (id, hash of
the text) is cut into ranges of about RANGE_BYTES of text, by the places of a bounded sample of rows, each
range is a window of its own, and the first row of each range is also put at the end of the range before it
(the first of all at the very end). Only the sample's places and the ranges' first ones, no texts, reach the
driver; they only say how rows are dealt. Rows of one id, or without any, are dealt to several ranges too.

Defined results: null texts count as empty; rows without an id come last; rows of equal ids follow
the hashes of their texts; a single row is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fingerprints import as_text, canonical, collisions, hashes
from .store import materialize

#: Bytes of text in a range; ranges at most (beyond, ranges are larger and sorted with spilling); rows of the sample for a range; steps of a search among bounds.
RANGE_BYTES, MOST_RANGES, SAMPLED, FINE = 64 << 20, 4096, 32, 16
PLACE = ["none", "nk", "th"]


def placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text (filled), and its place in descending order: none (no id), nk (complement of the id), th (hash of the text)."""
    key = docs[f"`{doc_id}`"].cast("long")
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), key.isNull().alias("none"), F.bitwise_not(F.coalesce(key, F.lit(0))).alias("nk"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def _bounds(rows: DataFrame) -> list[tuple]:
    """Places that cut the rows into ranges of about equal bytes."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    ranges = max(-(-(size["bytes"] or 0) // RANGE_BYTES), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["rows"]))
    ranges = min(MOST_RANGES, ranges)
    if ranges < 2:
        return []
    sample = rows.select(*PLACE, (F.octet_length("text") + 16).alias("b")).orderBy(F.rand(7)).limit(SAMPLED * ranges).collect()
    sample.sort(key=lambda r: tuple(r)[:3])
    step, at, out = sum(r.b for r in sample) / ranges, 0, []
    for r in sample:
        at += r.b
        if at >= step * (len(out) + 1) and len(out) < ranges - 1:
            out.append(tuple(r)[:3])
    return sorted(set(out))


def _range_of(place: Column, bounds: list[tuple]) -> Column:
    """How many bounds are below a place: among every FINE-th of every FINE-th bound first, so that few are looked at."""
    if not bounds:
        return F.lit(0)
    literal = lambda xs: F.array(*(F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("nk"), F.lit(c).cast("long").alias("th")) for a, b, c in xs))
    levels = [bounds]
    while len(levels[-1]) > FINE:
        levels.append(levels[-1][::FINE])
    below = F.lit(0)
    for level in reversed(levels):
        base = F.greatest(below - 1, F.lit(0)) * FINE
        below = base + F.size(F.filter(F.slice(literal(level), base + 1, F.lit(FINE)), lambda b: b < place))
    return below


def with_next(rows: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows of placed(), with what derive adds, and next_<column> for each of columns, of the row that follows. derive sees each row once, and the first of each range once more."""
    spark = rows.sparkSession
    bounds = _bounds(rows)
    place = F.struct(*PLACE)
    ranged = rows.withColumn("range", _range_of(place, bounds))
    heads = {r["range"]: tuple(r["head"]) for r in ranged.groupBy("range").agg(F.min(place).alias("head")).collect()}
    names = sorted(heads)
    moves = [(*heads[b], a, 0) for a, b in zip(names, names[1:])]
    if names:
        moves.append((*heads[names[0]], names[-1], 1))
    targets = spark.createDataFrame(moves, "none boolean, nk long, th long, range int, wrap int")
    first = rows.join(F.broadcast(targets), PLACE).groupBy(*PLACE, "range", "wrap").agg(F.min(F.struct("text", "doc_id")).alias("s"))
    ghosts = derive(first.select("s.doc_id", *PLACE, "s.text", "range", "wrap")).withColumn("ghost", F.lit(True))
    own = derive(ranged).withColumns({"wrap": F.lit(0), "ghost": F.lit(False)})
    after = Window.partitionBy("range").orderBy("wrap", *PLACE, "text")
    led = own.unionByName(ghosts).withColumns({f"next_{c}": F.lead(c).over(after) for c in columns})
    return led.where(~F.col("ghost")).drop("range", "wrap", "ghost")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Documents' fingerprints are the operator's, with its comparison of bytes in buckets that several rows share.
    Edited texts exist in one stage only, so whether those of a bucket are equal is told by the SHA-256 of
    their canonical bytes. Likeness of exact digests is 1 if they are equal, else 0.
    """
    rows = placed(docs, doc_id, text)

    def digest(df: DataFrame, column: str, *names: str) -> DataFrame:
        df = df.withColumn("canon", canonical(F.col(column)))
        return df.withColumns(dict(zip(names, [*hashes(F.col("canon")), F.sha2(F.col("canon").cast("binary"), 256)]))).drop("canon")

    led = with_next(rows, ["text", "h1", "h2", "sha"], lambda df: digest(df, "text", "h1", "h2", "sha"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    own = ["h1", "h2", "sha", "next_h1", "next_h2", "next_sha"]
    led = led.select("doc_id", "th", n.cast("long").alias("n_chars"), edited.alias("edited"), *own)
    led = digest(led, "edited", "e1", "e2", "esha")
    led = led.select("doc_id", "th", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *own, "e1", "e2", "esha")
    led = materialize(led, "digests")

    # Only texts of shared buckets are looked at a second time, by their bytes; copies are one row a task when buckets are counted.
    each = materialize(led.groupBy("h1", "h2", "th").agg(F.count("*").alias("n")), "buckets")
    shared = each.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    again = materialize(each.join(shared, ["h1", "h2"], "left_semi").select("th").distinct(), "shared-texts")
    texts = rows.select("th", "text").join(again, "th", "left_semi").select(canonical(F.col("text")).alias("canon"))
    texts = texts.select(*(h.alias(x) for h, x in zip(hashes(F.col("canon")), ("h1", "h2"))), "canon")
    differ = collisions(texts).select("h1", "h2", F.sha2(F.col("canon").cast("binary"), 256).alias("sha"))
    both = led.select("h1", "h2", "sha").unionByName(led.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("esha").alias("sha")))
    mixed = both.groupBy("h1", "h2").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("h1", "h2")
    clash = differ.unionByName(both.join(mixed, ["h1", "h2"], "left_semi")).distinct()
    clash = materialize(clash.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("sha")) - 1), "clashes")

    def named(df: DataFrame, prefix: str, out: str) -> DataFrame:
        a, b, s = {"own": ("h1", "h2", "sha"), "edited": ("e1", "e2", "esha"), "next": ("next_h1", "next_h2", "next_sha")}[prefix]
        c = clash.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("sha").alias("cs"), "rank")
        joined = df.join(c, (F.col(a) == F.col("c1")) & (F.col(b) == F.col("c2")) & (F.col(s) == F.col("cs")), "left")
        return joined.withColumn(out, as_text(F.col(a), F.col(b), F.coalesce("rank", F.lit(0)))).drop("c1", "c2", "cs", "rank")

    out = named(named(named(led, "own", "fingerprint"), "edited", "edited_fingerprint"), "next", "next_fingerprint")
    like = lambda x: (F.col("fingerprint") == F.col(x)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
