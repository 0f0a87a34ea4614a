"""Benchmark decontamination by winnowing.

Of the hashes of all runs of K words, each window of W = SPAN - K + 1 neighbours keeps its
least (the rightmost of equals). Two texts that share SPAN words share all hashes of one
window and so keep the same hash: no span of SPAN words or more is missed. The kept hashes
of documents are looked up among those of the test items, and each hit is extended to both
sides word by word; only what reaches SPAN words counts. Items of fewer words can't be
guaranteed by a window, so their whole word sequence is looked up at each position.

The items' fingerprints are sent to the executors in blocks of at most `block_bytes` of
item text; each block is one scan of the documents, and a document's spans and items of all
blocks are united. One block is the usual case.

Defined results: null texts have no words; empty items match nothing; equal items and equal
documents are each reported; items with a null id are left out, or with `unnamed` count for spans and
hit words and have no name among the items; columns of the documents that are called as new ones are refused.
Words are compared by their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import annotate, refuse_clash
from .store import materialize
from .words import ALNUM, WordHasher, grams

SPAN, K = 10, 5


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, the rightmost of equals."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    picked = np.arange(len(seen)) + (window - 1) - seen.argmin(axis=1)
    return picked[np.concatenate(([True], picked[1:] != picked[:-1]))]


class Fingerprints:
    """Of test items: kept hashes of long ones, whole sequences of short ones."""

    def __init__(self, ids: list[str | None], words: list[np.ndarray], span: int, k: int):
        self.ids, self.span, self.k, self.window = ids, span, k, span - k + 1
        self.words = words
        found, item, at = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(words):
            if len(w) >= span:
                g = grams(w, k)
                p = winnow(g, self.window)
                found.append(g[p])
                item.append(np.full(len(p), i))
                at.append(p)
            elif len(w):
                key = int(grams(w, len(w))[0])
                self.short.setdefault(len(w), {}).setdefault(key, []).append(i)
        found = np.concatenate([*found, np.empty(0, np.uint64)])
        order = np.argsort(found, kind="stable")
        self.hash = found[order]
        self.item = np.concatenate([*item, np.empty(0, np.int64)])[order].astype(np.int64)
        self.at = np.concatenate([*at, np.empty(0, np.int64)])[order].astype(np.int64)
        self.short_keys = {m: np.sort(np.fromiter(x, np.uint64, len(x))) for m, x in self.short.items()}

    def match(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """(spans of words that are hit, numbers of items that occur)."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for m, keys in self.short_keys.items():
            g = grams(words, m)
            for p in np.flatnonzero(_among(g, keys)).tolist():
                spans.append((p, p + m))
                items.update(self.short[m][int(g[p])])
        if len(words) < self.span or not len(self.hash):
            return spans, items
        g = grams(words, self.k)
        picked = winnow(g, self.window)
        keys = g[picked]
        low = np.searchsorted(self.hash, keys, side="left")
        hit = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == keys)
        done: dict[tuple[int, int], int] = {}
        high = np.searchsorted(self.hash, keys[hit], side="right").tolist() if len(hit) else []
        for h, end in zip(hit.tolist(), high):
            p = int(picked[h])
            for e in range(int(low[h]), end):
                i, q = int(self.item[e]), int(self.at[e])
                if done.get((i, p - q), -1) > p:
                    continue
                w = self.words[i]
                back = min(p, q)
                same = words[p - back : p][::-1] == w[q - back : q][::-1]
                before = back if same.all() else int(same.argmin())
                ahead = min(len(words) - p, len(w) - q)
                same = words[p : p + ahead] == w[q : q + ahead]
                after = ahead if same.all() else int(same.argmin())
                done[i, p - q] = p + max(after, 1)
                if before + after >= self.span:
                    spans.append((p - before, p + after))
                    items.add(i)
        return spans, items


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int, unnamed: bool):
    """How many, and item ids and texts in blocks of about block_bytes of text; sizes are checked before anything is sent."""
    items = items.select(items[f"`{item_id}`"].cast("string").alias("id"), items[f"`{text}`"].alias("text")).where("text is not null" if unnamed else "id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count("*").alias("items")).first()
    n = max(1, min(size["items"], -(-(size["bytes"] or 0) // block_bytes)))
    return n, ((items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow() for k in range(n))


HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
    T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _marked(docs: DataFrame, text: str, keep: list[str], prefix: str, known) -> DataFrame:
    """docs' columns in keep and HITS, by the broadcast fingerprints of one block of items."""

    def make():
        items, hasher = known.value, WordHasher(ALNUM)

        def work(column):
            counts, starts, ends, found = [], [], [], []
            for _, part in hasher.texts(column):
                for words in part:
                    spans, hit = items.match(words)
                    spans = united(spans)
                    counts.append(len(words))
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    found.append(sorted({x for i in hit if (x := items.ids[i]) is not None}))
            kind = pa.list_(pa.int32())
            return [pa.array(counts, pa.int64()), pa.array(starts, kind), pa.array(ends, kind), pa.array(found, pa.list_(pa.string()))]

        return work

    return annotate(docs, [text], make, [T.StructField(prefix + f.name, f.dataType) for f in HITS], keep)


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, span: int = SPAN, k: int = K, block_bytes: int = 32 << 20, prefix: str = "", unnamed: bool = False) -> DataFrame:
    """Names of new columns begin with prefix. docs' columns in keep, n_words, the united spans of hit words (hit_starts, hit_ends; in words) and the ids of the items with occurring windows, sorted.

    With several blocks the documents are written once with a number a row; each block then
    yields the numbers of the rows it hits, and these are put to the rows by their numbers.
    """
    keep = docs.columns if keep is None else keep
    refuse_clash(keep, [prefix + f.name for f in HITS])
    count, blocks = _blocks(items, item_id, item_text, block_bytes, unnamed)
    sc = docs.sparkSession.sparkContext

    def known(table: pa.Table):
        words = [w for _, part in WordHasher(ALNUM).texts(table.column("text")) for w in part]
        return sc.broadcast(Fingerprints(table.column("id").to_pylist(), words, span, k))

    if count == 1:
        return _marked(docs, text, keep, prefix, known(next(blocks)))
    kept = F.struct(F.lit(0).alias("none"), *(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{text}`"].alias("text"), kept.alias("kept")), "numbered")
    found = None
    for number, table in enumerate(blocks):
        sent = known(table)
        part = _marked(rows, "text", ["row"], "", sent)
        part = materialize(part if number == 0 else part.where(F.size("hit_starts") > 0), "block-hits")  # the first counts words
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    hits = _united_blocks(found)
    out = rows.select("row", "kept").join(hits, "row")
    return out.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f.name).alias(prefix + f.name) for f in HITS))


def _united_blocks(found: DataFrame) -> DataFrame:
    """Of (row, HITS) of several blocks: a row each, with all its spans, united, and all its items."""
    out = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("hit_starts").alias("a"), F.col("hit_ends").alias("b"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (last["b"] >= x["a"]), longer).otherwise(F.concat(done, F.array(x)))

    out = out.withColumn("spans", F.aggregate("spans", empty, step))
    return out.select("row", "n_words", F.col("spans.a").alias("hit_starts"), F.col("spans.b").alias("hit_ends"), "items")


def hit_words(prefix: str = "") -> Column:
    """Number of hit words, from the columns of find_hits."""
    return F.aggregate(F.zip_with(prefix + "hit_ends", prefix + "hit_starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
