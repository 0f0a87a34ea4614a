"""URL filters by a Bloom filter cascade.

Every rule that a URL of the corpus could meet, its host or a parent domain with as many labels as some
rule's host, with a prefix of its path that has the length of some rule's path, is a key; all keys are
the universe. Level 1 is a Bloom filter of the listed keys; level 2 holds the keys of the
universe that level 1 takes wrongly, level 3 the listed keys that level 2 takes, and so on,
until a level takes nothing wrongly. Asking the levels in turn until one says no is then
exact for every key of the universe, with no join.

Rates follow from counts: level 1 may take about a quarter as many other keys as there are listed ones,
however large the universe is, and level 2 nearly none of the listed. So the filters have at most
some 60 bits a rule, less than the rules themselves, which the caller holds; level 2 is made on the driver, from
about a quarter as many keys as there are rules. The corpus is read twice: its keys are counted,
and those that level 1 takes wrongly are found; neither shuffles its keys.

One cascade tells listed keys from others, a second one allow rules from block rules among the
listed. Keys are compared by 128 bits of xxhash.

Defined results: a null URL, or one without ://, has empty host and path and meets no rule; what no
rule fits is allowed (the list is one of rules; the cascade says "not listed"); a rule without a
host or with a null is refused; repeated rules count once, of a rule that both allows and blocks the block holds;
without rules all is allowed. Work on a URL grows with its length and the rules' different shapes, not with its number of labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import annotate
from .words import mix

#: Fixed values of the contract: (host, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> list[Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)://(.*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [host, path]


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (rule host, rule path), the longest first: of equal totals the longer host first. labels and lengths: those that rules have."""
    split = F.split(host, r"\.")
    wide = F.when(host == "", F.lit(0)).otherwise(F.size(split))
    hosts = F.transform(F.filter(F.array(*(F.lit(n) for n in labels)), lambda n: n <= wide), lambda n: F.array_join(F.slice(split, wide - n + 1, n), "."))
    sizes = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(sizes, lambda n: F.struct((F.length(h) + n).alias("total"), F.length(h).alias("hosted"), h.alias("host"), F.substring(path, F.lit(1), n).alias("path")))))
    return F.reverse(F.array_sort(pairs))


def key_hashes(host: Column, path: Column) -> list[Column]:
    return [F.xxhash64(host, path), F.xxhash64(F.lit("key"), host, path)]


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> list[np.ndarray]:
    a = mix(h1.view(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    b = mix(h2.view(np.uint64) + np.uint64(level)) | np.uint64(1)
    return [mix(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)]  # few bits need spots that depend on nothing else


@dataclass
class Level:
    bits: int
    hashes: int
    table: np.ndarray  # of bytes

    def has(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for x in _spots(h1, h2, number, self.hashes, self.bits):
            out &= (self.table[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: the first level that says no is of the other side, if its number is even."""
        out, left = np.zeros(len(h1), bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            yes = level.has(h1[left], h2[left], k)
            out[left[~yes]] = k % 2 == 1
            left = left[yes]
        out[left] = len(self.levels) % 2 == 1
        return out

    def size(self) -> int:
        return sum(len(x.table) for x in self.levels)


Keys = tuple[np.ndarray, np.ndarray]


def level(keys: Keys, number: int, rate: float) -> Level:
    """A Bloom filter of these keys that takes about this share of others."""
    n = max(1, len(keys[0]))
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bits += -bits % 64
    hashes = min(64, max(1, round(bits / n * math.log(2))))
    table = np.zeros(bits // 8, np.uint8)
    for x in _spots(*keys, number, hashes, bits):
        np.bitwise_or.at(table, (x >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (x & np.uint64(7)).astype(np.uint8)))
    return Level(bits, hashes, table)


def build_cascade(listed: Keys, others: int, taken: Callable[[Level], Keys]) -> Cascade:
    """listed: distinct keys. others: how many more keys the universe has at most. taken(level): those of them that level 1 takes, distinct."""
    n = max(1, len(listed[0]))
    first = level(listed, 0, min(0.5, n / (4 * max(1, others))))
    levels, sides = [first], [listed, taken(first)]
    while len(sides[len(levels) % 2][0]):
        k = len(levels)
        outside = sides[1 - k % 2]
        made = level(sides[k % 2], k, 1 / (64 * max(1, len(outside[0]))))
        wrong = made.has(*outside, k)
        sides[1 - k % 2] = (outside[0][wrong], outside[1][wrong])
        levels.append(made)
    return Cascade(levels)


def _taken(keys: DataFrame, listed: Keys) -> Callable[[Level], Keys]:
    """Finds the keys (h1, h2) of the corpus that a level takes, but for the listed ones: a filter in each task, then few rows."""

    def find(first: Level) -> Keys:
        sent = keys.sparkSession.sparkContext.broadcast((first.bits, first.hashes, first.table))

        def make():
            own = Level(*sent.value)
            return lambda a, b: [pa.array(own.has(a.to_numpy(), b.to_numpy(), 0))]

        found = annotate(keys, ["h1", "h2"], make, [T.StructField("in", T.BooleanType())]).where("in").select("h1", "h2").distinct().toArrow()
        sent.unpersist()
        h1, h2 = (found[x].to_numpy().astype(np.int64) for x in ("h1", "h2"))
        known = set(zip(*(x.tolist() for x in listed)))
        other = np.fromiter((x not in known for x in zip(h1.tolist(), h2.tolist())), bool, len(h1))
        return h1[other], h2[other]

    return find


def _rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    merged: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if not host or path is None or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {(host, path, verdict)}")
        key = (host.translate(str.maketrans(UPPER, LOWER)), path)
        merged[key] = "block" if "block" in (verdict, merged.get(key)) else "allow"
    rows = [(h, p, v) for (h, p), v in sorted(merged.items())]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = urls.sparkSession
    table = _rules_table(spark, rules)
    lengths = sorted({len(path) for _, path, _ in rules})
    labels = sorted({host.count(".") + 1 for host, _, _ in rules})
    host, path = host_and_path(urls[f"`{url}`"])
    rows = urls.select(urls[f"`{page_id}`"].alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    hashed = table.select(*(h.alias(n) for n, h in zip(("h1", "h2"), key_hashes(F.col("host"), F.col("path")))), "verdict").toArrow()
    every: Keys = (hashed["h1"].to_numpy(), hashed["h2"].to_numpy())
    blocks = np.array(hashed["verdict"].to_pylist()) == "block"
    side = lambda mask: (every[0][mask], every[1][mask])
    keys = rows.select(F.explode("keys").alias("k")).select(*(h.alias(n) for n, h in zip(("h1", "h2"), key_hashes(F.col("k.host"), F.col("k.path")))))
    universe = rows.agg(F.sum(F.size("keys"))).first()[0] or 0

    def allowed(first: Level) -> Keys:
        wrong = first.has(*side(~blocks), 0)
        return tuple(x[wrong] for x in side(~blocks))

    first = build_cascade(every, universe, _taken(keys, every))
    second = build_cascade(side(blocks), int((~blocks).sum()), allowed)
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.struct(*(h.alias(n) for n, h in zip(("h1", "h2"), key_hashes(k["host"], k["path"]))))))
    sent = spark.sparkContext.broadcast([[(x.bits, x.hashes, x.table) for x in c.levels] for c in (first, second)])

    def make():
        listed, blocks = (Cascade([Level(*x) for x in levels]) for levels in sent.value)

        def work(column):
            flat = column.flatten()
            n, lengths = len(column), column.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            h1, h2 = (flat.field(i).to_numpy() for i in (0, 1))
            found = np.flatnonzero(listed.has(h1, h2))
            row = np.searchsorted(ends, found, side="right")
            row, at = np.unique(row, return_index=True)
            best = found[at]
            place, block = np.full(n, -1, np.int32), np.zeros(n, bool)
            place[row] = best - (ends - lengths)[row]
            block[row] = blocks.has(h1[best], h2[best])
            return [pa.array(place, pa.int32()), pa.array(block)]

        return work

    fields = [T.StructField("place", T.IntegerType()), T.StructField("block", T.BooleanType())]
    judged = annotate(rows, ["hashes"], make, fields, ["page_id", "host", "path", "keys"])
    best = F.element_at("keys", F.col("place") + 1)
    rule = F.when(F.col("place") >= 0, F.concat(best["host"], best["path"]))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("block"), "block").otherwise("allow").alias("verdict"))
