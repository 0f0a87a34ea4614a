"""Versioned reads over an append-only log.

A log has tree_id, key, seq, op ('put', 'delete', 'range_delete'), value columns, expiry_ms
and end_key. The newest version of a key up to a snapshot wins; then, and only then, it is
hidden by being a tombstone, by a later range delete, or by having expired, so that no older
version comes back.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..work import free, written
from . import scan as scans

#: Range deletes that the driver sweeps; intervals in a bin of these; bins of more.
MOST_RANGES, IN_BIN, BINS = 10_000, 16, 2048


def newest(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """The newest version of each key, tombstones included: one row of a partial aggregate a key and task."""
    rows = log.where(F.col("op") != "range_delete")
    if snapshot is not None:
        rows = rows.where(F.col("seq") <= snapshot)
    others = [c for c in log.columns if c not in ("tree_id", "key", "end_key")]
    packed = F.struct("seq", *(c for c in others if c != "seq"))
    best = rows.groupBy("tree_id", "key").agg(F.max_by(packed, "seq").alias("v"))
    return best.select("tree_id", "key", *(F.col(f"v.{c}").alias(c) for c in others))


def range_deletes(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    rows = log.where(F.col("op") == "range_delete")
    if snapshot is not None:
        rows = rows.where(F.col("seq") <= snapshot)
    return rows.select("tree_id", F.col("key").alias("low"), F.col("end_key").alias("high"), F.col("seq").alias("rd_seq"))


def _sweep(ranges: Iterable[tuple]) -> list[tuple]:
    """Disjoint (low, high, seq), ascending: the latest of the ranges (low, high, seq) over each place."""
    begin = sorted(ranges, key=lambda r: r[0])
    edges = sorted({x for low, high, _ in begin for x in (low, high) if low < high})
    open_, out, at = [], [], 0
    for edge, until in zip(edges, edges[1:]):
        while at < len(begin) and begin[at][0] <= edge:
            heapq.heappush(open_, (-begin[at][2], at))
            at += 1
        while open_ and begin[open_[0][1]][1] <= edge:
            heapq.heappop(open_)
        if open_:
            seq = -open_[0][0]
            if out and out[-1][1] == edge and out[-1][2] == seq:
                out[-1] = (out[-1][0], until, seq)
            else:
                out.append((edge, until, seq))
    return out


def _bins(kind: T.DataType, places: list[tuple]) -> Callable[[Column, Column], Column]:
    """Of sorted (tree_id, key), the bin of a (tree_id, key): how many of them aren't above it."""
    literals = [F.struct(F.lit(t).cast("int").alias("t"), F.lit(k).cast(kind).alias("k")) for t, k in places]
    return lambda tree, key: scans.bounds_below(F.struct(tree.cast("int").alias("t"), key.alias("k")), literals, inclusive=True)


def _few_intervals(ranges: DataFrame) -> tuple[DataFrame, Callable]:
    """Disjoint intervals (t, bin, low, high, rd_seq) of up to MOST_RANGES ranges, swept on the driver, and the bins they are dealt to, a few to each."""
    by: dict[int, list] = {}
    for r in ranges.collect():
        by.setdefault(r.tree_id, []).append((r.low, r.high, r.rd_seq))
    swept = [(t, *x) for t in sorted(by) for x in _sweep(by[t])]
    places = [x[:2] for x in swept[::IN_BIN]]
    rows = []
    for t, low, high, seq in swept:
        first, last = bisect_right(places, (t, low)), bisect_left(places, (t, high))
        rows += [(t, b, low, high, seq) for b in range(first, max(first, last) + 1)]
    kind = ranges.schema["low"].dataType
    schema = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind), T.StructField("rd_seq", T.LongType())])
    return ranges.sparkSession.createDataFrame(rows, schema), _bins(kind, places)


def _many_intervals(ranges: DataFrame) -> tuple[DataFrame, Callable]:
    """As _few_intervals, of any number. Bins are cut by a sample of the ranges' starts; a range goes to the two bins where it
    begins and ends, and those wholly under it it covers as at most two nodes of each level of a binary tree of bins; then each bin is swept by itself."""
    sample = ranges.select("tree_id", "low").orderBy(F.rand(11)).limit(8 * BINS).collect()
    places = sorted({(r.tree_id, r.low) for r in sample})
    places = places[:: max(1, len(places) // BINS)]
    kind = ranges.schema["low"].dataType
    bin_of = _bins(kind, places)
    placed = written(ranges.withColumns({"first": bin_of(F.col("tree_id"), F.col("low")), "last": bin_of(F.col("tree_id"), F.col("high"))}), "ranges")
    ends = placed.select("tree_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("bin"), "low", "high", "rd_seq")
    height = len(places).bit_length() + 1
    node = lambda level, n: F.struct(level.alias("level"), n.cast("int").alias("node"))

    def step(state, level):
        a, b = state["a"], state["b"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        none = F.array().cast("array<struct<level:int,node:int>>")
        nodes = F.concat(state["nodes"], F.when(odd_a, F.array(node(level, a))).otherwise(none), F.when(odd_b, F.array(node(level, b - 1))).otherwise(none))
        up = F.when(odd_a, a + 1).otherwise(a), F.when(odd_b, b - 1).otherwise(b)
        return F.struct(F.floor(up[0] / 2).cast("int").alias("a"), F.floor(up[1] / 2).cast("int").alias("b"), nodes.alias("nodes"))

    start = F.struct((F.col("first") + 1).cast("int").alias("a"), F.col("last").cast("int").alias("b"), F.array().cast("array<struct<level:int,node:int>>").alias("nodes"))
    inner = F.aggregate(F.sequence(F.lit(0), F.lit(height)), start, step)["nodes"]
    nodes = placed.where("last - first > 1").select("tree_id", "rd_seq", F.explode(inner).alias("x")).groupBy("tree_id", "x.level", "x.node").agg(F.max("rd_seq").alias("rd_seq"))
    spread = F.explode(F.sequence(F.col("node") * F.expr("shiftleft(1, level)"), (F.col("node") + 1) * F.expr("shiftleft(1, level)") - 1))
    whole = nodes.select("tree_id", spread.alias("bin"), "rd_seq").groupBy("tree_id", "bin").agg(F.max("rd_seq").alias("rd_seq"))
    whole = whole.select("tree_id", "bin", F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high"), "rd_seq")
    schema = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind), T.StructField("rd_seq", T.LongType())])

    def sweep(key, group):
        import pandas as pd

        rows = [(int(key[0]), int(key[1]), *x) for x in _sweep(zip(group.low, group.high, group.rd_seq.tolist()))]
        return pd.DataFrame(rows, columns=schema.names)

    swept = ends.groupBy("tree_id", "bin").applyInPandas(sweep, schema)
    return written(swept.unionByName(whole.withColumnRenamed("tree_id", "t").select(*schema.names)), "intervals"), bin_of


def _covered(rows: DataFrame, ranges: DataFrame, how: str, seq: str | None = None) -> DataFrame:
    """rows (tree_id, key, ..) that a range covers (left_semi) or that none covers (left_anti); with seq, only ranges later than that column count.

    Ranges become disjoint intervals in bins of a few, so that a row is held against those of its bin only, wherever
    it is; intervals are sent or shuffled by bin, as their size asks."""
    n = ranges.count()
    if not n:
        return rows if how == "left_anti" else rows.where(F.lit(False))
    intervals, bin_of = _few_intervals(ranges) if n <= MOST_RANGES else _many_intervals(ranges)
    (own,) = free(rows.columns, "bin")
    placed = rows.withColumn(own, bin_of(F.col("tree_id"), F.col("key")))
    r = F.broadcast(intervals) if n <= MOST_RANGES else intervals
    hit = (placed["tree_id"] == r["t"]) & (placed[own] == r["bin"]) & (r["low"].isNull() | ((placed["key"] >= r["low"]) & (placed["key"] < r["high"])))
    return placed.join(r, hit & (r["rd_seq"] > placed[seq]) if seq else hit, how).drop(own)


def hide_ranges(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Drops versions that a later range delete [low, high) covers."""
    return _covered(versions, ranges, "left_anti", "seq")


def alive(now_ms: int | None) -> Column:
    """Neither a tombstone nor expired at now_ms."""
    live = F.col("op") == "put"
    return live if now_ms is None else live & (F.col("expiry_ms").isNull() | (F.col("expiry_ms") > now_ms))


def read(log: DataFrame, snapshot: int | None = None, now_ms: int | None = None) -> DataFrame:
    """What a reader at a snapshot sees."""
    return hide_ranges(newest(log, snapshot), range_deletes(log, snapshot)).where(alive(now_ms))


def scan(log: DataFrame, tree_id: int, low=None, high=None, snapshot: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Keys of [low, high) of one tree, ascending. Bounds go to the scan of the log; range deletes keep theirs."""
    rows = log.where(F.col("tree_id") == tree_id)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("key") >= low)
    if high is not None:
        inside = inside & (F.col("key") < high)
    return read(rows.where((F.col("op") == "range_delete") | inside), snapshot, now_ms).orderBy("key")


def compact(log: DataFrame, floor: int | None = None, now_ms: int | None = None) -> DataFrame:
    """A log with the same answers for snapshots from floor on (the newest if None): what no such reader sees is left out."""
    if floor is None:
        return read(log, None, now_ms).withColumn("end_key", F.lit(None).cast(log.schema["end_key"].dataType)).select(*log.columns)
    old = newest(log, floor).withColumn("end_key", F.lit(None).cast(log.schema["end_key"].dataType)).select(*log.columns)
    kept = hide_ranges(old, range_deletes(log, floor)).where(F.col("op") != "delete")
    return kept.unionByName(log.where(F.col("seq") > floor))


def with_default_ttl(log: DataFrame, written_ms: str, ttl_ms: int) -> DataFrame:
    return log.withColumn("expiry_ms", F.coalesce("expiry_ms", F.when(F.col("op") == "put", F.col(written_ms) + ttl_ms)))


# --- checkpoints ---------------------------------------------------------------------------


class Checkpoints:
    """Named snapshots of a log. Restoring keeps counters: seqs written after a checkpoint and before its restore are given up, later ones count."""

    def __init__(self, pin_limit: float = 0.25):
        self.rows: dict[str, dict] = {}
        self.abandoned: list[tuple[int, int]] = []
        self._limit = pin_limit

    def create(self, name: str, seq: int, created: int, expires: int | None = None, pinned_share: float = 0.0, force: bool = False) -> None:
        if name in self.rows:
            raise ValueError(f"there is a checkpoint {name!r}")
        if pinned_share > self._limit and not force:
            raise ValueError(f"checkpoints would pin {pinned_share:.0%} of the store; the limit is {self._limit:.0%}")
        self.rows[name] = {"seq": seq, "created": created, "expires": expires}

    def restore(self, name: str, newest_seq: int) -> None:
        self.abandoned.append((self.rows[name]["seq"], newest_seq))

    def expire(self, now: int) -> list[str]:
        gone = [n for n, r in self.rows.items() if r["expires"] is not None and r["expires"] <= now]
        for n in gone:
            del self.rows[n]
        return gone

    def visible(self) -> Column:
        """Versions that no restore has given up."""
        return reduce(lambda c, x: c & ~((F.col("seq") > x[0]) & (F.col("seq") <= x[1])), self.abandoned, F.lit(True))

    def open_at(self, log: DataFrame, name: str, now_ms: int | None = None) -> DataFrame:
        """As the checkpoint saw it: what was given up before it doesn't count, what was given up after it doesn't matter."""
        seq = self.rows[name]["seq"]
        given_up = [x for x in self.abandoned if x[1] <= seq]
        keep = reduce(lambda c, x: c & ~((F.col("seq") > x[0]) & (F.col("seq") <= x[1])), given_up, F.lit(True))
        return read(log.where(keep), seq, now_ms)


# --- conflicts and transactions ------------------------------------------------------------


def conflicts(log: DataFrame, touched: DataFrame, start_seq: int) -> DataFrame:
    """(tree_id, key) of touched that were written after start_seq, by key or by a range delete over it."""
    later = log.where(F.col("seq") > start_seq)
    keys = touched.join(later.where(F.col("op") != "range_delete").select("tree_id", "key"), ["tree_id", "key"], "left_semi")
    ranged = _covered(touched, range_deletes(later), "left_semi")
    return keys.select("tree_id", "key").unionByName(ranged.select("tree_id", "key")).distinct()


class Conflict(RuntimeError):
    pass


class Transaction:
    """Buffered writes over a snapshot. isolation: snapshot, read_committed, serializable or read_only."""

    LEVELS = ("snapshot", "read_committed", "serializable", "read_only")

    def __init__(self, start_seq: int, isolation: str = "snapshot"):
        if isolation not in self.LEVELS:
            raise ValueError(f"no isolation {isolation!r}")
        self.start, self.isolation = start_seq, isolation
        self.writes: list[tuple] = []
        self.reads: set[tuple] = set()
        self._marks: dict[str, int] = {}

    def write(self, tree_id: int, key, op: str = "put", value=None) -> None:
        if self.isolation == "read_only":
            raise ValueError("a read-only transaction can't write")
        self.writes.append((tree_id, key, op, value))

    def read(self, tree_id: int, key):
        """Own last write as (op, value), or None: then the snapshot holds the answer."""
        self.reads.add((tree_id, key))
        return next(((op, v) for t, k, op, v in reversed(self.writes) if (t, k) == (tree_id, key)), None)

    def savepoint(self, name: str) -> None:
        self._marks[name] = len(self.writes)

    def rollback_to(self, name: str) -> None:
        """Drops later writes and later savepoints; the savepoint stays."""
        at = self._marks[name]
        del self.writes[at:]
        self._marks = {n: i for n, i in self._marks.items() if i <= at}

    def abort(self) -> None:
        self.writes.clear()

    def touched(self) -> set[tuple]:
        if self.isolation == "read_committed":
            return set()
        own = {(t, k) for t, k, _, _ in self.writes}
        return own | self.reads if self.isolation == "serializable" else own

    def commit(self, log: DataFrame, next_seq: int) -> DataFrame:
        """The rows to append, with seqs from next_seq on; Conflict if another commit came between."""
        spark, kind = log.sparkSession, log.schema["key"].dataType.simpleString()
        if touched := self.touched():
            asked = spark.createDataFrame(sorted(touched), f"tree_id int, key {kind}")
            if found := conflicts(log, asked, self.start).take(1):
                raise Conflict(f"{found[0]} was written after {self.start}")
        last = {(t, k): (op, v) for t, k, op, v in self.writes}
        rows = [(t, k, next_seq + i, op, v) for i, ((t, k), (op, v)) in enumerate(last.items())]
        value = log.schema["value"].dataType.simpleString()
        return spark.createDataFrame(rows, f"tree_id int, key {kind}, seq long, op string, value {value}")


def backpressure_ms(pressures: dict[str, float]) -> tuple[float, str | None]:
    """(wait, bound that asks for it): 100 ms times the square of the worst overshoot beyond a bound, each given as a share of it."""
    name, worst = max(pressures.items(), key=lambda x: x[1], default=(None, 0.0))
    over = worst - 1
    return (100.0 * over * over, name) if over > 0 else (0.0, None)
