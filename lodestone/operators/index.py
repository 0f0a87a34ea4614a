"""Secondary indexes: building with backfill, lookups by prefix and range in index order, uniqueness, maintenance, checks, choice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.paths import expand
from . import scan as scans
from . import stats


class UniqueViolation(ValueError):
    pass


@dataclass(frozen=True)
class Scan:
    """Equality on the first fields, then op on the next: 'gt', 'ge', 'lt', 'le', 'between', 'starts', or none."""

    prefix: tuple = ()
    op: str | None = None
    value: object = None
    upper: object = None
    reverse: bool = False

    def condition(self, columns: list[str]) -> Column:
        out = F.lit(True)
        for c, v in zip(columns, self.prefix, strict=False):
            out = out & P.equal(F.col(c), v)
        if self.op is None:
            return out
        c = F.col(columns[len(self.prefix)])
        return out & {
            "gt": lambda: P.above(c, self.value, False),
            "ge": lambda: P.above(c, self.value),
            "lt": lambda: P.below(c, self.value),
            "le": lambda: P.below(c, self.value, True),
            "between": lambda: P.between(c, self.value, self.upper),
            "starts": lambda: c.startswith(self.value),
        }[self.op]()


@dataclass
class Index:
    """entries: v1..vk, _id. stale: entries may lack documents, so only the documents answer. stored: entries are
    a table written in index order, whose bounds in files and row groups let a scan read what it asks for."""

    name: str
    fields: list[str]
    entries: DataFrame
    unique: bool = False
    sparse: bool = False
    stale: bool = False
    stats: tuple[int, int] | None = None
    stored: bool = False
    columns: list[str] = field(init=False)

    def __post_init__(self):
        self.columns = [f"v{i}" for i in range(1, len(self.fields) + 1)]

    def _order(self, reverse: bool) -> list[Column]:
        names = [*self.columns, "_id"]
        return [F.col(c).desc_nulls_last() for c in names] if reverse else [F.col(c).asc_nulls_first() for c in names]

    def covering(self, scan: Scan = Scan()) -> DataFrame:
        """v1..vk, _id in index order, without reading documents."""
        return self.entries.where(scan.condition(self.columns)).orderBy(*self._order(scan.reverse))

    def numbered(self, scan: Scan = Scan()) -> DataFrame:
        """All of covering's rows with their places from 1."""
        return scans.numbered(self.entries.where(scan.condition(self.columns)), self._order(scan.reverse)).orderBy("place")

    def lookup(self, scan: Scan = Scan()) -> DataFrame:
        return self.covering(scan).select("_id")

    def fetch(self, docs: DataFrame, id_col: str, scan: Scan = Scan()) -> DataFrame:
        """Documents in index order; their columns follow v1..vk. A stale index is never asked: use Planner."""
        if self.stale:
            raise ValueError(f"index {self.name} is stale")
        hits = self.entries.where(scan.condition(self.columns))
        if self.stored:  # few ids go to the scan of the documents, which reads only where they can be
            few = [r._id for r in hits.select("_id").distinct().limit(MOST_IDS + 1).collect()]
            if len(few) <= MOST_IDS:
                docs = docs.where(F.col(f"`{id_col}`").isin(few))
        both = hits.join(docs.withColumnRenamed(id_col, "__key"), F.col("_id") == F.col("__key"))
        both = both.drop("__key") if id_col == "_id" else both.withColumnRenamed("__key", id_col)
        return both.orderBy(*self._order(scan.reverse))

    def summary(self) -> DataFrame:
        return stats.summary(self.entries, self.columns)


#: Ids of documents that are sent to the documents' scan.
MOST_IDS = 1000


def save(index: Index, path: str) -> Index:
    """The index as a stored one: entries in ranges of index order, each sorted."""
    spark, order = index.entries.sparkSession, index._order(False)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
    return load(spark, path, index.name, index.fields, index.unique, index.sparse)


def load(spark: SparkSession, path: str, name: str, fields: list[str], unique: bool = False, sparse: bool = False) -> Index:
    return Index(name, fields, spark.read.parquet(path), unique, sparse, stored=True)


def create(docs: DataFrame, id_col: str, name: str, fields: list[str], unique: bool = False, sparse: bool = False) -> Index:
    """With backfill; a unique index over equal values of different documents is refused."""
    index = Index(name, fields, expand(docs, id_col, fields, sparse), unique, sparse)
    if unique and (bad := violations(index).take(1)):
        raise UniqueViolation(f"{name}: {bad[0]}")
    return index


def violations(index: Index) -> DataFrame:
    """Values (none of them null) that several documents have, and how many."""
    rows = index.entries
    for c in index.columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*index.columns).agg(F.count_distinct("_id").alias("documents")).where("documents > 1")


def maintain(index: Index, docs: DataFrame, id_col: str, changed: DataFrame) -> Index:
    """After puts and removals: entries of the ids in changed(_id) are made anew from docs; checked before anything is replaced."""
    kept = index.entries.join(changed, "_id", "left_anti").select(*index.entries.columns)
    now = docs.join(changed, docs[f"`{id_col}`"] == changed["_id"], "left_semi")
    fresh = expand(now, id_col, index.fields, index.sparse).select(*kept.columns)
    out = Index(index.name, index.fields, kept.unionByName(fresh), index.unique, index.sparse)
    if out.unique and (bad := violations(out).take(1)):
        raise UniqueViolation(f"{index.name}: {bad[0]}")
    return out


def verify(index: Index, docs: DataFrame, id_col: str) -> DataFrame:
    """Entries that the index lacks or has too many."""
    right = expand(docs, id_col, index.fields, index.sparse).select(*index.entries.columns)
    return right.exceptAll(index.entries).withColumn("finding", F.lit("missing")).unionByName(index.entries.exceptAll(right).withColumn("finding", F.lit("extra")))


class Planner:
    """Chooses how to answer equality on fields and a range on one more: an index whose first fields fit, else the documents."""

    def __init__(self, docs: DataFrame, id_col: str, indexes: list[Index]):
        self.docs, self.id_col, self.indexes = docs, id_col, indexes

    def choose(self, equal: dict, ranged: str | None = None) -> Index | None:
        """Most equality fields first, then a range on the next field, then unique, then by selectivity."""
        best, best_rank = None, None
        for i in self.indexes:
            if i.stale or i.sparse:
                continue
            n = 0
            while n < len(i.fields) and i.fields[n] in equal:
                n += 1
            hit = ranged is not None and n < len(i.fields) and i.fields[n] == ranged
            if not n and not hit:
                continue
            share = stats.selectivity(*i.stats) if i.stats else None
            rank = (-n, not hit, not i.unique, 1.0 if share is None else share)
            if best_rank is None or rank < best_rank:
                best, best_rank = i, rank
        return best

    def find(self, equal: dict, ranged: str | None = None, op: str | None = None, value=None, upper=None) -> DataFrame:
        index = self.choose(equal, ranged)
        if index is None:
            out = self.docs
            for f, v in equal.items():
                out = out.where(P.equal(F.col(f"`{f}`"), v))
            return out.where(Scan((), op, value, upper).condition([f"`{ranged}`"])) if ranged else out
        n = 0
        while n < len(index.fields) and index.fields[n] in equal:
            n += 1
        hit = ranged is not None and n < len(index.fields) and index.fields[n] == ranged
        scan = Scan(tuple(equal[f] for f in index.fields[:n]), *((op, value, upper) if hit else ()))
        out = index.fetch(self.docs, self.id_col, scan).select(*self.docs.columns)
        for f, v in equal.items():
            if f not in index.fields[:n]:
                out = out.where(P.equal(F.col(f"`{f}`"), v))
        return out if hit or not ranged else out.where(Scan((), op, value, upper).condition([f"`{ranged}`"]))
