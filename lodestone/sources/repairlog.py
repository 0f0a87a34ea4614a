"""Index mutations that a writer had begun: replayed after a crash, or given up for a rebuild, as every index follows from its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import expand
from ..operators.index import Index, create


def replay(index: Index, log: DataFrame, id_col: str = "_id") -> Index:
    """log: seq, _id, after (struct of the document's fields, null if it was removed). The last mutation of an id holds; replaying twice changes nothing."""
    last = log.groupBy(id_col).agg(F.max_by(F.struct("after"), "seq").alias("m")).select(id_col, "m.after")
    kept = index.entries.join(last.select(F.col(id_col).alias("_id")), "_id", "left_anti").select(*index.entries.columns)
    fresh = expand(last.where("after is not null").select(id_col, "after.*"), id_col, index.fields, index.sparse)
    return Index(index.name, index.fields, kept.unionByName(fresh.select(*kept.columns)), index.unique, index.sparse)


def rebuild(index: Index, docs: DataFrame, id_col: str = "_id") -> Index:
    return create(docs, id_col, index.name, index.fields, index.unique, index.sparse)
