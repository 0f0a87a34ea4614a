"""Every operator as a query over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, stemmer
from ..functions.analyzer import Analyzer, ascii_tokens
from ..functions.paths import expand, resolve
from ..functions.values import Num, index_range
from ..operators import index as ix
from ..operators import scan, spatial, stats, text, vector
from ..operators import versions as V
from ..sources.store import Database
from ..streaming import feed
from ..work import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(t), where t(name) reads a table."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def ranked(df: DataFrame, *order) -> DataFrame:
    """With the place of each row; for results of a bounded number of rows."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


# --- scans -----------------------------------------------------------------------------------


@query("SELECT o_orderkey AS _id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def collection_scan(t):
    return t("orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").orderBy("_id")


@query("SELECT o_orderkey AS _id, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_get(t):
    return t("orders").where("o_orderkey = 77").select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_totalprice")


@query("SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def key_range_scan(t):
    return t("orders").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 300)).select(F.col("o_orderkey").alias("_id"), "o_totalprice").orderBy("_id")


@query("SELECT o_orderkey AS _id FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 900")
def key_only_scan(t):
    return t("orders").where(F.col("o_orderkey").between(500, 899)).select(F.col("o_orderkey").alias("_id")).orderBy("_id")


@query("SELECT (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 123) AS ceiling_key, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 123) AS higher_key")
def seek_ceiling(t):
    k = F.col("o_orderkey")
    return t("orders").where(k >= 123).agg(F.min(k).alias("ceiling_key"), F.min(F.when(k > 123, k)).alias("higher_key"))


@query("SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 123) AS floor_key, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 123) AS lower_key")
def seek_floor(t):
    k = F.col("o_orderkey")
    return t("orders").where(k <= 123).agg(F.max(k).alias("floor_key"), F.max(F.when(k < 123, k)).alias("lower_key"))


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def seek_ends(t):
    return t("orders").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT o_orderkey AS _id, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders")
def reverse_scan(t):
    docs = t("orders").select(F.col("o_orderkey").alias("_id"))
    return scan.numbered(docs, [F.desc_nulls_last("_id")]).orderBy("place")


@query("SELECT * FROM (SELECT o_orderkey AS _id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100)")
def skip_take_page(t):
    return scan.page(t("orders").select(F.col("o_orderkey").alias("_id"), "o_totalprice"), "_id", 100, 25)


@query("SELECT * FROM (SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey > 99 ORDER BY o_orderkey LIMIT 25)")
def keyset_page(t):
    return scan.next_page(t("orders").select(F.col("o_orderkey").alias("_id"), "o_totalprice"), "_id", 99, 25)


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS page, o_orderkey AS _id FROM orders")
def paged_walk(t):
    """Every row with the number of its page of 400: places come from one ordered pass, not from a page at a time."""
    docs = t("orders").select(F.col("o_orderkey").alias("_id"))
    return scan.numbered(docs, [F.asc_nulls_first("_id")]).select(F.floor((F.col("place") - 1) / 400).alias("page"), "_id")


@query("SELECT count(*) AS rows, CAST(sum(strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT) AS bytes FROM orders")
def counted_scan(t):
    """What the counters of a whole scan say after it."""
    docs, seen = scan.counted(t("orders"))
    docs.write.format("noop").mode("overwrite").save()
    return docs.sparkSession.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows long, bytes long")


@query("SELECT event_id AS _id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def projection_field(t):
    return t("events").select(F.col("event_id").alias("_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id AS _id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def nested_path_variant(t):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return t("events").select(F.col("event_id").alias("_id"), k.alias("k")).where("k >= 90")


@query("SELECT * FROM (SELECT o_orderkey AS _id, o_totalprice, 'floor' AS seek FROM orders WHERE o_orderkey <= 555 ORDER BY o_orderkey DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'higher' FROM orders WHERE o_orderkey > 555 ORDER BY o_orderkey LIMIT 1)")
def seek_rows(t):
    docs = t("orders").select(F.col("o_orderkey").alias("_id"), "o_totalprice")
    floor, higher = (scan.seek(docs, "_id", 555, w).withColumn("seek", F.lit(w)) for w in ("floor", "higher"))
    return floor.unionByName(higher)


@query("SELECT o_orderkey AS _id, o_custkey FROM orders WHERE o_custkey = 17")
def key_encoded_scan(t):
    """Through encoded keys of [customer, id]: equality is a range of bytes that leaves the number's type open."""
    keyed = keys.with_key(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    found = keyed.where(keys.in_range(F.col("key"), index_range([Num(17.0, "f64")], any_number=True)))
    return keys.id_of(found).select("_id", "o_custkey")


@query("SELECT p_partkey AS _id FROM part WHERE p_size >= 40")
def key_encoded_mixed_range(t):
    """Sizes held as whole numbers by half of the parts and as real ones by the others, in one order of keys."""
    size = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")).alias("whole"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size").cast("double")).alias("real"))
    keyed = keys.with_key(t("part").select("p_partkey", size.alias("size")), ["size"], "p_partkey")
    return keys.id_of(keyed.where(keys.in_range(F.col("key"), index_range([], "ge", 40)))).select("_id")


@query("SELECT c_custkey AS _id FROM customer WHERE starts_with(c_name, 'Customer#00000002')")
def key_encoded_prefix(t):
    """Names that begin alike are a range of key bytes, up to the successor of what they share."""
    keyed = keys.with_key(t("customer").select("c_name", "c_custkey"), ["c_name"], "c_custkey")
    return keys.id_of(keyed.where(keys.in_range(F.col("key"), index_range([], "starts", "Customer#00000002")))).select("_id")


@query("SELECT c_custkey AS _id FROM customer WHERE c_nationkey = 3 AND c_acctbal <= 1000.0")
def key_encoded_range_in_prefix(t):
    keyed = keys.with_key(t("customer").select("c_nationkey", "c_acctbal", "c_custkey"), ["c_nationkey", "c_acctbal"], "c_custkey")
    return keys.id_of(keyed.where(keys.in_range(F.col("key"), index_range([Num(3, "i32")], "le", 1000.0)))).select("_id")


# --- indexes ---------------------------------------------------------------------------------


def _orders_index(t):
    return ix.create(t("orders"), "o_orderkey", "by_customer", ["o_custkey", "o_totalprice"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders")
    index = ix.create(docs, "o_orderkey", "by_customer", ["o_custkey", "o_totalprice"])
    found = index.fetch(docs, "o_orderkey", ix.Scan((7,), "ge", 1000.0))
    return found.select("_id", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey AS _id, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_totalprice >= 1000.0")
def index_fetch_documents(t):
    return _orders_index(t).fetch(t("orders"), "o_orderkey", ix.Scan((7,), "ge", 1000.0)).select("_id", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey AS _id, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_totalprice >= 1000.0")
def stored_index_fetch(t):
    """Through entries that were written in index order: the files' bounds say what is read of them, and of the documents."""
    docs = t("orders")
    index = ix.save(_orders_index(t), new_path(docs.sparkSession, "index"))
    return index.fetch(docs, "o_orderkey", ix.Scan((7,), "ge", 1000.0)).select("_id", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey AS _id FROM orders WHERE o_custkey = 42")
def index_eq_prefix(t):
    return _orders_index(t).lookup(ix.Scan((42,)))


@query("SELECT o_custkey AS v1, o_totalprice AS v2, o_orderkey AS _id FROM orders WHERE o_custkey = 42 AND o_totalprice >= 200000.0")
def index_range_after_eq(t):
    return _orders_index(t).covering(ix.Scan((42,), "ge", 200000.0))


@query("SELECT o_custkey AS v1, o_totalprice AS v2, o_orderkey AS _id FROM orders")
def index_covering(t):
    return _orders_index(t).covering()


@query("SELECT o_custkey AS v1, o_totalprice AS v2, o_orderkey AS _id, row_number() OVER (ORDER BY o_custkey DESC, o_totalprice DESC, o_orderkey DESC) AS place FROM orders")
def index_full_scan_reverse(t):
    return _orders_index(t).numbered(ix.Scan(reverse=True))


def _prices(t):
    """Balances with nulls: customers of nation 3 have none."""
    docs = t("customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("balance"), "c_name")
    return ix.create(docs, "c_custkey", "by_balance", ["balance"])


_BALANCE = "(SELECT CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS v1, c_custkey AS _id FROM customer)"


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 > 5000.0")
def index_gt(t):
    return _prices(t).covering(ix.Scan((), "gt", 5000.0))


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 >= 5000.0")
def index_ge(t):
    return _prices(t).covering(ix.Scan((), "ge", 5000.0))


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 IS NULL OR v1 < 0.0")
def index_lt_with_nulls(t):
    return _prices(t).covering(ix.Scan((), "lt", 0.0))


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 IS NULL OR v1 <= 0.0")
def index_le(t):
    return _prices(t).covering(ix.Scan((), "le", 0.0))


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 BETWEEN 100.0 AND 900.0")
def index_between(t):
    return _prices(t).covering(ix.Scan((), "between", 100.0, 900.0))


@query(f"SELECT v1, _id FROM {_BALANCE} WHERE v1 IS NULL")
def index_null_missing(t):
    return _prices(t).covering(ix.Scan((None,)))


@query("SELECT c_name AS v1, c_custkey AS _id FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def index_starts_with(t):
    return ix.create(t("customer"), "c_custkey", "by_name", ["c_name"]).covering(ix.Scan((), "starts", "Customer#00000001"))


@query("SELECT p_partkey AS _id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size = 11")
def index_eq_numeric_cross_type(t):
    """Half of the parts hold their size as a whole number, the others as a real one; equality is by number."""
    docs = t("part").select("p_partkey", F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")).alias("whole"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size").cast("double")).alias("real")).alias("size"))
    found = ix.create(docs, "p_partkey", "by_size", ["size"]).covering(ix.Scan((Num(11),)))
    return found.select("_id", F.coalesce("v1.whole", F.col("v1.real").cast("long")).alias("size"))


@query("SELECT p_partkey AS _id, row_number() OVER (ORDER BY p_size, p_partkey % 2, p_partkey) AS place FROM part")
def key_value_order(t):
    """Whole and real numbers in one order, by their encoded keys; of equal ones, whole numbers come first."""
    size = F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")).alias("whole"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size").cast("double")).alias("real"))
    keyed = keys.with_key(t("part").select("p_partkey", size.alias("size")), ["size"], "p_partkey")
    return keys.id_of(scan.numbered(keyed.select("key"), [F.col("key")])).select("_id", "place")


@query("SELECT word AS v1, p_partkey AS _id FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def index_array_elements(t):
    docs = t("part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return ix.create(docs, "p_partkey", "by_word", ["words"]).covering()


@query("SELECT DISTINCT p_brand AS v1, word AS v2, p_partkey AS _id FROM (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def index_cartesian(t):
    docs = t("part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("words"))
    return ix.create(docs, "p_partkey", "by_brand_word", ["p_brand", "words"]).covering()


@query("SELECT CAST(quality AS INTEGER) AS v1, d.doc_id AS _id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def index_sparse(t):
    docs = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return ix.create(docs, "doc_id", "by_quality", ["quality"], sparse=True).covering()


@query("SELECT DISTINCT role AS v1, conv_id AS _id FROM conversations")
def index_nested_path(t):
    docs = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return expand(docs, "conv_id", ["turns.role"])


@query("SELECT conv_id AS _id, count(*) AS turns, sum(turn) AS turn_sum FROM conversations GROUP BY conv_id")
def path_flatten(t):
    docs = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    turns, _, _ = resolve(docs, "turns.turn")
    return docs.select(F.col("conv_id").alias("_id"), F.size(turns).cast("long").alias("turns"), F.aggregate(turns, F.lit(0).cast("long"), lambda s, x: s + x).alias("turn_sum"))


@query("SELECT c_nationkey AS v1, c_mktsegment AS v2, count(DISTINCT c_custkey) AS documents FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1")
def unique_violations(t):
    return ix.violations(ix.create(t("customer"), "c_custkey", "u", ["c_nationkey", "c_mktsegment"]))


@query("SELECT c_mktsegment AS v1, count(*) AS documents FROM customer WHERE c_nationkey <> 3 GROUP BY ALL HAVING count(*) > 1")
def unique_null_distinct(t):
    docs = t("customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"))
    return ix.violations(ix.create(docs, "c_custkey", "u", ["segment"]))


@query("SELECT o_orderstatus AS v1, o_orderkey AS _id FROM orders WHERE o_orderkey >= 200 UNION ALL SELECT 'X', o_orderkey FROM orders WHERE o_orderkey < 100")
def index_maintenance(t):
    """Ids under 100 get another status, ids from 100 to 199 are removed."""
    docs = t("orders").select("o_orderkey", "o_orderstatus")
    index = ix.create(docs, "o_orderkey", "by_status", ["o_orderstatus"])
    now = docs.where("o_orderkey >= 200").unionByName(docs.where("o_orderkey < 100").withColumn("o_orderstatus", F.lit("X")))
    changed = docs.where("o_orderkey < 200").select(F.col("o_orderkey").alias("_id"))
    return ix.maintain(index, now, "o_orderkey", changed).covering()


@query("SELECT o_orderstatus AS v1, o_orderkey AS _id, 'missing' AS finding FROM orders WHERE o_orderkey < 20 UNION ALL SELECT 'Z', -1, 'extra'")
def index_verify(t):
    """An index that lacks the ids under 20 and has an entry of no document."""
    docs = t("orders")
    index = ix.create(docs, "o_orderkey", "by_status", ["o_orderstatus"])
    odd = docs.limit(1).select(F.lit("Z").alias("v1"), F.lit(-1).cast("long").alias("_id"))
    broken = ix.Index("by_status", ["o_orderstatus"], index.entries.where("_id >= 20").unionByName(odd))
    return ix.verify(broken, docs, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 5 AND o_orderstatus = 'F' AND o_totalprice < 300000.0")
def planner_find(t):
    docs = t("orders")
    indexes = [ix.create(docs, "o_orderkey", n, f) for n, f in (("by_status", ["o_orderstatus"]), ("by_customer", ["o_custkey", "o_totalprice"]))]
    found = ix.Planner(docs, "o_orderkey", indexes).find({"o_custkey": 5, "o_orderstatus": "F"}, "o_totalprice", "lt", 300000.0)
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


# --- writes and versions -----------------------------------------------------------------------

SNAPSHOT, NOW = 6000, 7_000_000
RANGES = [(10, 20, 4000), (100, 120, 5500), (30, 35, 8000)]


def event_log(t) -> DataFrame:
    """Users as keys, events as versions: errors delete, purchases expire, and three range deletes."""
    e = t("events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    log = e.select(F.lit(1).alias("tree_id"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value", F.when(F.col("event_type") == "purchase", F.col("event_id") * 1000).alias("expiry_ms"), F.lit(None).cast("long").alias("end_key"))
    rows = [(1, low, seq, "range_delete", None, None, high) for low, high, seq in RANGES]
    return log.unionByName(e.sparkSession.createDataFrame(rows, "tree_id int, key long, seq long, op string, value double, expiry_ms long, end_key long"))


def _versions(snapshot: int | None, ranges: bool = True, now: int | None = None, columns: str = "key, seq, value", extra: str = "") -> str:
    cap = "" if snapshot is None else f"WHERE event_id <= {snapshot}"
    live = [r for r in RANGES if snapshot is None or r[2] <= snapshot] if ranges else []
    hidden = "".join(f" AND NOT (key >= {a} AND key < {b} AND seq < {s})" for a, b, s in live)
    ttl = "" if now is None else f" AND (expiry_ms IS NULL OR expiry_ms > {now})"
    return f"""SELECT {columns} FROM (SELECT user_id AS key, event_id AS seq, event_type, value, CASE WHEN event_type = 'purchase' THEN event_id * 1000 END AS expiry_ms,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events {cap}) WHERE r = 1 AND event_type <> 'error'{hidden}{ttl}{extra}"""


@query(_versions(None))
def version_scan_newest(t):
    return V.read(event_log(t)).select("key", "seq", "value")


@query(_versions(SNAPSHOT))
def snapshot_read(t):
    return V.read(event_log(t), SNAPSHOT).select("key", "seq", "value")


@query(_versions(SNAPSHOT, extra=" AND key >= 40 AND key < 90"))
def snapshot_scan_range(t):
    return V.scan(event_log(t), 1, 40, 90, SNAPSHOT).select("key", "seq", "value")


@query(_versions(None, ranges=False))
def tombstone_hide(t):
    return V.read(event_log(t).where("op <> 'range_delete'")).select("key", "seq", "value")


@query(_versions(9000))
def range_delete_later_write_survives(t):
    return V.read(event_log(t), 9000).select("key", "seq", "value")


@query(_versions(8000, now=NOW))
def ttl_read(t):
    return V.read(event_log(t), 8000, NOW).select("key", "seq", "value")


@query("SELECT key, seq FROM (SELECT user_id AS key, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= 6000) WHERE r = 1 AND event_type = 'purchase' AND seq * 1000 <= 7000000")
def ttl_newest_expired_hides(t):
    """Keys whose newest version has expired: no older version stands in for it."""
    return V.newest(event_log(t), SNAPSHOT).where((F.col("op") == "put") & (F.col("expiry_ms") <= NOW)).select("key", "seq")


@query("SELECT user_id AS key, event_id AS seq, event_id * 10 + 5000 AS expiry_ms FROM events WHERE event_type NOT IN ('error', 'purchase')")
def default_ttl(t):
    log = V.with_default_ttl(event_log(t).where("op = 'put' AND expiry_ms IS NULL").withColumn("written_ms", F.col("seq") * 10), "written_ms", 5000)
    return log.select("key", "seq", "expiry_ms")


@query("SELECT user_id AS key, count(*) AS versions, max(event_id) AS newest FROM events GROUP BY user_id")
def version_count(t):
    return event_log(t).where("op <> 'range_delete'").groupBy("key").agg(F.count("*").alias("versions"), F.max("seq").alias("newest"))


@query(_versions(3000))
def checkpoint_open_at(t):
    c = V.Checkpoints()
    c.create("early", 3000, 0)
    return c.open_at(event_log(t), "early").select("key", "seq", "value")


@query("""SELECT key, seq, value FROM (SELECT user_id AS key, event_id AS seq, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
FROM events WHERE event_id <= 3000 OR event_id > 7000) WHERE r = 1 AND event_type <> 'error' AND NOT (key >= 30 AND key < 35 AND seq < 8000)""")
def checkpoint_restore(t):
    """Restored at 7000 to the checkpoint at 3000: what was written between is given up, later writes count."""
    c = V.Checkpoints()
    c.create("early", 3000, 0)
    c.restore("early", 7000)
    return V.read(event_log(t).where(c.visible())).select("key", "seq", "value")


@query(_versions(None))
def compaction_result(t):
    return V.read(V.compact(event_log(t))).select("key", "seq", "value")


@query(_versions(8500))
def compaction_keeps_snapshots(t):
    return V.read(V.compact(event_log(t), 6000), 8500).select("key", "seq", "value")


def _store(t) -> Database:
    return Database(t("region").sparkSession, new_path(t("region").sparkSession, "store"), lambda: 1_700_000_000_000)


def _statuses(t):
    return t("orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS _id, CASE WHEN o_orderkey < 500 THEN 'NEW' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 100000000, 'ADDED' FROM orders WHERE o_orderkey < 50")
def upsert_batch(t):
    docs = _statuses(t)
    batch = docs.where("_id < 500").withColumn("status", F.lit("NEW")).unionByName(docs.where("_id < 50").select((F.col("_id") + 100000000).alias("_id"), F.lit("ADDED").alias("status")))
    c = _store(t).create_collection("orders", docs.drop("_id").schema)
    c.put(docs)
    c.put(batch)
    return c.scan()


@query("SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus <> 'F'")
def remove_docs(t):
    docs = _statuses(t)
    c = _store(t).create_collection("orders", docs.drop("_id").schema)
    c.put(docs)
    c.remove(docs.where("status = 'F'").select("_id"))
    return c.scan().select("_id")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS v1, c_custkey AS _id FROM customer WHERE c_custkey % 5 <> 0")
def store_index_maintained(t):
    """A stored index after its documents were put, put again and removed."""
    docs = t("customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"))
    c = _store(t).create_collection("customers", docs.drop("_id").schema)
    c.put(docs)
    c.create_index(["segment"])
    c.put(docs.where("_id % 3 = 0").withColumn("segment", F.lit("moved")))
    c.remove(docs.where("_id % 5 = 0").select("_id"))
    return c.index(["segment"]).covering()


@query("SELECT c_custkey AS _id, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0")
def store_checkpoint_restored(t):
    """Back to a checkpoint, after all was cleared."""
    docs = t("customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"))
    db = _store(t)
    c = db.create_collection("customers", docs.drop("_id").schema)
    c.put(docs.where("_id % 2 = 0"))
    db.checkpoint("even")
    c.clear()
    db.restore("even")
    return c.scan()


@query("SELECT c_custkey AS _id, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0")
def store_compacting_backup(t):
    """A copy that holds what readers see and nothing else."""
    docs = t("customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"))
    db = _store(t)
    c = db.create_collection("customers", docs.drop("_id").schema)
    c.put(docs)
    c.remove(docs.where("_id % 7 = 0").select("_id"))
    target = new_path(db.spark, "copy")
    db.compacting_backup(target)
    return Database(db.spark, target, db.clock).collection("customers").scan()


@query("SELECT 'commits' AS name, 3 AS value UNION ALL SELECT 'seq', count(*) + 1 FROM customer UNION ALL SELECT 'visible', count(*) + 1 FROM customer UNION ALL SELECT 'findings', 0")
def store_watermark(t):
    """After three commits: the newest seq is what readers see, and the check of the store finds nothing."""
    docs = t("customer").select(F.col("c_custkey").alias("_id"), F.col("c_mktsegment").alias("segment"))
    db = _store(t)
    c = db.create_collection("customers", docs.drop("_id").schema)
    c.put(docs)
    c.put(docs.where("_id = (SELECT 1)").limit(1).withColumn("_id", F.lit(-1).cast("long")))
    m = db.metrics()
    seen = db.log("customers").agg(F.max("seq")).first()[0]
    return db.spark.createDataFrame([("commits", m["commits"]), ("seq", m["seq"]), ("visible", seen), ("findings", len(db.verify()))], "name string, value long")


@query("SELECT user_id AS key, CASE WHEN user_id < 3 THEN 'first' ELSE 'second' END AS value FROM (SELECT DISTINCT user_id FROM events WHERE user_id < 5)")
def transaction_commit(t):
    """Writes after a savepoint are rolled back; the last write of a key counts."""
    log = event_log(t).withColumn("value", F.lit(None).cast("string")).where("op <> 'range_delete'")
    there = sorted(r.key for r in log.where("key < 5").select("key").distinct().collect())
    txn = V.Transaction(1 << 60)
    for k in there:
        txn.write(1, k, "put", "first")
    txn.savepoint("s")
    for k in there:
        txn.write(1, k, "put", "lost")
    txn.rollback_to("s")
    for k in there:
        if k >= 3:
            txn.write(1, k, "put", "second")
    return txn.commit(log, 1 << 60).select("key", "value")


def _orders_log(t, rows):
    log = t("orders").select(F.lit(1).alias("tree_id"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit("put").alias("op"), F.lit(None).cast("long").alias("expiry_ms"), F.lit(None).cast("long").alias("end_key"))
    more = log.sparkSession.createDataFrame(rows, "tree_id int, key long, seq long, op string, expiry_ms long, end_key long")
    return log.unionByName(more)


@query("SELECT o_orderkey AS _id FROM orders WHERE o_orderkey < 100 OR o_orderkey >= 400 OR o_orderkey = 150")
def remove_range(t):
    rows = [(1, 100, 10**12, "range_delete", None, 400), (1, 150, 10**12 + 1, "put", None, None)]
    return V.read(_orders_log(t, rows)).select(F.col("key").alias("_id"))


@query("SELECT 9223372036854775807 AS _id")
def clear_all(t):
    """The highest id is outside of a half-open range and stays."""
    top = (1 << 63) - 1
    return V.read(_orders_log(t, [(1, top, 10**12, "put", None, None), (1, -(1 << 63), 10**12 + 1, "range_delete", None, top)])).select(F.col("key").alias("_id"))


@query("SELECT DISTINCT 1 AS tree_id, user_id AS key FROM events WHERE event_id > 9000 AND user_id < 60")
def write_conflicts(t):
    log = event_log(t).where("op <> 'range_delete'")
    touched = log.where("key < 60").select("tree_id", "key").distinct()
    return V.conflicts(log, touched, 9000)


@query("SELECT DISTINCT 1 AS tree_id, user_id AS key FROM events WHERE user_id < 80 AND (event_id > 7900 OR (user_id >= 30 AND user_id < 35))")
def serializable_conflicts(t):
    """Read keys count too, and a range delete over them."""
    log = event_log(t)
    touched = log.where("op <> 'range_delete' AND key < 80").select("tree_id", "key").distinct()
    return V.conflicts(log, touched, 7900)


@query("SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, user_id AS key FROM events WHERE event_id >= 1000 AND event_id < 1500")
def change_feed_read(t):
    return feed.read(feed.feed_of(event_log(t), [1]), 1, 1000, 1500).select("seq", "op", "key")


@query("SELECT event_id AS seq, user_id AS key FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 2000")
def change_feed_retention(t):
    return feed.retain(feed.feed_of(event_log(t).where("op <> 'range_delete'"), [1]), 2000).select("seq", "key")


@query("SELECT event_id AS _id, value FROM events WHERE event_id % 3 = 2")
def incremental_backup_diff(t):
    """What a second backup copies, that is told what the first one has."""
    docs = t("events").select(F.col("event_id").alias("_id"), "value")
    db = _store(t)
    c = db.create_collection("events", docs.drop("_id").schema)
    c.put(docs.where("_id % 3 <> 2"))
    target = new_path(db.spark, "copy")
    known = db.backup(target)
    c.put(docs.where("_id % 3 = 2"))
    copied = db.backup(target, set(known))
    return db.spark.read.parquet(*(f"{target}/{p}" for p in copied)).select(F.col("key").alias("_id"), "value")


# --- statistics --------------------------------------------------------------------------------


@query(f"SELECT count(*) AS entries, count(*) FILTER (WHERE v1 IS NULL) AS nulls, min(v1) AS min_key, max(v1) AS max_key FROM {_BALANCE}")
def stats_entries_nulls_minmax(t):
    return _prices(t).summary().select("entries", "nulls", F.col("min_key.v1").alias("min_key"), F.col("max_key.v1").alias("max_key"))


@query("SELECT count(DISTINCT o_custkey) AS distinct_values FROM orders")
def stats_distinct_exact(t):
    return _orders_index(t).entries.agg(F.count_distinct("v1").alias("distinct_values"))


@query("SELECT count(DISTINCT o_custkey) > 0 AS close FROM orders")
def stats_distinct_hll(t):
    """Whether the merged sketches of two halves come within 5 percent of the exact count."""
    entries = _orders_index(t).entries
    halves = [stats.distinct_sketch(entries.where(c), F.col("v1")) for c in (F.col("_id") % 2 == 0, F.col("_id") % 2 == 1)]
    merged = halves[0].unionByName(halves[1]).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = entries.agg(F.count_distinct("v1").alias("n"))
    return merged.join(F.broadcast(exact)).select((F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), 0.05 * F.col("n"))).alias("close"))


@query("""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
q AS (SELECT *, CASE WHEN n <= 64 THEN 1 ELSE CAST(ceil(n / 64.0) AS BIGINT) END AS quota FROM o)
SELECT v AS bound, rn AS cumulative FROM q WHERE rn % quota = 0 OR rn = n""")
def stats_histogram(t):
    index = ix.create(t("orders"), "o_orderkey", "by_price", ["o_totalprice"])
    return stats.histogram(index.entries, "v1")


@query("""WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
h AS (SELECT v AS bound, rn AS cumulative FROM o WHERE rn % CASE WHEN n <= 64 THEN 1 ELSE CAST(ceil(n / 64.0) AS BIGINT) END = 0 OR rn = n)
SELECT coalesce(max(cumulative), 0) AS rows FROM h WHERE bound <= 250000.0""")
def stats_rows_at_or_below(t):
    index = ix.create(t("orders"), "o_orderkey", "by_price", ["o_totalprice"])
    return stats.rows_at_or_below(stats.histogram(index.entries, "v1"), 250000.0)


@query("SELECT round(1.0 / count(DISTINCT o_custkey), 9) AS selectivity FROM orders")
def stats_selectivity(t):
    e = _orders_index(t).entries.agg(F.count("*").alias("n"), F.count_distinct("v1").alias("d")).first()
    return t("orders").sparkSession.createDataFrame([(round(stats.selectivity(e.n, e.d), 9),)], "selectivity double")


@query("SELECT 'by_customer' AS chosen")
def stats_most_selective(t):
    rows = []
    for name, column in (("by_status", "o_orderstatus"), ("by_customer", "o_custkey")):
        r = t("orders").agg(F.count("*").alias("n"), F.count_distinct(column).alias("d")).first()
        rows.append((name, r.n, r.d))
    return t("orders").sparkSession.createDataFrame([(stats.most_selective(rows),)], "chosen string")


@query("SELECT bit_or(1 << (c_nationkey % 8)) AS features FROM customer")
def catalog_features(t):
    return stats.features(t("customer").select(F.call_function("shiftleft", F.lit(1), F.col("c_nationkey") % 8).alias("features")), "features")


@query("SELECT event_type, count(*) AS values FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def opaque_values(t):
    return stats.opaque_count(t("events"), "event_type", ["click", "view"])


@query("SELECT quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem")
def metrics_percentiles(t):
    p = stats.percentiles(t("lineitem"), "l_quantity", [0.5, 0.99])
    return p.select(F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p99"))


# --- catalog -------------------------------------------------------------------------------------

def _catalog(t) -> Database:
    db, schema = _store(t), T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    orders = db.create_collection("orders", schema)
    db.create_repository("users", schema)
    db.create_repository("users", schema, "eu")
    orders.create_index(["o_custkey"])
    orders.create_index(["o_totalprice"])
    return db


@query("SELECT * FROM (VALUES ('orders', 1, 'collection'), ('users', 2, 'repository'), ('users+eu', 3, 'keyed_repository')) c(name, tree_id, type)")
def catalog_collections(t):
    return _catalog(t).catalog().where("kind = 'data'").select("name", "tree_id", "type")


@query("SELECT * FROM (VALUES ('orders:o_custkey', 4, false), ('orders:o_totalprice', 5, false)) c(name, tree_id, stale)")
def catalog_indexes_of(t):
    return _catalog(t).catalog().where("kind = 'index' AND owner = 'orders'").select("name", "tree_id", "stale")


# --- full text -------------------------------------------------------------------------------------

_TOKENS = """(SELECT doc_id AS _id, token, CAST(p - 1 AS BIGINT) AS position FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS p FROM
(SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM documents)) WHERE length(token) <= 64)"""


def _postings(t, stop=None):
    return text.postings(ascii_tokens(t("documents"), "doc_id", "text", stop))


@query(f"SELECT token, count(DISTINCT _id) AS df, count(*) AS ttf FROM {_TOKENS} GROUP BY token")
def fts_term_stats(t):
    return text.term_stats(_postings(t))


@query(f"SELECT _id, count(*) AS freq, min(position) AS first_position FROM {_TOKENS} WHERE token = 'the' GROUP BY _id")
def fts_postings(t):
    return _postings(t).where("token = 'the'").select("_id", "freq", F.array_min("positions").cast("long").alias("first_position")).orderBy("_id")


@query(f"""SELECT token, block, min(_id) AS first_id, max(_id) AS last_id, count(*) AS docs FROM (SELECT token, _id, (row_number() OVER (PARTITION BY token ORDER BY _id) - 1) // 128 AS block
FROM (SELECT DISTINCT token, _id FROM {_TOKENS})) GROUP BY token, block""")
def fts_posting_blocks(t):
    return text.blocks(_postings(t))


@query(f"SELECT token, row_number() OVER (ORDER BY token) AS term_id FROM (SELECT DISTINCT token FROM {_TOKENS})")
def fts_dictionary(t):
    return text.dictionary(_postings(t))


@query(f"SELECT _id FROM {_TOKENS} WHERE token IN ('the', 'with', 'that') GROUP BY _id HAVING count(DISTINCT token) = 3")
def fts_search_and(t):
    return text.search(_postings(t), ["the", "with", "that"])


@query(f"SELECT DISTINCT a._id FROM {_TOKENS} a JOIN {_TOKENS} b ON a._id = b._id AND b.position = a.position + 1 WHERE a.token = 'of' AND b.token = 'the'")
def fts_phrase(t):
    return text.phrase(_postings(t), [("of", 0), ("the", 1)])


@query(f"SELECT DISTINCT a._id FROM {_TOKENS} a JOIN {_TOKENS} b ON a._id = b._id AND b.position = a.position + 2 WHERE a.token = 'of' AND b.token = 'and'")
def fts_stopword_gap(t):
    """A dropped stop word leaves its place: 'of the and' matches whatever stands between."""
    return text.phrase(_postings(t, ["the"]), [("of", 0), ("and", 2)])


@query(f"SELECT _id FROM {_TOKENS} WHERE token IN ('the', 'with', 'that') GROUP BY _id HAVING count(DISTINCT token) = 3")
def fts_stored_search(t):
    """Through a written index in blocks, of which only those of the terms are read."""
    return text.save(_postings(t), new_path(t("region").sparkSession, "text")).search(["the", "with", "that"])


@query(f"SELECT DISTINCT a._id FROM {_TOKENS} a JOIN {_TOKENS} b ON a._id = b._id AND b.position = a.position + 1 WHERE a.token = 'of' AND b.token = 'the'")
def fts_stored_phrase(t):
    return text.save(_postings(t), new_path(t("region").sparkSession, "text")).phrase([("of", 0), ("the", 1)])


ENGLISH = Analyzer(frozenset(["the", "of", "and"]), "english", stemmer.VERSION)


@query()
def fts_analyzed_terms(t):
    """All documents through the analyzer (normal form, word boundaries of Unicode, stop words, stems), as no SQL has it; tests hold it against a plain version."""
    return text.term_stats(text.build(t("documents"), "doc_id", ["text"], ENGLISH))


@query()
def fts_analyzed_phrase(t):
    return text.phrase_text(text.build(t("documents"), "doc_id", ["text"], ENGLISH), "with that", ENGLISH)


# --- vectors ---------------------------------------------------------------------------------------

PROBE = [round(0.01 * (i % 17) - 0.08, 2) for i in range(64)]
_PROBE = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("_id"), "embedding", "label")


def _knn(metric: str, where: str = "true") -> str:
    d = {"l2": "list_distance", "dot": "-list_inner_product", "cosine": "list_cosine_distance"}[metric] + f"(embedding::DOUBLE[], {_PROBE})"
    return f"SELECT _id, place, round(d, 6) AS distance FROM (SELECT vec_id AS _id, {d} AS d, row_number() OVER (ORDER BY {d}, vec_id) AS place FROM embeddings WHERE {where}) WHERE place <= 10"


def _top(df):
    return ranked(df, "distance", "_id").select("_id", "place", F.round("distance", 6).alias("distance"))


@query(_knn("l2"))
def vector_knn_l2(t):
    return _top(vector.search(_vectors(t), PROBE, 10, "l2"))


@query(_knn("dot"))
def vector_knn_dot(t):
    return _top(vector.search(_vectors(t), PROBE, 10, "dot"))


@query(_knn("cosine"))
def vector_knn_cosine(t):
    return _top(vector.search(_vectors(t), PROBE, 10, "cosine"))


@query(_knn("l2", "label = 3"))
def vector_knn_filtered(t):
    return _top(vector.search(_vectors(t), PROBE, 10, "l2", F.col("label") == 3))


@query(_knn("l2", "vec_id >= 100"))
def vector_remove_then_search(t):
    v = _vectors(t)
    return _top(vector.search(v.join(v.where("_id < 100").select("_id"), "_id", "left_anti"), PROBE, 10))


@query("SELECT vec_id AS _id, round(list_sum(list_transform(embedding, lambda x: CAST(round(x * 100) AS INTEGER) * 0.01::DOUBLE + 0.5::DOUBLE)), 6) AS total FROM embeddings")
def vector_i8_dequantize(t):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int"))
    real = vector.dequantise(whole, 0.01, 0.5)
    return _vectors(t).select("_id", F.round(F.aggregate(real, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT row_number() OVER (ORDER BY vec_id) AS slot, vec_id AS _id FROM embeddings")
def vector_slots(t):
    return vector.assign_slots(_vectors(t))


@query("""SELECT query_id, _id, place, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS _id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS place FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE place <= 10""")
def vector_knn_many(t):
    """Every vector whose id is divisible by 50 is asked, against all."""
    v = _vectors(t)
    found = vector.search_many(v, v.where("_id % 50 = 0").select(F.col("_id").alias("query_id"), "embedding"), 10)
    return found.select("query_id", "_id", "place", F.round("distance", 6).alias("distance"))


@query()
def vector_lists(t):
    """Ten nearest of one vector among the lists around its nearest centroids; tests measure what is missed."""
    v, path = _vectors(t), new_path(t("region").sparkSession, "lists")
    vector.save_lists(v, path, 32)
    return _top(vector.search_lists(v.sparkSession, path, PROBE, 10, 24))


# --- spatial ---------------------------------------------------------------------------------------


def _points(t):
    return t("supplier").select(F.col("s_suppkey").alias("_id"), (F.col("s_suppkey") * 7 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 89).cast("double").alias("y"))


_POINTS = "(SELECT s_suppkey AS _id, CAST(s_suppkey * 7 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 13 % 89 AS DOUBLE) AS y FROM supplier)"


def _shapes(t):
    """Points as WKB with their boxes: one byte for the order, four for the kind, two little-endian doubles."""
    import struct

    import pyarrow as pa

    def run(batches):
        for b in batches:
            wkb = [struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wkb, pa.binary())], names=["_id", "geom"])

    return spatial.with_boxes(_points(t).mapInArrow(run, "_id long, geom binary"))


@query(f"SELECT _id, x AS xmin, y AS ymin, x AS xmax, y AS ymax FROM {_POINTS}")
def spatial_envelope(t):
    return _shapes(t).select("_id", *spatial.BOX)


@query(f"SELECT _id FROM {_POINTS} WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 50")
def spatial_intersects_box(t):
    return spatial.intersects(_shapes(t), spatial.G.box(20, 10, 60, 50)).select("_id")


@query(f"SELECT _id FROM {_POINTS} WHERE x >= 0 AND y >= 0 AND x + y <= 70")
def spatial_within(t):
    triangle = spatial.G.Geometry(spatial.G.POLYGON, (((0.0, 0.0), (70.0, 0.0), (0.0, 70.0), (0.0, 0.0)),))
    return spatial.within(_shapes(t), triangle).select("_id")


@query(f"SELECT _id FROM {_POINTS} WHERE x = 14 AND y = 26")
def spatial_contains_point(t):
    return spatial.contains(_shapes(t), spatial.G.point(14, 26)).select("_id")


@query(f"SELECT _id, round(sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40)), 6) AS distance FROM {_POINTS} WHERE sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40)) <= 25")
def spatial_near(t):
    return spatial.near(_shapes(t), 40, 40, 25).select("_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT _id, place, round(d, 6) AS distance FROM (SELECT _id, sqrt((x - 33) * (x - 33) + (y - 44) * (y - 44)) AS d, row_number() OVER (ORDER BY (x - 33) * (x - 33) + (y - 44) * (y - 44), _id) AS place FROM {_POINTS}) WHERE place <= 12")
def spatial_nearest_k(t):
    return _top(spatial.nearest(_shapes(t), 33, 44, 12))


@query(f"SELECT _id, round(sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40)), 6) AS distance FROM {_POINTS} WHERE sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40)) <= 25")
def spatial_points_near(t):
    return spatial.points_near(_points(t), 40, 40, 25).select("_id", F.round("distance", 6).alias("distance"))


def _mixed(t):
    """By id: points, horizontal lines, squares with a square hole, pairs of points."""
    G = spatial.G
    rows = t("supplier").select(F.col("s_suppkey").alias("_id"), (F.col("s_suppkey") * 7 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 89).cast("double").alias("y"))

    def ring(x, y, r):
        return ((x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r))

    def shape(i, x, y):
        kind = i % 4
        if kind == 0:
            return G.point(x, y)
        if kind == 1:
            return G.Geometry(G.LINE, ((x, y), (x + 8.0, y)))
        if kind == 2:
            return G.Geometry(G.POLYGON, (ring(x, y, 6.0), ring(x, y, 2.0)))
        return G.Geometry(G.POINTS, ((x, y), (x + 5.0, y + 5.0)))

    return spatial.with_boxes(spatial.encoded(rows, shape))


_MIXED = """(SELECT s_suppkey AS _id, s_suppkey % 4 AS kind, CAST(s_suppkey * 7 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 13 % 89 AS DOUBLE) AS y FROM supplier)"""


@query(f"SELECT _id, CASE kind WHEN 2 THEN x - 6 ELSE x END AS xmin, CASE kind WHEN 2 THEN y - 6 ELSE y END AS ymin, x + CASE kind WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 5 END AS xmax, y + CASE kind WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 0 END AS ymax FROM {_MIXED}")
def spatial_shape_boxes(t):
    return _mixed(t).select("_id", *spatial.BOX)


@query(f"""SELECT _id FROM {_MIXED} WHERE CASE kind WHEN 0 THEN x BETWEEN 30 AND 33 AND y BETWEEN 30 AND 33 WHEN 1 THEN x <= 33 AND x + 8 >= 30 AND y BETWEEN 30 AND 33
WHEN 2 THEN x - 6 <= 33 AND x + 6 >= 30 AND y - 6 <= 33 AND y + 6 >= 30 AND NOT (x - 2 < 30 AND x + 2 > 33 AND y - 2 < 30 AND y + 2 > 33)
ELSE (x BETWEEN 30 AND 33 AND y BETWEEN 30 AND 33) OR (x + 5 BETWEEN 30 AND 33 AND y + 5 BETWEEN 30 AND 33) END""")
def spatial_shapes_intersect_box(t):
    return spatial.intersects(_mixed(t), spatial.G.box(30, 30, 33, 33)).select("_id")


@query(f"""SELECT _id FROM {_MIXED} WHERE CASE kind WHEN 0 THEN x BETWEEN 10 AND 70 AND y BETWEEN 10 AND 70 WHEN 1 THEN x >= 10 AND x + 8 <= 70 AND y BETWEEN 10 AND 70
WHEN 2 THEN x - 6 >= 10 AND x + 6 <= 70 AND y - 6 >= 10 AND y + 6 <= 70 ELSE x >= 10 AND x + 5 <= 70 AND y >= 10 AND y + 5 <= 70 END""")
def spatial_shapes_within_box(t):
    return spatial.within(_mixed(t), spatial.G.box(10, 10, 70, 70)).select("_id")


@query(f"SELECT _id FROM {_MIXED} WHERE CASE kind WHEN 0 THEN x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 40 WHEN 1 THEN x + 8 <= 50 AND y <= 40 WHEN 2 THEN x - 6 >= 0 AND x + 6 <= 50 AND y - 6 >= 0 AND y + 6 <= 40 ELSE x + 5 <= 50 AND y + 5 <= 40 END")
def spatial_stored_within_box(t):
    """Among shapes that were written with their boxes along a space-filling curve."""
    stored = spatial.save(_mixed(t), new_path(t("region").sparkSession, "shapes"))
    return spatial.within(stored, spatial.G.box(0, 0, 50, 40)).select("_id")


@query(f"""SELECT _id FROM {_MIXED} WHERE CASE kind WHEN 0 THEN x = 40 AND y = 40 WHEN 1 THEN y = 40 AND 40 BETWEEN x AND x + 8
WHEN 2 THEN abs(x - 40) <= 6 AND abs(y - 40) <= 6 AND NOT (abs(x - 40) < 2 AND abs(y - 40) < 2) ELSE (x = 40 AND y = 40) OR (x = 35 AND y = 35) END""")
def spatial_shapes_contain_point(t):
    """Borders belong to shapes, those of holes too."""
    return spatial.contains(_mixed(t), spatial.G.point(40, 40)).select("_id")


@query(f"""SELECT _id, round(d, 6) AS distance FROM (SELECT _id, CASE kind WHEN 0 THEN sqrt((x - 50) ** 2 + (y - 50) ** 2) WHEN 1 THEN sqrt(greatest(x - 50, 50 - x - 8, 0) ** 2 + (y - 50) ** 2)
WHEN 2 THEN CASE WHEN abs(x - 50) < 2 AND abs(y - 50) < 2 THEN 2 - greatest(abs(x - 50), abs(y - 50)) ELSE sqrt(greatest(abs(x - 50) - 6, 0) ** 2 + greatest(abs(y - 50) - 6, 0) ** 2) END
ELSE least(sqrt((x - 50) ** 2 + (y - 50) ** 2), sqrt((x - 45) ** 2 + (y - 45) ** 2)) END AS d FROM {_MIXED}) WHERE d <= 20""")
def spatial_shapes_near(t):
    return spatial.near(_mixed(t), 50, 50, 20).select("_id", F.round("distance", 6).alias("distance"))
