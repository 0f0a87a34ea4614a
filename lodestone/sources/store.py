"""A document store in a folder of Parquet: a catalog, a version log for each tree, and atomic commits by numbered manifests.

Layout: <root>/log/tree=<id>/<commit>/*.parquet and <root>/manifest/<commit>.json. A commit first
writes its files, then its manifest; readers take the newest manifest and only files it names, so a
writer that dies leaves files nobody reads. One writer at a time. All access goes through Hadoop's
file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import expand
from ..operators import index as ix
from ..operators import versions as V

KINDS = ("data", "index", "name_dict", "term_dict", "term_index", "postings", "rtree", "vector_graph", "kv", "internal")
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
VERSION_FIELDS = "key long, seq long, op string, expiry_ms long, end_key long, written_ms long"


class StoreError(RuntimeError):
    pass


class Files:
    """A few file operations on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def list(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Appears whole or not at all; an existing file is an error."""
        p, fs = self._at(path)
        if fs.exists(p):
            raise StoreError(f"{path} is there already: another writer was first")
        hidden, _ = self._at(path.rsplit("/", 1)[0] + "/_" + path.rsplit("/", 1)[1])
        stream = fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(hidden, p):
            raise StoreError(f"{path} could not be put in place")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        (a, fa), (b, fb) = self._at(source), self._at(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, self._conf)


@dataclass
class State:
    """What a manifest holds."""

    commit: int = 0
    seq: int = 0
    next_tree: int = 1
    trees: dict[str, dict] = field(default_factory=dict)
    segments: list[dict] = field(default_factory=list)
    checkpoints: dict[str, dict] = field(default_factory=dict)
    abandoned: list[list[int]] = field(default_factory=list)
    quarantined: list[dict] = field(default_factory=list)
    attributes: dict[str, dict] = field(default_factory=dict)
    feed: list[int] = field(default_factory=list)
    feed_from: dict[str, int] = field(default_factory=dict)
    entries: dict[str, list[dict]] = field(default_factory=dict)  # of each index: written entries, and the ids each replaced


class Database:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.root, self.clock, self.files = spark, root.rstrip("/"), clock, Files(spark)
        self.listeners: list[Callable[[dict], None]] = []
        commits = [n for n in self.files.list(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith("_")]
        self.state, self.skipped = State(), []
        for name in reversed(commits):  # a manifest that can't be read is left out, and the one before it holds
            try:
                self.state = State(**json.loads(self.files.read(f"{self.root}/manifest/{name}")))
                break
            except Exception as e:
                if not isinstance(e, (ValueError, TypeError)) and "ChecksumException" not in str(e):
                    raise  # a store that can't be reached is no damage
                self.skipped.append(name)
        if self.skipped:
            self.state.commit = int(commits[-1].split(".")[0])  # numbers are never used again

    # --- catalog ---

    def _new_tree(self, name: str, kind: str, **params) -> dict:
        if kind not in KINDS:
            raise StoreError(f"no kind {kind!r}")
        if name in self.state.trees:
            raise StoreError(f"there is a tree {name!r}")
        tree = {"tree_id": self.state.next_tree, "kind": kind, "params": params, "stale": False}
        self.state.next_tree += 1  # ids are never used again
        self.state.trees[name] = tree
        return tree

    def create_collection(self, name: str, schema: T.StructType, **params) -> Collection:
        self._new_tree(name, "data", schema=schema.json(), type="collection", **params)
        self._commit([])
        return self.collection(name)

    def create_repository(self, entity: str, schema: T.StructType, key: str | None = None) -> Collection:
        name = f"{entity}+{key}" if key else entity
        self._new_tree(name, "data", schema=schema.json(), type="keyed_repository" if key else "repository", entity=entity, key=key)
        self._commit([])
        return self.collection(name)

    def collection(self, name: str) -> Collection:
        if name not in self.state.trees:
            raise StoreError(f"no tree {name!r}")
        return Collection(self, name)

    def catalog(self) -> DataFrame:
        rows = [(n, t["tree_id"], t["kind"], t["params"].get("type"), t["params"].get("owner"), t["stale"]) for n, t in sorted(self.state.trees.items())]
        return self.spark.createDataFrame(rows, "name string, tree_id int, kind string, type string, owner string, stale boolean")

    def drop(self, name: str) -> None:
        tree = self.state.trees[name]
        if tree["kind"] not in KINDS:
            raise StoreError(f"{name} is of a kind that isn't known here; it must not be deleted")
        for n in [n for n, t in self.state.trees.items() if t["params"].get("owner") == name]:
            del self.state.trees[n]
            self.state.entries.pop(n, None)
        del self.state.trees[name]
        self.state.entries.pop(name, None)
        self._commit([])

    def set_attribute(self, name: str, key: str, value) -> None:
        self.state.attributes.setdefault(name, {})[key] = value
        self.state.attributes[name]["last_modified"] = self.clock()
        self._commit([])

    # --- commits ---

    def _commit(self, segments: list[dict], event: dict | None = None) -> None:
        self.state.segments += segments
        self.state.commit += 1
        self.files.write_new(f"{self.root}/manifest/{self.state.commit:012d}.json", json.dumps(self.state.__dict__))
        for f in self.listeners:
            f({"commit": self.state.commit, "seq": self.state.seq, **(event or {})})

    def _append(self, name: str, rows: DataFrame, event: str) -> None:
        """rows: key, op, expiry_ms, end_key and the fields; seqs follow the newest in order of keys, within ranges of keys. Stored indexes follow in the same commit."""
        tree = self.state.trees[name]
        rows = rows.withColumn("written_ms", F.lit(self.clock()))
        path = f"{self.root}/log/tree={tree['tree_id']}/{self.state.commit + 1:012d}"
        staged = f"{path}-staged"
        rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id()).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        part = F.shiftright("place", 33)
        sizes = {r.part: r.n for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        starts, at = [], self.state.seq + 1
        for p in sorted(sizes):
            starts.append((p, at))
            at += sizes[p]
        offset = self.spark.createDataFrame(starts, "part long, start long")
        numbered = held.withColumn("part", part).join(F.broadcast(offset), "part").withColumn("seq", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "start", "place")
        numbered.sortWithinPartitions("key").write.parquet(path)
        self.files.delete(staged)
        if event in ("put", "delete", "range_delete"):
            self._follow(name, self.spark.read.parquet(path), event)
        self.state.seq = at - 1
        self._commit([{"tree": name, "path": path[len(self.root) + 1 :], "rows": sum(sizes.values()), "low": starts[0][1] if starts else at, "high": at - 1}], {"event": event, "tree": name})

    # --- stored indexes ---

    def _indexes(self, name: str) -> dict[str, dict]:
        return {n: t for n, t in self.state.trees.items() if t["kind"] == "index" and t["params"].get("owner") == name and not t["stale"]}

    def _write_entries(self, index: str, entries: DataFrame, changed: DataFrame | None) -> None:
        """One more piece of an index: new entries, and the ids whose older entries no longer count."""
        tree = self.state.trees[index]
        path = f"entries/tree={tree['tree_id']}/{self.state.commit + 1:012d}"
        columns = [c for c in entries.columns if c.startswith("v")]
        order = [F.col(c).asc_nulls_first() for c in [*columns, "_id"]]
        entries.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{path}/entries")
        if changed is not None:
            changed.write.parquet(f"{self.root}/{path}/ids")
        self.state.entries.setdefault(index, []).append({"path": path, "ids": changed is not None})

    def _follow(self, name: str, written: DataFrame, event: str) -> None:
        for index, tree in self._indexes(name).items():
            if event == "range_delete":  # the ids that are there now
                r = written.select("key", "end_key").first()
                changed = self.collection(name).scan(r["key"], r["end_key"]).select("_id")
                entries = self.entries(index).where(F.lit(False))
            else:
                changed = written.select(F.col("key").alias("_id"))
                puts = written.where("op = 'put'").withColumnRenamed("key", "_id")
                p = tree["params"]
                made = expand(puts, "_id", p["fields"], p["sparse"])
                entries = made.join(puts.select("_id", "expiry_ms"), "_id").select(*made.columns, "expiry_ms")
            self._write_entries(index, entries, changed)

    def entries(self, index: str) -> DataFrame:
        """v1..vk, _id, expiry_ms of an index as of the last commit: one piece is a plain scan; of several, a piece's entries count unless a later one replaced their ids."""
        pieces, out = self.state.entries[index], None
        replaced = None
        for i, piece in reversed([*enumerate(pieces)]):
            rows = self.spark.read.parquet(f"{self.root}/{piece['path']}/entries")
            rows = rows if replaced is None else rows.join(replaced, "_id", "left_anti").select(*rows.columns)
            out = rows if out is None else rows.unionByName(out)
            if piece["ids"] and i:
                ids = self.spark.read.parquet(f"{self.root}/{piece['path']}/ids")
                replaced = ids if replaced is None else replaced.unionByName(ids)
        return out

    def compact_index(self, index: str) -> None:
        """All pieces as one."""
        entries = self.entries(index)
        self.state.entries[index] = []
        self._write_entries(index, entries, None)
        self._commit([], {"event": "compact", "tree": index})

    def log(self, name: str) -> DataFrame:
        tree = self.state.trees[name]
        schema = T.StructType([*T._parse_datatype_string(VERSION_FIELDS).fields, *T.StructType.fromJson(json.loads(tree["params"]["schema"])).fields])
        paths = [f"{self.root}/{s['path']}" for s in self.state.segments if s["tree"] == name]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        out = rows.withColumn("tree_id", F.lit(tree["tree_id"]))
        for low, high in self.state.abandoned:
            out = out.where(~F.col("seq").between(low + 1, high))
        return out

    # --- checkpoints ---

    def checkpoint(self, name: str, expires: int | None = None) -> None:
        if name in self.state.checkpoints:
            raise StoreError(f"there is a checkpoint {name!r}")
        self.state.checkpoints[name] = {"seq": self.state.seq, "commit": self.state.commit, "created": self.clock(), "expires": expires}
        self._commit([])

    def restore(self, name: str) -> None:
        """Back to a checkpoint; counters go on, and other checkpoints stay."""
        self.state.abandoned.append([self.state.checkpoints[name]["seq"], self.state.seq])
        for tree in self.state.trees.values():  # their entries are of what is given up
            tree["stale"] |= tree["kind"] == "index"
        self._commit([])

    def expire_checkpoints(self) -> list[str]:
        now = self.clock()
        gone = [n for n, c in self.state.checkpoints.items() if c["expires"] is not None and c["expires"] <= now]
        for n in gone:
            del self.state.checkpoints[n]
        if gone:
            self._commit([])
        return gone

    # --- backup and repair ---

    def backup(self, target: str, known: set[str] | None = None) -> list[str]:
        """Copies segments (only those not in known: incremental) and the manifest; the copy is checked before this returns."""
        copied = [s["path"] for s in self.state.segments if s["path"] not in (known or set())]
        pieces = [x["path"] for xs in self.state.entries.values() for x in xs if not self.files.list(f"{target}/{x['path']}")]
        for p in copied + pieces:
            self.files.copy(f"{self.root}/{p}", f"{target}/{p}")
        self.files.write_new(f"{target}/manifest/{self.state.commit:012d}.json", json.dumps(self.state.__dict__))
        for s in self.state.segments:
            if s["path"] in copied and self.spark.read.parquet(f"{target}/{s['path']}").count() != s["rows"]:
                raise StoreError(f"the copy of {s['path']} is not whole")
        return copied

    def compacting_backup(self, target: str) -> None:
        """A database in target with what readers see now and nothing else."""
        other = Database(self.spark, target, self.clock)
        for name, tree in self.state.trees.items():
            if tree["kind"] == "data":
                other._new_tree(name, "data", **tree["params"])
                seen = V.read(self.log(name), None, self.clock()).withColumn("end_key", F.lit(None).cast("long"))
                other._append(name, seen.select(*other.collection(name)._columns()), "backup")

    def compact(self, name: str) -> None:
        """Rewrites a tree's log to what any checkpoint or reader still sees, sorted by key."""
        floor = min([c["seq"] for c in self.state.checkpoints.values()], default=None)
        log = self.log(name)
        tree = self.state.trees[name]
        path = f"{self.root}/log/tree={tree['tree_id']}/{self.state.commit + 1:012d}-compacted"
        kept = V.compact(log, floor, self.clock()).drop("tree_id")
        kept.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "seq").write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        self.state.segments = [s for s in self.state.segments if s["tree"] != name]
        self._commit([{"tree": name, "path": path[len(self.root) + 1 :], "rows": rows, "low": 0, "high": self.state.seq}], {"event": "compact", "tree": name})

    def quarantine(self, name: str, low: int, high: int, why: str) -> None:
        """Keys of [low, high) can't be trusted: reads that touch them fail and say so, all others go on."""
        self.state.quarantined.append({"tree": name, "low": low, "high": high, "why": why})
        self._commit([])

    def verify(self) -> list[str]:
        """Findings; none if all is well."""
        found = [f"manifest/{name}: can't be read, and was left out" for name in self.skipped]
        for s in self.state.segments:
            try:
                n = self.spark.read.parquet(f"{self.root}/{s['path']}").count()
                if n != s["rows"]:
                    found.append(f"{s['path']}: {n} rows, not {s['rows']}")
            except Exception as e:  # any damage is a finding
                found.append(f"{s['path']}: can't be read ({type(e).__name__})")
        for name, tree in self.state.trees.items():
            owner = tree["params"].get("owner")
            if owner and owner not in self.state.trees:
                found.append(f"{name}: its collection {owner} isn't there")
            elif name in self._indexes(owner or ""):
                try:
                    c, p = self.collection(owner), tree["params"]
                    wrong = ix.verify(c.index(p["fields"]), c.scan(), "_id").groupBy("finding").count().collect()
                    found += [f"{name}: {r['count']} entries {r.finding}" for r in sorted(wrong)]
                except Exception as e:
                    found.append(f"{name}: can't be read ({type(e).__name__})")
        return found

    def repair(self) -> list[str]:
        """Leaves out segments that can't be read, makes their trees' indexes anew from what is left, and says which."""
        bad, lost = [], set()
        for s in list(self.state.segments):
            try:
                self.spark.read.parquet(f"{self.root}/{s['path']}").count()
            except Exception:
                bad.append(s["path"])
                lost.add(s["tree"])
                self.state.segments.remove(s)
        for index, pieces in self.state.entries.items():
            try:
                for piece in pieces:
                    self.spark.read.parquet(f"{self.root}/{piece['path']}/entries").count()
            except Exception:
                bad.append(piece["path"])
                self.state.trees[index]["stale"] = True
        for t in self.state.trees.values():
            t["stale"] |= t["params"].get("owner") in lost
        if bad:
            self._commit([])
        for name, t in list(self.state.trees.items()):
            if bad and t["kind"] == "index" and t["stale"]:
                self.collection(t["params"]["owner"]).rebuild_index(t["params"]["fields"])
        return bad

    def metrics(self) -> dict:
        """Counters of the store; those that can't be had are named, not made up."""
        rows = sum(s["rows"] for s in self.state.segments)
        return {"commits": self.state.commit, "seq": self.state.seq, "trees": len(self.state.trees), "segments": len(self.state.segments), "versions": rows, "unavailable": ["segments_probed_per_lookup", "bytes_per_barrier"]}


class Collection:
    """Documents by id. Fields are columns; ids are longs."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name
        self.schema = T.StructType.fromJson(json.loads(db.state.trees[name]["params"]["schema"]))

    def _columns(self) -> list[str]:
        return ["key", "op", "expiry_ms", "end_key", *self.schema.names]

    def put(self, docs: DataFrame, id_col: str = "_id", ttl_ms: int | None = None) -> None:
        """Adds or replaces. Of several rows with one id, the last by the order of their fields stays. Unique indexes are checked first."""
        expiry = F.lit(None if ttl_ms is None else self.db.clock() + ttl_ms).cast("long")
        fields = F.struct(*(docs[f"`{f}`"] for f in self.schema.names))
        rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("key"), fields.alias("f")).groupBy("key").agg(F.max("f").alias("f"))
        rows = rows.select("key", F.lit("put").alias("op"), expiry.alias("expiry_ms"), F.lit(None).cast("long").alias("end_key"), *(F.col(f"f.{f}").alias(f) for f in self.schema.names))
        for name, tree in self.db.state.trees.items():
            if tree["params"].get("owner") == self.name and tree["params"].get("unique"):
                after = self.scan().join(rows, F.col("_id") == F.col("key"), "left_anti").unionByName(rows.select(F.col("key").alias("_id"), *self.schema.names))
                ix.create(after, "_id", name, tree["params"]["fields"], True, tree["params"]["sparse"])
        self.db._append(self.name, rows.select(*self._columns()), "put")

    def _mark(self, rows: DataFrame, op: str) -> None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.db._append(self.name, rows.select("key", F.lit(op).alias("op"), F.lit(None).cast("long").alias("expiry_ms"), "end_key", *blank), op)

    def remove(self, ids: DataFrame) -> None:
        """Ids in column _id; those that aren't there make no difference."""
        there = ids.select(F.col("_id").cast("long").alias("_id")).distinct().join(self.scan().select("_id"), "_id", "left_semi")
        self._mark(there.select(F.col("_id").alias("key"), F.lit(None).cast("long").alias("end_key")), "delete")

    def remove_range(self, low: int, high: int) -> None:
        if low >= high:
            raise StoreError("an empty range")
        self._mark(self.db.spark.createDataFrame([(low, high)], "key long, end_key long"), "range_delete")

    def clear(self) -> None:
        """All but the highest possible id, as ranges are half-open."""
        self.remove_range(LOWEST, HIGHEST)

    def _check(self, low: int | None, high: int | None) -> None:
        for q in self.db.state.quarantined:
            if q["tree"] == self.name and (high is None or q["low"] < high) and (low is None or q["high"] > low):
                raise StoreError(f"keys {q['low']} to {q['high']} of {self.name} are set aside: {q['why']}")

    def scan(self, low: int | None = None, high: int | None = None, snapshot: int | None = None, checkpoint: str | None = None) -> DataFrame:
        """_id and fields of [low, high) as of a snapshot."""
        self._check(low, high)
        snapshot = self.db.state.checkpoints[checkpoint]["seq"] if checkpoint else snapshot
        tree = self.db.state.trees[self.name]["tree_id"]
        found = V.scan(self.db.log(self.name), tree, low, high, snapshot, self.db.clock())
        return found.select(F.col("key").alias("_id"), *self.schema.names)

    def get(self, doc_id: int, snapshot: int | None = None):
        return next(iter(self.scan(doc_id, doc_id + 1, snapshot).take(1)), None) if doc_id < HIGHEST else next(iter(self.scan(doc_id, None, snapshot).take(1)), None)

    def size(self) -> int:
        return self.scan().count()

    def create_index(self, fields: list[str], unique: bool = False, sparse: bool = False) -> ix.Index:
        """Written with backfill; every later write keeps it."""
        name = f"{self.name}:{','.join(fields)}"
        made = ix.create(self.scan(), "_id", name, fields, unique, sparse)
        self.db._new_tree(name, "index", owner=self.name, fields=fields, unique=unique, sparse=sparse)
        self._fill(name, made)
        self.db._commit([])
        return self.index(fields)

    def _fill(self, name: str, made: ix.Index) -> None:
        log = self.db.log(self.name)
        expiry = V.newest(log).select(F.col("key").alias("_id"), "expiry_ms")
        self.db.state.entries[name] = []
        self.db._write_entries(name, made.entries.join(expiry, "_id").select(*made.columns, "_id", "expiry_ms"), None)

    def rebuild_index(self, fields: list[str]) -> ix.Index:
        """Makes a stale index anew from the documents."""
        name = f"{self.name}:{','.join(fields)}"
        tree = self.db.state.trees[name]
        p = tree["params"]
        self._fill(name, ix.create(self.scan(), "_id", name, p["fields"], p["unique"], p["sparse"]))
        tree["stale"] = False
        self.db._commit([])
        return self.index(fields)

    def index(self, fields: list[str]) -> ix.Index:
        """The stored entries, without expired documents; a stale index is answered from the documents until it is rebuilt."""
        name = f"{self.name}:{','.join(fields)}"
        tree = self.db.state.trees[name]
        p = tree["params"]
        if tree["stale"]:
            return ix.create(self.scan(), "_id", name, p["fields"], False, p["sparse"])
        live = F.col("expiry_ms").isNull() | (F.col("expiry_ms") > self.db.clock())
        return ix.Index(name, p["fields"], self.db.entries(name).where(live).drop("expiry_ms"), p["unique"], p["sparse"], stored=True)

    def find(self, equal: dict, ranged: str | None = None, op: str | None = None, value=None, upper=None) -> DataFrame:
        """Documents by equality on fields and a range on one more, through whichever index fits, else by a scan."""
        indexes = [self.index(t["params"]["fields"]) for t in self.db._indexes(self.name).values()]
        return ix.Planner(self.scan(), "_id", indexes).find(equal, ranged, op, value, upper)
