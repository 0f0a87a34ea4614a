import shutil

import pytest
from pyspark.sql import types as T

from lodestone.operators import index as ix
from lodestone.sources.store import HIGHEST, Database, StoreError
from tests.conftest import rows

SCHEMA = T.StructType().add("name", "string").add("qty", "integer")


@pytest.fixture
def db(spark, tmp_path):
    now = [1000]
    d = Database(spark, str(tmp_path / "db"), lambda: now[0])
    d.now = now
    return d


def docs(spark, *data):
    return spark.createDataFrame(list(data), "_id long, name string, qty int")


def test_life_of_a_collection(spark, db):
    c = db.create_collection("things", SCHEMA)
    with pytest.raises(StoreError):
        db.create_collection("things", SCHEMA)
    with pytest.raises(StoreError):
        db.collection("nope")
    events = []
    db.listeners.append(events.append)
    c.put(docs(spark, (1, "a", 1), (2, "b", 2), (3, "c", 3)))
    assert rows(c.scan()) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)] and db.state.seq == 3
    db.checkpoint("first")
    c.put(docs(spark, (2, "B", 20)))
    c.remove(docs(spark, (1, None, None), (99, None, None)).select("_id"))
    assert rows(c.scan()) == [(2, "B", 20), (3, "c", 3)]
    assert c.get(2).name == "B" and c.get(1) is None and c.get(1, snapshot=3).name == "a"
    assert rows(c.scan(checkpoint="first")) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert [e["event"] for e in events if "event" in e] == ["put", "put", "delete"]

    again = Database(spark, db.root, db.clock).collection("things")
    assert rows(again.scan()) == [(2, "B", 20), (3, "c", 3)]

    db.compact("things")
    assert rows(c.scan()) == [(2, "B", 20), (3, "c", 3)] and rows(c.scan(checkpoint="first"))[0] == (1, "a", 1)
    db.restore("first")
    assert rows(c.scan()) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    c.put(docs(spark, (9, "after", 9)))
    assert c.size() == 4
    c.remove_range(2, 4)
    assert [r._id for r in c.scan().collect()] == [1, 9]
    c.put(docs(spark, (HIGHEST, "top", 0)))
    c.clear()
    assert [r._id for r in c.scan().collect()] == [HIGHEST] and c.get(HIGHEST).name == "top"
    with pytest.raises(StoreError):
        c.remove_range(4, 4)


def test_expiry(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1)), ttl_ms=500)
    assert c.size() == 1
    db.now[0] = 1500
    assert c.size() == 0
    db.now[0] = 1400
    assert c.size() == 1


def test_indexes_and_catalog(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1), (2, "b", 2), (3, None, 2)))
    index = c.create_index(["name"], unique=True)
    assert rows(index.covering()) == [("a", 1), ("b", 2), (None, 3)]
    with pytest.raises(ix.UniqueViolation):
        c.put(docs(spark, (4, "a", 1)))
    assert c.size() == 3
    c.put(docs(spark, (1, "a", 5)))
    assert rows(c.index(["name"]).lookup(ix.Scan(("a",)))) == [(1,)]
    db.create_repository("User", SCHEMA, "eu")
    assert {r["name"]: r.type for r in db.catalog().where("kind = 'data'").collect()} == {"t": "collection", "User+eu": "keyed_repository"}
    assert [r["name"] for r in db.catalog().where("owner = 't'").collect()] == ["t:name"]
    db.set_attribute("t", "colour", "red")
    assert db.state.attributes["t"] == {"colour": "red", "last_modified": 1000}
    db.drop("t")
    assert db.catalog().where("owner = 't'").count() == 0 and db.state.next_tree == 4


def test_backup_verify_repair(spark, db, tmp_path):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1), (2, "b", 2)))
    first = db.backup(str(tmp_path / "copy"))
    c.put(docs(spark, (3, "c", 3)))
    more = db.backup(str(tmp_path / "copy"), set(first))
    assert len(more) == 1 and Database(spark, str(tmp_path / "copy")).collection("t").size() == 3
    c.remove(docs(spark, (1, None, None)).select("_id"))
    db.compacting_backup(str(tmp_path / "small"))
    small = Database(spark, str(tmp_path / "small"), db.clock)
    assert rows(small.collection("t").scan()) == rows(c.scan()) and small.metrics()["versions"] == 2
    assert db.verify() == []
    shutil.rmtree(tmp_path / "db" / more[0])
    assert len(db.verify()) == 1
    assert db.repair() == more and db.verify() == []
    assert "segments_probed_per_lookup" in db.metrics()["unavailable"]


def test_quarantine(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1), (50, "b", 2)))
    db.quarantine("t", 40, 60, "checksum")
    assert c.get(1).name == "a" and [r._id for r in c.scan(0, 40).collect()] == [1]
    with pytest.raises(StoreError, match="40 to 60"):
        c.scan()
    with pytest.raises(StoreError):
        c.get(50)


def test_writers_dont_overwrite(spark, db):
    other = Database(spark, db.root, db.clock)
    db.create_collection("a", SCHEMA)
    with pytest.raises(StoreError):
        other.create_collection("b", SCHEMA)


def test_expired_checkpoints(db):
    db.checkpoint("c", expires=1000)
    with pytest.raises(StoreError):
        db.checkpoint("c")
    assert db.expire_checkpoints() == ["c"] and db.expire_checkpoints() == []


def test_stored_indexes_follow_every_write(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, *((i, f"n{i % 4}", i) for i in range(20))))
    c.create_index(["name"])
    c.create_index(["qty", "name"])

    def same():
        for fields in (["name"], ["qty", "name"]):
            index = c.index(fields)
            assert index.stored and rows(index.covering()) == rows(ix.create(c.scan(), "_id", "x", fields).covering())

    same()
    c.put(docs(spark, (3, "moved", 3), (50, "new", 1)))
    same()
    c.remove(docs(spark, (5, None, None), (50, None, None)).select("_id"))
    c.remove_range(10, 14)
    c.put(docs(spark, (12, "back", 12)))
    same()
    assert len(db.state.entries["t:name"]) > 3 and db.verify() == []
    db.compact_index("t:name")
    same()
    again = Database(spark, db.root, db.clock).collection("t")
    assert rows(again.index(["name"]).lookup(ix.Scan(("back",)))) == [(12,)]
    assert rows(again.find({"qty": 3}).select("_id", "name")) == [(3, "moved")]
    db.checkpoint("here")
    c.put(docs(spark, (1, "later", 1)))
    db.restore("here")
    assert db.state.trees["t:name"]["stale"] and rows(c.index(["name"]).lookup(ix.Scan(("later",)))) == []
    c.rebuild_index(["name"])
    c.rebuild_index(["qty", "name"])
    same()
    db.state.entries["t:name"].append(db.state.entries["t:name"][0])
    assert [f for f in db.verify() if f.startswith("t:name")]


def test_expired_documents_leave_indexes(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.create_index(["name"])
    c.put(docs(spark, (1, "a", 1)), ttl_ms=500)
    c.put(docs(spark, (2, "a", 2)))
    assert rows(c.index(["name"]).lookup()) == [(1,), (2,)]
    db.now[0] += 500
    assert rows(c.index(["name"]).lookup()) == [(2,)]


def test_a_damaged_manifest_is_left_out(spark, db):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1)))
    before = db.state.commit
    c.put(docs(spark, (2, "b", 2)))
    with open(f"{db.root}/manifest/{db.state.commit:012d}.json".removeprefix("file:"), "w") as f:
        f.write("{")
    again = Database(spark, db.root, db.clock)
    assert rows(again.collection("t").scan()) == [(1, "a", 1)] and again.skipped and again.state.commit == before + 1
    assert len(again.verify()) == 1
    again.collection("t").put(docs(spark, (3, "c", 3)))
    assert rows(Database(spark, db.root, db.clock).collection("t").scan()) == [(1, "a", 1), (3, "c", 3)]


def test_repair_makes_indexes_anew(spark, db, tmp_path):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1)))
    c.put(docs(spark, (2, "b", 2)))
    c.create_index(["name"])
    shutil.rmtree(tmp_path / "db" / db.state.segments[1]["path"])
    assert any("can't be read" in f for f in db.verify())
    assert len(db.repair()) == 1 and db.verify() == []
    assert rows(c.index(["name"]).covering()) == [("a", 1)] and not db.state.trees["t:name"]["stale"]
    shutil.rmtree(tmp_path / "db" / db.state.entries["t:name"][0]["path"])
    assert db.verify() and len(db.repair()) == 1 and db.verify() == []
    assert rows(c.index(["name"]).covering()) == [("a", 1)]


def test_backups_hold_indexes(spark, db, tmp_path):
    c = db.create_collection("t", SCHEMA)
    c.put(docs(spark, (1, "a", 1)))
    c.create_index(["name"])
    target = str(tmp_path / "copy")
    first = db.backup(target)
    c.put(docs(spark, (2, "b", 2)))
    db.backup(target, set(first))
    copy = Database(spark, target, db.clock)
    assert rows(copy.collection("t").index(["name"]).covering()) == [("a", 1), ("b", 2)] and copy.verify() == []
