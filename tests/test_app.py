import pytest
from pyspark.sql import functions as F

from freshet.app import App
from freshet.operators import ledger, tasks
from freshet.schema import VectorSchema, evolve, primary_key, record_schema, store_type
from freshet.targets.base import certify
from freshet.targets.database import DatabaseTable, Dialect, sqlite_connector, vector_search_sql
from freshet.targets.files import DirTarget, topic_messages
from freshet.targets.lake import LakeTable, LiveMap


def lake(spark, folder):
    return LakeTable(spark, str(folder), spark.createDataFrame([], "k int, v string").schema, ["k"])


def test_runs_write_only_what_changed(spark, tmp_path):
    data = {"rows": {1: "a", 2: "b"}}
    target = lake(spark, tmp_path / "t")
    app = App(spark, "app", str(tmp_path / "ledger"), lambda s: {"t": s.createDataFrame(list(data["rows"].items()), "k int, v string")}, {"t": target})
    read = lambda: {r["k"]: r["v"] for r in target.read().collect()}
    assert app.update().counts == {"t": {"insert": 2}} and read() == {1: "a", 2: "b"}
    assert app.update().total() == 0
    data["rows"] = {2: "c", 3: "d"}
    assert {r["k"]: r["action"] for r in app.preview()["t"].collect()} == {1: "delete", 2: "replace", 3: "insert"}
    assert read() == {1: "a", 2: "b"}
    assert app.update().counts == {"t": {"delete": 1, "replace": 1, "insert": 1}} and read() == {2: "c", 3: "d"}
    assert app.update(full_reprocess=True).counts == {"t": {"upsert": 2}}
    assert app.stats().first()["rows"] == 2


def test_a_failed_batch_is_written_again(spark, tmp_path):
    class Failing(LakeTable):
        fail = True

        def apply(self, actions):
            if self.fail:
                raise OSError("no")
            super().apply(actions)

    target = Failing(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v string").schema, ["k"])
    app = App(spark, "app", str(tmp_path / "ledger"), lambda s: {"t": s.createDataFrame([(1, "a")], "k int, v string")}, {"t": target})
    with pytest.raises(OSError):
        app.update()
    target.fail = False
    assert app.update().counts == {"t": {"upsert": 1}}
    assert app.update().total() == 0


def test_runs_add_what_they_change_and_events_are_settled(spark, tmp_path, monkeypatch):
    from freshet import app as apps

    monkeypatch.setattr(apps, "_MOST_PARTS", 4)
    rows = {i: str(i) for i in range(40)}
    target = lake(spark, tmp_path / "t")
    app = App(spark, "app", str(tmp_path / "ledger"), lambda s: {"t": s.createDataFrame(list(rows.items()), "k int, v string")}, {"t": target})
    app.update()
    before = app.ledger.version
    assert app.update().total() == 0 and app.ledger.version == before  # nothing is written by a run that changes nothing
    for n in range(4):
        rows[n] = f"new {n}"
        del rows[39 - n]
        assert app.update().counts == {"t": {"replace": 1, "delete": 1}}
        assert {r["k"]: r["v"] for r in target.read().collect()} == rows
        assert len(app.ledger.tables()["tracked-t"]) < 5
    assert len(target._ledger.tables()["rows"]) == 1 and app.stats().first()["rows"] == 36
    rows.clear()
    assert app.update().counts == {"t": {"delete": 36}} and target.read().count() == 0 and app.stats().count() == 0


def test_live_runs_follow_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    write = lambda *rows: spark.createDataFrame(list(rows), "k int, v string").coalesce(1).write.mode("append").parquet(source)
    write((1, "a"))
    target = lake(spark, tmp_path / "t")
    app = App(spark, "app", str(tmp_path / "ledger"), lambda s: {"t": s.read.parquet(source).groupBy("k").agg(F.max("v").alias("v"))}, {"t": target})
    stream = lambda: spark.readStream.schema("k int, v string").parquet(source)
    app.live(stream(), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["k"]: r["v"] for r in target.read().collect()} == {1: "a"}
    before = app.ledger.version
    app.live(stream(), str(tmp_path / "cp")).awaitTermination(60)
    assert app.ledger.version == before
    write((1, "b"), (2, "c"))
    app.live(stream(), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["k"]: r["v"] for r in target.read().collect()} == {1: "b", 2: "c"}


def test_one_of_two_writers_fails_and_neither_loses_rows(spark, tmp_path):
    a, b = ledger.Ledger(spark, str(tmp_path / "l")), ledger.Ledger(spark, str(tmp_path / "l"))
    a.commit(x=spark.createDataFrame([(0,)], "a int"))
    late = a._newest()
    b.commit(x=spark.createDataFrame([(1,)], "a int"))
    a._newest = lambda: late
    with pytest.raises(RuntimeError, match="came between"):
        a.commit(x=spark.createDataFrame([(2,)], "a int"))
    del a._newest
    assert a.version == 2 and [r["a"] for r in a.read("x", "a int").collect()] == [1]
    a.commit(add={"x": spark.createDataFrame([(3,)], "a int")}, notes={"n": "said"})
    assert sorted(r["a"] for r in b.read("x", "a int").collect()) == [1, 3] and b.note("n") == "said" and b.note("m") is None
    with open(tmp_path / "l/commit-4", "w") as half:  # a pointer that is being written
        half.write('{"tabl')
    assert b.version == 3


def test_lake_tables_keep_changes_apart_until_they_are_many(spark, tmp_path):
    t = lake(spark, tmp_path / "t")
    t.prepare()
    act = lambda *rows: t.apply(spark.createDataFrame(list(rows), "k int, v string, action string"))
    act(*[(i, "a", "insert") for i in range(30)], (None, "null", "insert"))
    base = t._ledger.tables()["rows"]
    act((1, "b", "replace"), (2, None, "delete"), (None, "other", "replace"))
    act((2, "c", "insert"), (1, None, "delete"), (3, "d", "none"))
    assert t._ledger.tables()["rows"] == base
    want = {i: "a" for i in range(30)} | {2: "c", None: "other"}
    del want[1]
    assert {r["k"]: r["v"] for r in t.read().collect()} == want and t.read().count() == 30
    act(*[(i, "z", "replace") for i in range(10, 20)])
    assert t._ledger.tables()["rows"] != base and {r["k"]: r["v"] for r in t.read().collect()} == want | {i: "z" for i in range(10, 20)}


def test_sqlite_files_and_messages(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    db = str(tmp_path / "x.db")
    t = DatabaseTable(sqlite_connector(db), "sqlite", "items", schema, ["k"])
    acts = spark.createDataFrame([(1, "a", "insert"), (2, "b", "upsert")], "k int, v string, action string")

    def read():
        rows = sqlite_connector(db)().execute("SELECT k, v FROM items").fetchall()
        return spark.createDataFrame(rows, "k int, v string")

    assert certify(t, acts, read) == {"written": True, "idempotent": True, "deleted": True}
    d = DirTarget(str(tmp_path / "out"))
    d.prepare()
    d.apply(spark.createDataFrame([("a/b.txt", "hi", "insert"), ("c.txt", "x", "insert")], "key string, content string, action string"))
    assert (tmp_path / "out/a/b.txt").read_text() == "hi"
    d.apply(spark.createDataFrame([("a/b.txt", None, "delete")], "key string, content string, action string"))
    assert not (tmp_path / "out/a").exists() and (tmp_path / "out/c.txt").exists()
    with pytest.raises(Exception, match="leaves the folder"):
        d.apply(spark.createDataFrame([("../x", "x", "insert")], "key string, content string, action string"))
    sent = topic_messages(spark.createDataFrame([("a", "1", "insert"), ("b", "2", "none"), ("c", None, "delete")], "k string, v string, action string"), "k", "v")
    assert sorted(map(tuple, sent.collect())) == [("a", "1"), ("c", None)]


def test_statements():
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    s = StructType([StructField("k", LongType()), StructField("v", StringType())])
    for d in ("postgres", "sqlite", "snowflake", "bigquery", "doris"):
        assert "k" in Dialect(d).create_table("t", s, ["k"]) and "t" in Dialect(d).upsert("t", ["k"], ["v"]) and "DELETE" in Dialect(d).delete("t", ["k"])
    assert "ON CONFLICT" in Dialect("postgres").upsert("t", ["k"], ["v"]) and "MERGE INTO" in Dialect("snowflake").upsert("t", ["k"], ["v"])
    with pytest.raises(ValueError):
        Dialect("postgres").quoted('x"; DROP')
    assert vector_search_sql("t", "v", [1.0], "l2", 3, ["k"]).endswith("ORDER BY score ASC LIMIT 3")
    assert "DESC" in vector_search_sql("t", "v", [1.0], "inner_product", 3, ["k"]) and "USING hnsw" in Dialect("postgres").vector_index("t", "v")


def test_schemas():
    from dataclasses import dataclass
    from typing import Annotated

    @dataclass
    class Doc:
        id: int
        title: str | None
        tags: list[str]
        vector: Annotated[list[float], VectorSchema(4)]
        extra: int | str

    import sys

    sys.modules[__name__].Doc = Doc
    s = record_schema(Doc, ("id",))
    assert primary_key(s) == ["id"] and not s["id"].nullable and s["title"].nullable and s["vector"].metadata["dim"] == 4
    assert store_type(s["vector"], "postgres") == "vector(4)" and store_type(s["tags"], "postgres") == "jsonb" and store_type(s["extra"], "sqlite") == "TEXT"
    from pyspark.sql.types import StructType

    assert evolve(s, StructType(s.fields[:3]))["dropped"] == ["extra", "vector"]


def test_live_map():
    seen = []
    m = LiveMap()
    m.declare_entry("a", 1)
    m.watch(lambda *e: seen.append(e))
    assert not m.declare_entry("a", 1) and m.declare_entry("a", 2) and m.delete("a") and not m.delete("a")
    assert seen == [("upsert", "a", 1), ("upsert", "a", 2), ("delete", "a", None)]


def test_ledger_and_memo(spark, tmp_path):
    led = ledger.Ledger(spark, str(tmp_path / "l"))
    assert led.read("x", "a int").count() == 0
    for i in range(4):
        led.commit(x=spark.createDataFrame([(i,)], "a int"))
    led.prune(1)
    assert led.version == 4 and led.read("x", "a int").first()["a"] == 3
    calls = []

    def compute(misses):
        calls.append(misses.count())
        return misses.withColumn("r", F.upper("fp"))

    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, fp string")
    memo = spark.createDataFrame([("b", "OLD"), ("z", "Z")], "fp string, r string")
    out, kept = ledger.memoize(items, memo, ["fp"], compute)
    assert sorted((r["k"], r["r"]) for r in out.collect()) == [(1, "A"), (2, "A"), (3, "OLD")] and calls == [1]
    assert sorted(r["fp"] for r in kept.collect()) == ["a", "b"]
    first = ledger.stable_ids(spark.createDataFrame([("a",), ("b",), ("a",)], "dep string"), spark.createDataFrame([], "dep string, id bigint"))
    again = ledger.stable_ids(spark.createDataFrame([("a",), ("c",)], "dep string"), first)
    one, two = {r["dep"]: r["id"] for r in first.collect()}, {r["dep"]: r["id"] for r in again.collect()}
    assert one["a"] != one["b"] and min(one.values()) >= 1 and all(two[k] == one[k] for k in one) and len(set(two.values())) == 3


def test_batches(spark):
    def fn(xs):
        if any(x == 3 for x in xs):
            raise ValueError("three")
        return [x * 2 for x in xs]

    assert [r for r, _ in tasks.run_batch(fn, [1, 2, 3, 4])] == [2, 4, None, 8]
    got = tasks.map_rows(spark.createDataFrame([(i,) for i in range(5)], "x long"), "x", fn, "y", "long").orderBy("x").collect()
    assert [r["y"] for r in got] == [0, 2, 4, None, 8] and got[3]["error"] == "ValueError: three"
    slept = []
    clock = iter([0, 0, 0, 0.5, 1]).__next__
    lim = tasks.RateLimiter(1, 1, clock, slept.append)
    lim.acquire()
    lim.acquire()
    assert slept == [1.0]
    state = {"n": 0}

    def flaky():
        state["n"] += 1
        if state["n"] < 3:
            raise TimeoutError
        return "ok"

    assert tasks.retry_transient(flaky, (TimeoutError,), sleep=lambda s: None) == "ok"
    assert tasks.memo_key({"a": 1, "b": [1, 2]}) == tasks.memo_key({"b": (1, 2), "a": 1}) and tasks.memo_key(1) != tasks.memo_key("1") != tasks.memo_key(True)
    with pytest.raises(tasks.NotMemoKeyable):
        tasks.memo_key(object())


def plain(x):
    """Says nothing."""
    return x + 1  # a comment


def test_logic_fingerprint():
    assert tasks.logic_fingerprint(plain) == tasks.logic_fingerprint(plain) != tasks.logic_fingerprint(plain, deps=("x",))
    assert tasks.logic_fingerprint(plain, version="1") != tasks.logic_fingerprint(plain, version="2")
