import numpy as np
from pyspark.sql import functions as F

from freshet.functions import vectors
from freshet.operators import entity, graph
from freshet.sources import files, topics
from freshet.streaming import live
from freshet.targets.lake import LakeTable


def test_topics(spark):
    m = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("b", "1", 2), ("b", None, 4), (None, "x", 5), ("c", "bye", 6)], "key string, value string, offset long")
    assert sorted(map(tuple, topics.topic_as_map(m, F.col("value") == "bye").collect())) == [("a", "2")]
    done = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (1, 7)], "partition int, offset long")
    assert {r["partition"]: r["next_offset"] for r in topics.committed_frontier(done).collect()} == {0: 3, 1: 8}
    c = spark.createDataFrame([("f", "x", 1, False, 5, "n"), ("f", "x", 4, True, None, "n"), ("f", "y", 2, False, 3, "n"), ("g", "x", 1, True, None, "n")], "file string, corpus string, ordinal long, removed boolean, version long, name string")
    got = {r["file"]: (r["corpus"], r["ordinal"], r["removed"]) for r in topics.coalesce_changes(c).collect()}
    assert got == {"f": ("y", 2, True), "g": ("x", 1, True)}


def test_stream_into_table(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1, "upsert"), (1, "b", 2, "upsert"), (2, "c", 3, "upsert")], "k int, v string, seq long, op string").write.parquet(str(source))
    target = LakeTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v string").schema, ["k"])
    run = lambda: live.upsert_stream(spark.readStream.schema("k int, v string, seq long, op string").parquet(str(source)), target, ["seq"], str(tmp_path / "cp")).awaitTermination(120)
    assert run()
    assert sorted(map(tuple, target.read().collect())) == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, None, 4, "delete"), (3, "d", 5, "upsert")], "k int, v string, seq long, op string").write.mode("append").parquet(str(source))
    assert run()
    assert sorted(map(tuple, target.read().collect())) == [(1, "b"), (3, "d")]


def test_state_outlives_batches(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.parquet(str(source))
    q = live.running_counts(spark.readStream.schema("k string").parquet(str(source)), "k").writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == [("a", 2), ("b", 1)]


def test_refresher():
    n = []

    def fn():
        n.append(1)
        if len(n) == 2:
            raise ValueError

    errors = []
    r = live.Refresher(fn, 0.01, errors.append).start()
    while len(n) < 4:
        pass
    r.stop()
    assert len(errors) == 1 and r.runs >= 3


def test_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "x.txt").write_text("one")
    (tmp_path / "a/b/y.txt").write_text("two")
    got = files.texts(files.walk(spark, str(tmp_path), recursive=True)).select("key", "text", "size").collect()
    assert sorted(map(tuple, got)) == [("a/b/y.txt", "two", 3), ("x.txt", "one", 3)]
    p = spark.createDataFrame([("a/b.tar.gz",), ("c",)], "p string")
    assert [tuple(r) for r in p.select(files.name(F.col("p")), files.stem(F.col("p")), files.suffix(F.col("p")), files.parent(F.col("p"))).collect()] == [("b.tar.gz", "b.tar", ".gz", "a"), ("c", "c", "", "")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7]), (4, [0.0, 0.0]), (5, None)], "id int, embedding array<double>")
    assert [r["id"] for r in vectors.knn(df, [1.0, 0.1], 3).orderBy("rank").collect()] == [1, 3, 2]
    assert [r["id"] for r in vectors.knn(df, [1.0, 0.1], 1, by="ip").collect()] == [1]
    assert vectors.knn(df, [1.0, 0.0], 2, by="manhattan").count() == 2


def test_components_and_entities(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r["node"]: r["root"] for r in graph.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100
    rng = np.random.default_rng(0)
    base = rng.normal(size=(4, 32))
    rows = [(f"{'abcd'[g]}{i}", (base[g] + rng.normal(size=32) * 0.02).tolist()) for g in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "name string, embedding array<double>").withColumn("known", F.col("name") == "b2")
    out = {r["name"]: r["canonical"] for r in entity.resolve_entities(df, entity.first_candidate, existing="known").collect()}
    assert out == {f"{g}{i}": ("b2" if g == "b" else f"{g}0") for g in "abcd" for i in range(3)}
    brute = {(a, b) for a, x in rows for b, y in rows if a < b and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.7}
    assert {(r["a"], r["b"]) for r in entity.similar_pairs(df).collect()} == brute
    none = {r["name"]: r["parent"] for r in entity.resolve_entities(df, lambda n, c: entity.Resolution(None)).collect()}
    assert set(none.values()) == {None}


def test_fusion_is_exact(spark):
    import random

    rng = random.Random(2)
    rows = [(i, float(rng.randrange(400)), float(rng.randrange(5))) for i in range(900)]
    a = {k: n + 1 for n, (k, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    b = {k: n + 1 for n, (k, *_) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    want = sorted(((k, 1 / (60 + a[k]) + 1 / (60 + b[k])) for k in a), key=lambda s: (-s[1], s[0]))[:10]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = [tuple(r) for r in vectors.fused_top_k(df, "id", [F.col("x"), F.col("y")]).collect()]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert vectors.fused_top_k(df.limit(0), "id", [F.col("x"), F.col("y")]).count() == 0
