import json

import pytest
from pyspark.sql import functions as F

from freshet import cli, records
from freshet.functions import models
from freshet.operators import tasks
from freshet.sources import custom
from freshet.streaming.component import LiveComponent, Progress, certified_apply
from freshet.targets.lake import LakeTable


def test_custom_sources(spark, tmp_path):
    shards = lambda options: list(range(int(options["shards"])))
    pages = lambda options, shard: iter([[(shard, f"{shard}-a")], [(shard, f"{shard}-b")]])
    end = lambda options: 25
    changes = lambda options, a, b: ((i, "x" * (i % 3)) for i in range(a, b))
    spark.dataSource.register(custom.paged_source("paged_test", "shard int, name string", shards, pages))
    assert sorted(r["name"] for r in spark.read.format("paged_test").option("shards", 3).load().collect()) == ["0-a", "0-b", "1-a", "1-b", "2-a", "2-b"]
    spark.dataSource.register(custom.change_log_source("log_test", "ordinal int, value string", end, changes))
    q = spark.readStream.format("log_test").option("perTask", 10).load().writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("log_rows").count() == 25
    page = json.dumps({"changes": [{"changeType": "file", "fileId": "f", "file": {"name": "n", "trashed": True}}, {"changeType": "drive", "driveId": "d"}], "nextPageToken": "p"})
    got, nxt, start = custom.parse_change_page(page)
    assert got[0]["removed"] and not got[1]["removed"] and nxt == "p" and start is None
    with pytest.raises(ValueError):
        custom.parse_change_page('{"changes": [{"changeType": "other"}]}')
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "file string")
    assert {r["file"]: r["kind"] for r in custom.classify_removals(f("a", "b", "c"), f("a", "b"), f("b")).collect()} == {"a": "deleted", "b": "moved", "c": "ignored"}
    assert custom.needs_scan(None, "1") and not custom.needs_scan("1", "1")


def test_live_component(spark, tmp_path):
    target = LakeTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v string").schema, ["k"])
    data = {1: "a", 2: "b"}
    live = LiveComponent(spark, target, lambda: spark.createDataFrame(list(data.items()), "k int, v string"))
    assert live.update_full() == {"create": 2} and live.ready.is_set() and live.update_full() == {}
    live.update(1, "x")
    live.update(1, "y")
    live.delete(2)
    assert live.flush() == 2 and live.superseded == 1 and live.flush() == 0
    assert [tuple(r) for r in target.read().collect()] == [(1, "y")]
    proof = certified_apply(target, spark.createDataFrame([(1, None, "delete"), (5, "n", "insert")], "k int, v string, action string"))
    assert all(r["proven"] for r in proof.collect())
    assert Progress().batches == 0


def test_models(spark):
    df = spark.createDataFrame([("abc",), ("abc",), (None,)], "t string")
    v = [r[0] for r in df.select(models.embed(F.col("t"), lambda: models.HashEmbedder(16))).collect()]
    assert v[0] == v[1] and len(v[2]) == 16
    answers = iter(["nonsense", "a"])
    assert models.PairResolver(lambda n, c: next(answers))("x", ["a"]).matched == "a"
    assert models.PairResolver(lambda n, c: "nonsense")("x", ["a"]).matched is None
    got = models.call_model(df.where("t is not null"), "t", lambda xs: [x.upper() for x in xs]).collect()
    assert [r["result"] for r in got] == ["ABC", "ABC"]
    assert models.nul_free(spark.createDataFrame([("a\0b", 1)], "t string, n int")).first()["t"] == "ab"
    assert sorted(r for _, r, _ in tasks.map_stream(spark.range(4), "id", lambda xs: [str(x) for x in xs])) == ["0", "1", "2", "3"]


def test_records(tmp_path):
    for store in (records.StateStore(), records.FileStateStore(str(tmp_path / "s")), records.SealedStateStore(records.StateStore(), lambda b: b[::-1], lambda b: b[::-1])):
        store.put("a/b", b"xy")
        assert store.get("a/b") == b"xy" and store.names() == ["a/b"] and store.get("no") is None
        store.delete("a/b")
        assert store.names() == []
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text("x = 1")
    locked = records.package(str(tmp_path / "p"), str(tmp_path / "p.tar"))
    assert records.verify_package(str(tmp_path / "p.tar"), locked)
    (tmp_path / "p/a.py").write_text("x = 2")
    assert records.lock(str(tmp_path / "p"))["digest"] != locked["digest"]
    a, b = records.Provenance({"i": "1"}, "l", {}), records.Provenance({"i": "2"}, "l", {})
    assert a.digest != b.digest and a.differences(b) == ["inputs"]


APP = {}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from freshet.app import App

    target = LakeTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v string").schema, ["k"])
    APP["app"] = App(spark, "a", str(tmp_path / "led"), lambda s: {"t": s.createDataFrame([(1, "a")], "k int, v string")}, {"t": target})
    monkeypatch.setattr(cli, "load", lambda s, name: APP[name])
    said = lambda *a: (cli.main(list(a), spark), json.loads(capsys.readouterr().out.splitlines()[-1]))[1]
    assert said("plan", "app") == {"t": {"insert": 1}} and said("diff", "app")["action"] == "insert"
    assert said("update", "app") == {"t": {"insert": 1}} and said("show", "app") == {"t": 1}
    assert said("ls", str(tmp_path / "led/a"))["version"] > 0 and said("doctor")["rows"] == 3
    assert said("drop", "app") == {"dropped": "a"}


def test_every_query_has_a_name_and_most_have_sql():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60 and len(sql) > 55


def test_graph_queries_cover_whole_tables(spark, tmp_path):
    from freshet.plans import catalog

    orders, lines = [(i, 40 + i % 30) for i in range(60)], [(i, (i * k) % 35 + 1) for i in range(60) for k in (1, 3, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 40)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
    customer = dict(orders)
    assert run("graph_edges_distinct_all") == sorted({(customer[o], p) for o, p in lines})
    assert run("graph_hop2_recommend_all") == sorted({(p, q) for o, p in lines for u, q in lines if o == u and p != q})


def test_audit_quarantine_and_cases_are_tables(spark, tmp_path):
    from freshet.operators import cases

    log = cases.AuditTable(spark, str(tmp_path / "audit"))
    at = F.lit("2024-01-01").cast("timestamp")
    one = lambda n: spark.range(n).select(F.lit("run").alias("kind"), at.alias("at"), F.create_map(F.lit("token"), F.lit("x"), F.lit("rows"), F.col("id").cast("string")).alias("details"))
    assert log.verify() and log.append(one(3)) == 1 and log.append(one(2)) == 2 and log.append(one(0)) == 2 and log.verify()
    assert {r["details"]["token"] for r in log.events().collect()} == {"[REDACTED]"} and log.events().count() == 5
    log._ledger.commit(add={"events": log.events().limit(1)})  # an event that nobody appended
    assert not log.verify()
    q = cases.QuarantineTable(spark, str(tmp_path / "q"))
    rows = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "x int, y string")
    q.add(rows, "odd")
    q.add(rows, "again")
    assert sorted((r["item"], r["reason"], r["status"]) for r in q.items().collect()) == [('{"x":1,"y":"a"}', "odd", "open"), ('{"x":2,"y":null}', "odd", "open")]
    first = q.items("open").orderBy("item").limit(1).select("id").collect()
    ids = spark.createDataFrame([*first, ("unknown",)], "id string")
    assert [tuple(r) for r in q.release(ids).collect()] == [("unknown", None)] and q.items("released").count() == 1
    assert sorted((r["id"] == "unknown", r["status"]) for r in q.discard(ids).collect()) == [(False, "released"), (True, None)]
    c = cases.CaseTable(spark, str(tmp_path / "c"))
    c.open(spark.createDataFrame([("c", "s", ["t", "u"]), ("d", "s", None)], "case_id string, source string, expected array<string>"))
    ask = lambda *pairs: c.advance(spark.createDataFrame(list(pairs), "case_id string, to string"))
    for stage in ("suppressing", "suppressed", "deleting", "deleted", "verifying"):
        assert ask(("c", stage)) == []
    assert ask(("c", "verified"), ("d", "verified"), ("e", "received")) == [("c", "targets without a receipt: t, u"), ("d", "received cannot become verified"), ("e", "unknown case")]
    c.receive(spark.createDataFrame([("c", "t", "p"), ("c", "u", "p"), ("x", "t", "p")], "case_id string, target string, proof string"))
    assert ask(("c", "verified"), ("d", "rejected")) == [] and {r["case_id"]: r["stage"] for r in c.cases().collect()} == {"c": "verified", "d": "rejected"}


def test_hash_embedder_is_the_loop_over_runs_of_characters():
    import zlib

    import numpy as np

    texts = ["", None, "a", "Plain text, twice: plain text", "é€𝄞 naïve — 漢字かな", "x" * 500]
    for dimension, n in ((16, 3), (32, 2)):
        for t, got in zip(texts, models.HashEmbedder(dimension, n, normalize=False).embed(texts), strict=True):
            want, padded = np.zeros(dimension), f" {(t or '').lower()} "
            for i in range(max(0, len(padded) - n + 1)):
                h = zlib.crc32(padded[i : i + n].encode())
                want[h % dimension] += 1 if h & 0x80000000 else -1
            assert got == want.tolist()


def test_two_hops_take_more_parts_when_pairs_grow(spark, monkeypatch):
    from freshet.operators import graph

    edges = spark.createDataFrame([(p, o) for o in range(30) for p in range(o % 4, 12, 4)], "from_id int, to_id int")
    starts = spark.range(12).select(F.col("id").cast("int").alias("start"))
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 10)
    got = graph.two_hop(edges, starts)
    assert got.rdd.getNumPartitions() > 4
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in range(12) for b in range(12) if a != b and a % 4 == b % 4}
