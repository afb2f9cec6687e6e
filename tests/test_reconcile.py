from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from freshet.operators import reconcile


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_truth_table(spark):
    desired = spark.createDataFrame([("new", "a"), ("same", "a"), ("differs", "a"), ("two", "a"), ("maybe", "a"), ("gone_maybe", "a")], "k string, fp string")
    previous = spark.createDataFrame(
        [("same", "a", False), ("differs", "b", False), ("two", "a", False), ("two", "b", False), ("maybe", "a", True), ("old", "z", False), ("gone_maybe", None, True)], "k string, fp string, may_be_missing boolean"
    )
    got = dict(rows(reconcile.diff(desired, previous, ["k"]), "k", "action"))
    assert got == {"new": "insert", "same": "none", "differs": "replace", "two": "replace", "maybe": "upsert", "old": "delete", "gone_maybe": "insert"}
    assert dict(rows(reconcile.diff(desired, previous, ["k"], full_reprocess=True), "k", "action"))["same"] == "upsert"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.dictionaries(st.integers(0, 12), st.integers(0, 3)), b=st.dictionaries(st.integers(0, 12), st.integers(0, 3)))
def test_applying_a_difference_gives_the_desired_table(spark, a, b):
    frame = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    actions = reconcile.diff_tables(frame(b), frame(a), ["k"], ["v"])
    assert rows(reconcile.apply_actions(frame(a), actions, ["k"], ["v"]), "k", "v") == sorted(b.items())
    quiet = reconcile.diff_tables(frame(b), frame(b), ["k"], ["v"])
    assert {r["action"] for r in quiet.collect()} <= {"unchanged"}


def test_parts_of_a_record(spark):
    main = spark.createDataFrame([(1, "none", 1, False), (2, "replace", 1, False), (3, "delete", 1, False)], "k int, action string, candidates int, missing boolean")
    want = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x")], "k int, sub string, fp string")
    had = spark.createDataFrame([(1, "a", "x"), (1, "c", "x"), (2, "a", "x"), (3, "a", "x")], "k int, sub string, fp string")
    got = rows(reconcile.diff_composite(main, want, had, ["k"], "sub"), "k", "sub", "action")
    assert got == [(1, "a", "none"), (1, "b", "insert"), (1, "c", "delete"), (2, "a", "upsert")]


def test_users_own_what_they_manage(spark):
    d = spark.createDataFrame([(1, "system"), (2, "user")], "k int, managed_by string")
    p = spark.createDataFrame([(1, "system"), (2, "system"), (3, "user"), (4, "system")], "k int, managed_by string")
    want, had = reconcile.system_managed(d, p, ["k"])
    assert rows(want, "k") == [(1,)] and rows(had, "k") == [(1,), (4,)]


def test_a_key_moves_between_owners_without_a_delete(spark):
    ledger = spark.createDataFrame([(1, "a"), (2, "a")], "k int, owner string")
    declared = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "b", 1)], "k int, owner string, seq int")
    assert rows(reconcile.transfer_ownership(ledger, declared, ["k"]), "k", "owner", "transferred") == [(1, "b", True), (2, "a", False), (3, "b", False)]
    assert rows(reconcile.orphans(ledger, spark.createDataFrame([("b",)], "owner string")), "k") == [(1,), (2,)]
