from datetime import datetime

import pytest

from trawl.operators.snapshots import SnapshotIndex, snapshot_changes

SCHEMA = "n int, path string, size long, modified long, at timestamp, __key string, change string"
T = [datetime(2026, 1, d) for d in range(1, 9)]


def changes(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)  # columns whose names clash
    return sorted(map(tuple, snapshot_changes(df, "n", ["path"], ["size", "modified"], "at", **k).collect()), key=repr)


def test_added_removed_changed(spark):
    rows = [(1, "a", 1, 1, T[0]), (1, "b", 1, 1, T[0]), (1, "c", None, 1, T[0]), (2, "b", 2, 1, T[1]), (2, "c", None, 1, T[1]), (2, "d", 1, 1, T[1])]
    assert changes(spark, rows) == [(2, "a", "removed"), (2, "b", "changed"), (2, "d", "added")]


def test_last_received_holds_and_late_rows_count(spark):
    rows = [(1, "a", 1, 1, T[0]), (1, "a", 2, 1, T[5]), (2, "a", 2, 1, T[2]), (2, "a", 9, 1, T[1]), (2, "a", 2, 1, T[2])]
    assert changes(spark, rows) == []


def test_nulls_swap_places(spark):
    assert changes(spark, [(1, "a", None, 5, T[0]), (2, "a", 5, None, T[1])]) == [(2, "a", "changed")]


def test_null_and_empty_keys_are_keys(spark):
    rows = [(1, None, 1, 1, T[0]), (1, "", 1, 1, T[0]), (2, None, 2, 1, T[1]), (2, "", 1, 1, T[1]), (None, "z", 1, 1, T[0])]
    assert changes(spark, rows) == [(2, None, "changed")]


def test_gaps_between_numbers_and_values(spark):
    rows = [(3, "a", 1, 1, T[0]), (7, "a", 2, 1, T[1]), (9, "b", 1, 1, T[2])]
    got = changes(spark, rows, fetch_old=True)
    assert got == [(7, "a", "changed", 1, 1, 2, 1), (9, "a", "removed", 2, 1, None, None), (9, "b", "added", None, None, 1, 1)]


def test_empty_and_single(spark):
    assert changes(spark, []) == [] and changes(spark, [(1, "a", 1, 1, T[0])]) == []
    assert changes(spark, [], fetch_old=True) == []


def test_hot_key(spark):
    rows = [(n, "hot", i % 5, 1, T[i % 8]) for n in (1, 2) for i in range(300)] + [(2, "hot", 77, 1, datetime(2027, 1, 1))]
    assert changes(spark, rows) == [(2, "hot", "changed")]


def test_index_needs_a_first_snapshot(spark):
    df = spark.createDataFrame([("a", 1)], "path string, size long")
    index = SnapshotIndex(spark, ["path"], ["size"])
    for call in (index.probe, index.swap):
        with pytest.raises(ValueError):
            call()
    index.stage(df)
    with pytest.raises(ValueError):
        index.probe()
    index.close()


def test_no_side_is_shuffled(spark, monkeypatch):
    from trawl.operators import snapshots

    df = spark.createDataFrame([(f"p{i}", i) for i in range(50)], "path string, size long")
    index = SnapshotIndex(spark, ["path"], ["size"], buckets=4)
    index.stage(df)
    index.swap()
    index.stage(df.withColumn("size", df["size"] + (df["size"] % 10 == 0).cast("int")))
    plans = []
    monkeypatch.setattr(snapshots, "materialize", lambda d, name: plans.append(d) or d)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert index.probe().count() == 5
        plan = plans[0]._jdf.queryExecution().toString().split("Physical Plan")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "size" not in plan.split("ReadSchema")[1].split("\n")[0]
    index.close()


def test_buckets_follow_the_rows(spark, monkeypatch):
    from trawl.operators import snapshots

    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 100)
    monkeypatch.setattr(snapshots, "partitions", lambda s: 2)
    index = SnapshotIndex(spark, ["path"], ["size"])
    assert index._buckets(50) == 2 and index._buckets(5000) == 50
    index.current = {"buckets": 8}
    assert index._buckets(3000) == 8 and index._buckets(5000) == 50 and index._buckets(50) == 8 and index._buckets(100_000) == 1000


def test_an_index_is_kept_across_runs(spark, tmp_path):
    import os

    folder = f"file://{tmp_path}/index"
    first = [(1, "a", 1, 1, T[0]), (1, "b", 1, 1, T[0]), (2, "a", 2, 1, T[1]), (2, "b", 1, 1, T[1])]
    assert changes(spark, first, folder=folder) == [(2, "a", "changed")]
    # the second delivery's own rows are gone; the index has them
    assert changes(spark, [(3, "b", 1, 1, T[2]), (3, "c", 1, 1, T[2])], folder=folder, fetch_old=True) == [(3, "a", "removed", 2, 1, None, None), (3, "c", "added", None, None, 1, 1)]
    assert changes(spark, first, folder=folder) == []
    again = SnapshotIndex(spark, ["path"], ["size", "modified"], folder)
    assert again.snapshot == 3 and again._table(again.current).count() == 2
    assert sum(x.startswith("rows-") for x in os.listdir(f"{tmp_path}/index")) == 1
    with pytest.raises(ValueError):
        SnapshotIndex(spark, ["path"], ["size"], folder)
