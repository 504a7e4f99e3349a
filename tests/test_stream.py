from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trawl.operators import status
from trawl.streaming import changes

T = datetime(2026, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(T + timedelta(milliseconds=ms), p, k) for ms, p, k in rows], "ts timestamp, path string, kind string")


def test_debounce_starts_anew_and_joins_flags(spark):
    df = events(spark, [(0, "a", "modify"), (400, "a", "create"), (800, "a", "modify"), (2000, "a", "modify"), (100, "b", "access"), (5, "c", None)])
    got = {(r["path"], r["events"], r["recursive"]) for r in changes.debounced(changes.intake(df)).collect()}
    assert got == {("a", 3, True), ("a", 1, False), ("c", 1, False)}


def test_batch_order_and_cover(spark):
    df = spark.createDataFrame([("/a/b/c", True, False), ("/a", False, True), ("/a/b", True, True), ("/x", True, False)], "path string, exists boolean, recursive boolean")
    assert [r["path"] for r in changes.next_batch(df, n=3).collect()] == ["/x", "/a/b", "/a/b/c"]
    assert sorted(r["path"] for r in changes.covered(df).collect()) == ["/a", "/x"]
    assert changes.overflowed(8193) and not changes.overflowed(8192)


def test_stream_closes_the_same_bursts(spark, tmp_path):
    df = events(spark, [(i * 1370 % 20000, f"p{i % 3}", "modify") for i in range(60)] + [(60_000, "z", "modify")])
    df.write.parquet(str(tmp_path / "in"))
    batch = changes.debounced(changes.intake(df)).where("path <> 'z'")
    stream = changes.intake(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = changes.run_to_table(spark, changes.debounced(stream, late="1 second"), "t").where("path <> 'z'")
    key = lambda d: sorted(map(str, d.select("path", "started", "last", "events").collect()))
    assert key(got) == key(batch) and got.count() > 3


def test_running_costs(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, kind string, seconds double")
    df = df.unionByName(spark.createDataFrame([(100 + i * 7919 % 12000, "c", float(i % 11)) for i in range(12000)], df.schema))  # out of order, in several frames
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = changes.running_costs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = {r["kind"]: (r["samples"], round(r["cost"], 9)) for r in changes.run_to_table(spark, stream, "c", "update").collect()}
    want = {r["kind"]: (r["samples"], round(r["cost"], 9)) for r in status.costs(df).collect()}
    assert got == want


def test_costs_by_hand_and_eta(spark):
    df = spark.createDataFrame([(1, "text", 2.0), (2, "text", 2.0), (3, "text", 2.0), (4, "pdf", 10.0)], "id long, kind string, seconds double")
    cost = status.costs(df)
    assert {r["kind"]: r["cost"] for r in cost.collect()} == {"text": pytest.approx(2.0), "pdf": 10.0}
    pending = spark.createDataFrame([("text", 3)], "kind string, pending long")
    assert tuple(status.index_eta(cost, pending).first()) == (pytest.approx(6.0), False)
    pending = spark.createDataFrame([("pdf", 2)], "kind string, pending long")
    assert tuple(status.index_eta(cost, pending).first()) == (pytest.approx(8.0), True)
    assert tuple(status.index_eta(cost, pending.where("false")).first()) == (0.0, False)
    few = status.costs(df.where("id < 3"))
    assert tuple(status.index_eta(few, pending).first()) == (None, True)
    assert status.discovery_eta(100, 200, 5.0) is None and status.discovery_eta(200, 400, 5.0) == 5.0
    one = df.where("id = 4").withColumn("seconds", F.lit(1.0))
    assert status.costs(one.where("false")).count() == 0


def test_many_samples(spark):
    rows = [(i, "k", float((i * 37) % 11)) for i in range(2000)]
    want = 0.0
    for i, _, s in rows:
        want = s if i == 0 else want * 0.8 + s * 0.2
    assert status.costs(spark.createDataFrame(rows, "id long, kind string, seconds double")).first()["cost"] == pytest.approx(want, abs=1e-12)


def test_apply_changes(spark, tmp_path):
    df = events(spark, [(0, "a", "modify")])
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        changes.apply_changes(stream, lambda b, n: seen.append((n, b.count())), str(tmp_path / "log")).awaitTermination()
    assert seen == [(0, 1)]
