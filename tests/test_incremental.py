"""What an index does as its locations change: renames, outages, exclusions, interruptions, events."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trawl.engine import Engine, Settings, embedding_batches
from trawl.request import Request
from trawl.store import Conflict, Replace, Store
from trawl.streaming import changes


def letters(texts):
    return [[float(t.lower().count(c)) + 0.01 for c in "aeio"] for t in texts]


def folder(tmp_path, **files):
    root = tmp_path / "corpus"
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_txt", ".txt").replace("_md", ".md")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def files_of(e):
    return {r["name"]: r for r in e.store.read("files").collect()}


def test_moved_unchanged_and_excluded_files(spark, tmp_path):
    root = folder(tmp_path, a_txt="apples and pears", b_txt="bananas", sub__c_txt="cherries", old__d_txt="dates")
    e = Engine(spark, str(tmp_path / "index"), letters)
    e.update_settings(dimensions=4)
    r = e.add_root(str(root))
    e.start_index()
    before, chunks = files_of(e), {(c["file_id"], c["hash"]): c["id"] for c in e.store.read("chunks").collect()}
    os.rename(root / "a.txt", root / "sub" / "moved.txt")
    os.rename(root / "b.txt", root / "b.md")
    os.utime(root / "sub" / "c.txt", (1, 1))  # touched, not changed
    e.store.commit(roots=e.roots_table().withColumn("exclusions", F.lit('["old"]')))
    os.mkdir(root / "locked")
    os.chmod(root / "locked", 0)
    result = e.scan(r)
    os.chmod(root / "locked", 0o700)
    assert result["renamed"] == 2 and result["excluded"] == 1 and result["changed"] == 1
    after = files_of(e)
    assert set(after) == {"moved.txt", "b.md", "c.txt"}
    assert after["moved.txt"]["id"] == before["a.txt"]["id"] and after["moved.txt"]["state"] == "indexed" and after["moved.txt"]["path"].endswith("sub/moved.txt")
    assert after["b.md"]["id"] == before["b.txt"]["id"] and after["b.md"]["extension"] == "md"
    assert e.store.read("chunks").where(F.col("file_id") == before["d.txt"]["id"]).count() == 0
    kept = {(c["file_id"], c["hash"]): c["id"] for c in e.store.read("chunks").collect()}
    assert e.index() == 1 and files_of(e)["c.txt"]["state"] == "indexed"
    # the same content: its chunks weren't made again
    assert {(c["file_id"], c["hash"]): c["id"] for c in e.store.read("chunks").collect()} == kept and set(kept.items()) <= set(chunks.items())
    assert e.search(Request("pears", "exact")).first()["name"] == "moved.txt"
    # away and back
    os.rename(root, str(root) + "-away")
    assert e.scan(r) == {} and not e.roots_table().first()["online"]
    os.rename(str(root) + "-away", root)
    assert e.idle() == [r] and e.roots_table().first()["online"] and all(f["online"] for f in files_of(e).values())
    assert e.search(Request('"apples and"', "exact")).first()["lexical"] > 0.2


def test_edits_while_reading_pauses_and_models(spark, tmp_path, monkeypatch):
    from trawl import engine

    root = folder(tmp_path, a_txt="first text", b_txt="second text")
    e = Engine(spark, str(tmp_path / "index"))
    r = e.add_root(str(root))
    e.scan(r)
    real = engine.extract

    def slow(df):
        (root / "a.txt").write_text("changed while it was read, and longer")
        return real(df)

    monkeypatch.setattr(engine, "extract", slow)
    assert e._index_some(10) == (1, 1)
    monkeypatch.setattr(engine, "extract", real)
    assert files_of(e)["a.txt"]["state"] == "queued" and files_of(e)["b.txt"]["error"].startswith("Semantic model unavailable")
    e.control("pause")
    assert e.index() == 0
    e.control("stop")
    again = Engine(spark, str(tmp_path / "index"), letters)
    assert again.stopped() and again.index() == 0
    heard = []
    again.control("resume")
    again.update_settings(dimensions=4)
    again.recover()
    assert again.index(batch=1, progress=lambda done, left: heard.append((done, left))) == 2 and heard == [(1, 1), (2, 0)]
    assert {f["state"] for f in files_of(again).values()} == {"indexed"}
    assert again.search(Request("longer", "exact")).count() == 1 and not again.stopped()
    phases = list(again.search_in_phases(Request("second")))
    assert len(phases) == 2 and phases[1].where("semantic > 0").count() > 0
    assert again.storage_info()["chunks"] > 0 and set(again.benchmark(batches=(1, 4))) == {"status", "embed_1", "embed_4"}
    with pytest.raises(ValueError):
        again.control("halt")
    # the vector index: made once, kept by commits, read by cells
    assert again.index_vectors() and not again.index_vectors()
    (root / "c.txt").write_text("another one")
    os.remove(root / "b.txt")
    again.start_index()
    assert again.store.read("cells").count() == again.status().first()["vectors"] == 2 and not again.index_vectors()
    exact = [tuple(r) for r in again.search(Request("another")).collect()]
    again.update_settings(probes=50)
    assert [tuple(r) for r in again.search(Request("another")).collect()] == exact
    again.update_settings(dimensions=3)
    assert again.store.read("cells").count() == 0


def test_events_are_taken_in(spark, tmp_path, monkeypatch):
    root = folder(tmp_path, a_txt="alpha", sub__b_txt="beta", sub__c_txt="gamma")
    e = Engine(spark, str(tmp_path / "index"))
    e.add_root(str(root))
    e.start_index()
    (root / "a.txt").write_text("alpha is now omega, and longer")
    (root / "new.txt").write_text("delta")
    (root / ".env").write_text("SECRET")
    for f in ("b.txt", "c.txt"):
        os.remove(root / "sub" / f)
    os.rmdir(root / "sub")
    rows = [(str(root / p), k) for p, k in (("a.txt", "modify"), ("a.txt", "modify"), ("new.txt", "create"), (".env", "create"), ("sub", "remove"), ("sub/b.txt", "remove"), ("b.txt", "access"))]
    spark.createDataFrame(rows, "path string, kind string").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("path string, kind string").parquet(str(tmp_path / "events"))
    e.watch(stream, str(tmp_path / "log")).awaitTermination()
    assert set(files_of(e)) == {"a.txt", "new.txt"}
    assert e.search(Request("omega", "exact")).count() == 1 and e.search(Request("beta", "exact")).count() == 0
    # too many at once: locations are scanned instead
    (root / "later.txt").write_text("later")
    monkeypatch.setattr(changes, "overflowed", lambda n: n > 1)
    e.changed(spark.createDataFrame([("/x", False), ("/y", False)], "path string, recursive boolean"))
    assert "later.txt" in files_of(e)


def test_commits_touch_only_their_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    make = lambda ids, text: spark.createDataFrame([(i, i, text) for i in ids], "id long, file_id long, text string").selectExpr(
        "id", "file_id", "0 seq", "'text' modality", "text", "'' heading", "null page", "1 line_start", "1 line_end", "null start_sec", "null end_sec", "'h' hash", "null vector", "'general' namespace"
    )
    s.commit(chunks=make(range(100), "old"))
    first = s.manifest()["chunks"]["of"]
    s.commit(chunks=Replace(spark.createDataFrame([(7,), (8,)], "file_id long"), make([8, 200], "new")))
    second = s.manifest()["chunks"]["of"]
    assert sum(first.get(b) != second.get(b) for b in {*first, *second}) <= 3 < len(first)
    got = {r["file_id"]: r["text"] for r in s.read("chunks").collect()}
    assert 7 not in got and got[8] == got[200] == "new" and len(got) == 100 and sum(t == "old" for t in got.values()) == 98
    # two writers that began together
    other = Store(spark, str(tmp_path / "store"))
    real = other.version
    other.version = lambda: real() - 1
    with pytest.raises(Conflict):
        other.commit(settings=spark.createDataFrame([("a", "1")], "key string, value string"))
    assert s.read("settings").count() == 0 and s.sizes()["unused"] > 0
    s.compact()
    s.vacuum()
    assert s.read("chunks").count() == 100 and s.sizes()["unused"] < 10_000


def test_embedding_batches():
    assert list(embedding_batches(["a"] * 5, 4)) == [[0, 1, 2, 3], [4]] and list(embedding_batches([], 4)) == []
    assert list(embedding_batches(["a", "b" * 1300, "c" * 200, "d" * 1199], 4)) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        Settings(embed_batch=0)


def test_folders_are_walked_in_rounds(spark, tmp_path, monkeypatch):
    from trawl.sources import scan

    for i in range(4):
        for j in range(5):
            d = tmp_path / "deep" / f"d{i}" / f"e{j}"
            d.mkdir(parents=True)
            for k in range(3):
                (d / f"f{k}.txt").write_text("x")
    monkeypatch.setattr(scan, "LISTED", 4)
    start = time.time()
    got = scan.scan_local(spark, str(tmp_path / "deep")).collect()
    assert len(got) == len({r["path"] for r in got}) == 60 and all(r["stable_id"] for r in got) and time.time() - start < 60
