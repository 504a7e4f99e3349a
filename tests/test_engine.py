import json
import os

import pytest

from trawl.cli import parser, query_text
from trawl.engine import Engine, Settings
from trawl.request import Request


def letters(texts):
    """A stand-in for an embedder: counts of four letters."""
    return [[float(t.lower().count(c)) + 0.01 for c in "aeio"] for t in texts]


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for name, text in {
        "notes.md": "# Storage\nMetadata and embeddings live in tables.", "ocean.txt": "A child throws a ball into the ocean.", "auth.rs": "/// token\npub fn connect_oauth() {}\n",
        "sub/.env": "SECRET=1", "sub/node_modules/x.js": "ignored()", "sub/report.txt": "quarterly report\n" * 3, "opaque.bin": "\x00\x01", "_draft.txt": "hidden names count",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_lifecycle(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    root = e.add_root(str(corpus))
    with pytest.raises(ValueError):
        e.add_root(str(corpus / "sub"))
    first = e.start_index()
    assert first == {"new": 6, "indexed": 6}
    names = {r["name"]: r["state"] for r in e.store.read("files").collect()}
    assert names == {"notes.md": "partial", "ocean.txt": "partial", "auth.rs": "partial", "report.txt": "partial", "opaque.bin": "metadata_only", "_draft.txt": "partial"}
    found = e.search(Request("report", "exact")).collect()
    assert found[0]["name"] == "report.txt" and found[0]["filename"] > 0.3 and found[0]["lexical"] > 0
    assert e.search(Request("embeddings ext:md")).first()["name"] == "notes.md"
    ids = {r["path"]: r["id"] for r in e.store.read("files").collect()}
    # an edit, a deletion and an addition
    (corpus / "notes.md").write_text("# Storage\nNow something else entirely, longer than before.")
    os.remove(corpus / "ocean.txt")
    (corpus / "new.txt").write_text("fresh")
    again = e.start_index(root)
    assert again == {"new": 1, "changed": 1, "gone": 1, "same": 4, "indexed": 2}
    after = {r["path"]: r["id"] for r in e.store.read("files").collect()}
    assert after[str(corpus / "notes.md")] == ids[str(corpus / "notes.md")] and str(corpus / "ocean.txt") not in after
    assert e.search(Request("entirely", "exact")).count() == 1 and e.search(Request("ocean", "exact")).count() == 0
    assert e.health().where("orphans > 0").count() == 0
    assert json.loads(e.export_diagnostics())["status"]["files"] == 6
    assert e.preview(after[str(corpus / "new.txt")]) == "fresh"
    assert e.compact() > 0 and e.status().first()["files"] == 6
    e.move_index(str(tmp_path / "moved"))
    assert e.roots().first()["files"] == 6
    os.rename(corpus, str(corpus) + "-away")
    assert e.scan(root) == {} and e.search(Request("fresh", "exact")).count() == 0
    assert e.search(Request("fresh", "exact", show_offline=True)).count() == 1
    e.remove_root(root)
    assert e.status().first()["files"] == 0 and e.activity().count() >= 4


def test_vectors(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), letters)
    e.update_settings(dimensions=4)
    e.add_root(str(corpus))
    e.start_index()
    assert {r["state"] for r in e.store.read("files").where("kind <> 'binary'").collect()} == {"indexed"}
    by_name = {r["name"]: r["id"] for r in e.store.read("files").collect()}
    like = e.search(Request("", "semantic"), like_file=by_name["ocean.txt"]).first()
    assert like["name"] == "ocean.txt" and like["cosine"] == 1.0
    assert e.search(Request("a child", "smart")).where("semantic > 0").count() > 0
    old = e.settings()
    e.update_settings(show_offline=True)
    assert e.status().first()["vectors"] > 0
    e.update_settings(dimensions=3)
    assert old.fingerprint() != e.settings().fingerprint() and e.status().first()["vectors"] == 0 and e.store.read("jobs").count() == 6
    assert e.index() == 6
    e.clear()
    assert e.status().first()["files"] == 0 and e.roots_table().count() == 1


def test_failed_commit_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    e = Engine(spark, str(tmp_path / "index"))
    e.add_root(str(tmp_path))
    before = e.store.manifest()
    broken = e.store.read("files").unionByName(spark.range(1).select(*[F.raise_error(F.lit("stop")).cast(t).alias(c) for c, t in e.store.read("files").dtypes]))
    with pytest.raises(Exception):
        e.store.commit(roots=e.roots_table().where("false"), files=broken)
    assert e.store.manifest() == before and e.roots_table().count() == 1


def test_settings_and_command_line():
    for bad in ({"results_count": 0}, {"audio_seconds": 5}, {"dimensions": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
    a = parser().parse_args(["idx", "search", "a", "b", "--folder", "C:/x", "--similar", "3"])
    assert query_text(a.query, a.folder) == 'a b path:"C:/x"' and a.similar == 3


def test_running_total(spark):
    from trawl.operators.upkeep import running_total

    df = spark.createDataFrame([(i, i * 7 % 50, None if i % 9 == 0 else i) for i in range(200)], "id long, o int, v long").repartition(7)
    got = {r["id"]: r["total"] for r in running_total(df, ["o", "id"], "v").collect()}
    total = 0
    for o, i in sorted((i * 7 % 50, i) for i in range(200)):
        total += 0 if i % 9 == 0 else i
        assert got[i] == total
