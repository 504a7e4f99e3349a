"""Tables of an index in a folder: each commit is complete or not there at all, and rewrites only what it touches."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import read_json, remove

SCHEMAS = {
    "roots": "id long, path string, online boolean, exclusions string",
    "files": "id long, root_id long, path string, name string, extension string, kind string, size long, modified long, created long, state string, "
    "semantic boolean, error string, online boolean, content_hash string, seen long, stable_id string, last_indexed long, mtime_ns long",
    "chunks": "id long, file_id long, seq int, modality string, text string, heading string, page int, line_start int, line_end int, "
    "start_sec double, end_sec double, hash string, vector array<float>, namespace string",
    "jobs": "file_id long, state string, priority int, kind string, online boolean",
    "activity": "id long, logged long, kind string, file_id long, path string, message string",
    "settings": "key string, value string",
    "postings": "term string, id long, file_id long, tf long",
    "lengths": "id long, file_id long, d double",
    "pivots": "namespace string, cell int, vector array<float>",
    "cells": "cell int, id long, file_id long, namespace string, vector array<float>",
}
#: Tables kept in buckets of files: what a bucket's rows are sorted by.
BUCKETED = {"chunks": ("file_id", "seq"), "postings": ("term", "id"), "lengths": ("id",), "cells": ("cell", "id")}
BUCKETS = 16
#: Bytes that a bucket is meant to hold after :meth:`Store.compact`.
BUCKET_BYTES = 256 << 20


class Conflict(RuntimeError):
    """Another commit was made since the tables were read."""


@dataclass(frozen=True)
class Replace:
    """Of a bucketed table the rows of the files in ``gone`` (``file_id``) go, and ``rows`` come."""

    gone: DataFrame
    rows: DataFrame




class Store:
    """Numbered manifests name the folders of each table; a commit writes new folders, then the next manifest.

    Readers keep what they began with, as folders are never written twice. Of two commits that began with the same
    manifest the second to end is refused (:class:`Conflict`) and changes nothing. ``vacuum`` drops what the last
    manifest doesn't name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The number of the last manifest; 0 before the first commit."""
        if not self._fs.exists(self._at("")):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        return max((int(n.removeprefix("_manifest-")) for n in names if n.startswith("_manifest-") and n.removeprefix("_manifest-").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return read_json(self.spark, f"{self.path}/_manifest-{version:012d}") or {}

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        at = (self.manifest() if manifest is None else manifest).get(table)
        paths = [] if at is None else [at["all"]] if "all" in at else [p for b, p in at["of"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.path}/{p}" for p in paths])

    def commit(self, **tables: DataFrame | Replace) -> None:
        """Replace tables or their files' rows, all at once. What is read from the store while it is written stays as it was."""
        version = self.version()
        manifest = self.manifest(version)
        for name, made in tables.items():
            if name not in BUCKETED:
                folder = f"{name}-{uuid.uuid4().hex}"
                self._shaped(name, made).write.parquet(f"{self.path}/{folder}")
                manifest[name] = {"all": folder}
            elif isinstance(made, Replace):
                manifest[name] = self._replaced(name, made, manifest)
            else:
                manifest[name] = {"buckets": BUCKETS, "of": self._write(name, made, BUCKETS)}
        self._publish(version + 1, manifest)

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        columns = [x.split(" ", 1) for x in SCHEMAS[name].split(", ")]
        return df.select(*[df[c].cast(t).alias(c) for c, t in columns])

    def _bucket(self, n: int):
        return F.pmod(F.hash("file_id"), F.lit(n)).alias("__b")

    def _write(self, name: str, df: DataFrame, n: int) -> dict[str, str]:
        """Rows by bucket, each in its own folder; the folders of the buckets that have rows."""
        folder = f"{name}-{uuid.uuid4().hex}"
        placed = self._shaped(name, df).withColumn("__b", self._bucket(n)).repartition("__b").sortWithinPartitions("__b", *BUCKETED[name])
        placed.write.partitionBy("__b").parquet(f"{self.path}/{folder}")
        found = [x.getPath().getName() for x in self._fs.listStatus(self._at(folder))]
        return {x.removeprefix("__b="): f"{folder}/{x}" for x in found if x.startswith("__b=")}

    def _replaced(self, name: str, made: Replace, manifest: dict) -> dict:
        held = manifest.get(name) or {"buckets": BUCKETS, "of": {}}
        n, gone = held["buckets"], made.gone.select("file_id").distinct()
        keys = gone.unionByName(made.rows.select("file_id").distinct())
        touched = [r[0] for r in keys.select(self._bucket(n)).distinct().collect()]  # at most the buckets
        kept = self.read(name, touched, manifest).join(keys.distinct(), "file_id", "left_anti")
        fresh = self._write(name, self._shaped(name, kept).unionByName(self._shaped(name, made.rows)), n)
        return {"buckets": n, "of": {b: p for b, p in held["of"].items() if int(b) not in touched} | fresh}

    def _publish(self, version: int, manifest: dict) -> None:
        place, beside = self._at(f"_manifest-{version:012d}"), self._at(f"_next-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, place, options)  # fails where the place is taken
        except Exception as e:
            self._fs.delete(beside, False)
            if self._fs.exists(place):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise

    def sizes(self) -> dict[str, int]:
        """Bytes of each table, and of folders that no table uses any more (``unused``)."""
        of = lambda p: self._fs.getContentSummary(self._at(p)).getLength()
        manifest = self.manifest()
        out = {t: sum(of(p) for p in ([at["all"]] if "all" in at else at["of"].values())) for t, at in manifest.items()}
        out["unused"] = (of("") if self._fs.exists(self._at("")) else 0) - sum(out.values())
        return out

    def compact(self) -> None:
        """Every table in few files, bucketed ones in as many buckets as their bytes ask for."""
        version = self.version()
        manifest, sizes = self.manifest(version), self.sizes()
        for name in manifest:
            if name in BUCKETED:
                n = max(BUCKETS, -(-sizes[name] // BUCKET_BYTES))
                manifest[name] = {"buckets": n, "of": self._write(name, self.read(name, manifest=manifest), n)}
            else:
                folder = f"{name}-{uuid.uuid4().hex}"
                self.read(name, manifest=manifest).coalesce(max(1, -(-sizes[name] // BUCKET_BYTES))).write.parquet(f"{self.path}/{folder}")
                manifest[name] = {"all": folder}
        self._publish(version + 1, manifest)

    def vacuum(self) -> int:
        """Delete folders that the last manifest doesn't name, and older manifests; how many."""
        version = self.version()
        named, n = {f"_manifest-{version:012d}"}, 0
        for at in self.manifest(version).values():
            named |= {p.split("/")[0] for p in ([at["all"]] if "all" in at else at["of"].values())}
        for s in self._fs.listStatus(self._at("")):
            if s.getPath().getName() not in named:
                remove(self.spark, s.getPath().toString())
                n += 1
        return n

    def copy_to(self, path: str) -> Store:
        """The same tables in another folder, valid only if every row count agrees."""
        other = Store(self.spark, path)
        other.commit(**{t: self.read(t) for t in self.manifest()})
        for t in self.manifest():
            if self.read(t).count() != other.read(t).count():
                raise RuntimeError(f"{t} wasn't copied whole")
        return other
