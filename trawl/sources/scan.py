"""Folders and files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import extension, kind
from ..operators.filters import Exclusions, sensitive
from ..runtime import materialize, partitions

METADATA = "path string, name string, extension string, kind string, size long, modified long, created long, mtime_ns long, error string"


def metadata(path: Column, length: Column, modified: Column) -> list[Column]:
    name = F.regexp_extract(path, r"([^\\/]+)$", 1)
    return [
        path.alias("path"),
        name.alias("name"),
        extension(name).alias("extension"),
        kind(extension(name)).alias("kind"),
        length.alias("size"),
        F.unix_seconds(modified).alias("modified"),
        (F.unix_micros(modified) * 1000).alias("mtime_ns"),
    ]


def scan_files(spark: SparkSession, folder: str, exclusions: Exclusions | None = None, recursive: bool = True) -> DataFrame:
    """Metadata of the files below a folder of any file system Spark reads; contents aren't read.

    Names that begin with ``.`` or ``_`` are passed over by Spark; :func:`scan_local` sees them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    found = raw.select(*metadata(F.regexp_replace("path", r"^file:/*", "/"), F.col("length"), F.col("modificationTime")))
    return _kept(found, folder, exclusions)


def _kept(found: DataFrame, folder: str, exclusions: Exclusions | None) -> DataFrame:
    found = found.where(~sensitive(F.col("name")))
    return found.where(~exclusions.matches(F.col("path"), F.lit(folder.removeprefix("file:")))) if exclusions else found


#: Entries that a task lists before it hands the folders it hasn't entered to others.
LISTED = 20_000


def scan_local(spark: SparkSession, folder: str, exclusions: Exclusions | None = None, recursive: bool = True, sensitive_files: bool = False) -> DataFrame:
    """Metadata with creation time, hidden names and ``stable_id``, of a folder that every executor mounts.

    Tasks walk folders and leave what they don't get to for the next round, in which it is spread over all tasks
    again: rounds grow with the logarithm of the number of folders, whatever their shape. Links aren't followed;
    what can't be read is a row with ``error``, not a failure. Excluded folders are not entered. ``stable_id`` is the
    device and number of a file, which it keeps when it is renamed.
    """
    compiled = (exclusions.relative, exclusions.absolute) if exclusions else ("", "")

    def walk(batches):
        import os
        import re

        relative, absolute = (re.compile(x) if x else None for x in compiled)

        def out_of(path: str) -> bool:
            full = path.lower()
            below = full[len(folder.rstrip("/")) + 1 :]
            return bool(relative and relative.search(below) or absolute and absolute.search(full))

        for b in batches:
            rows, todo = [], list(b["start"])
            while todo:
                here = todo.pop()
                if here != folder and out_of(here):
                    continue
                if len(rows) > LISTED:
                    rows.append((here, None, None, None, None, None, None, None, True))
                    continue
                try:
                    entries = list(os.scandir(here))
                except OSError as e:
                    rows.append((here, os.path.basename(here), None, None, None, None, None, str(e), False))
                    continue
                for e in entries:
                    try:
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if recursive:
                                todo.append(e.path)
                        elif not out_of(e.path):
                            s = e.stat(follow_symlinks=False)
                            rows.append((e.path, e.name, s.st_size, int(s.st_mtime), int(s.st_ctime), s.st_mtime_ns, f"{s.st_dev}:{s.st_ino}", None, False))
                    except OSError as err:
                        rows.append((e.path, e.name, None, None, None, None, None, str(err), False))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "modified", "created", "mtime_ns", "stable_id", "error", "todo"])

    schema = "path string, name string, size long, modified long, created long, mtime_ns long, stable_id string, error string, todo boolean"
    found, todo = None, spark.createDataFrame([(folder,)], "start string")
    while True:
        made = materialize(todo.mapInPandas(walk, schema), "listed")
        found = made if found is None else found.unionByName(made)
        left = made.where("todo").count()
        if not left:
            break
        todo = made.where("todo").select(F.col("path").alias("start")).repartition(min(left, 4 * partitions(spark)))
    raw = found.where("NOT todo")
    raw = raw if sensitive_files else raw.where(~sensitive(F.col("name")))
    return raw.select(
        "path", "name", extension(F.col("name")).alias("extension"), kind(extension(F.col("name"))).alias("kind"), "size", "modified", "created", "mtime_ns", "stable_id", "error"
    )


def stat_of(files: DataFrame, path: str = "path") -> DataFrame:
    """The columns of ``files`` (but for those made here) with what the file system tells now: metadata, ``stable_id`` and ``folder``.

    A path that is not there has null ``size`` and is no folder.
    """
    made = "size long, modified long, created long, mtime_ns long, stable_id string, folder boolean"
    kept = [c for c in files.columns if c not in [x.split(" ")[0] for x in made.split(", ")] and c not in ("name", "extension", "kind")]

    @F.pandas_udf(made)
    def stat(paths: pd.Series) -> pd.DataFrame:
        import os
        import stat as mode

        rows = []
        for p in paths:
            try:
                s = os.lstat(p)
                if mode.S_ISDIR(s.st_mode):
                    rows.append((None, None, None, None, None, True))
                elif mode.S_ISREG(s.st_mode):
                    rows.append((s.st_size, int(s.st_mtime), int(s.st_ctime), s.st_mtime_ns, f"{s.st_dev}:{s.st_ino}", False))
                else:
                    rows.append((None,) * 5 + (False,))
            except (OSError, TypeError):
                rows.append((None,) * 5 + (False,))
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in made.split(", ")])

    name = F.regexp_extract(path, r"([^\\/]+)$", 1)
    out = files.select(*kept, stat(F.col(path)).alias("__s")).select(*kept, "__s.*")
    return out.withColumns({"name": name, "extension": extension(name), "kind": kind(extension(name))})


def read_contents(spark: SparkSession, folder: str, max_bytes: int = 32 << 20) -> DataFrame:
    """``path``, ``content``, ``error``: bytes up to ``max_bytes``; larger files are error rows and aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^file:/*", "/").alias("path")
    small = raw.where(F.col("length") <= max_bytes).select(path, "content", F.lit(None).cast("string").alias("error"))
    large = raw.where(F.col("length") > max_bytes).select(path, F.lit(None).cast("binary").alias("content"), F.lit("File is larger than the limit").alias("error"))
    return small.unionByName(large)


#: Bytes of contents in a batch on its way from Python.
BATCH_BYTES = 32 << 20


def with_contents(files: DataFrame, max_bytes: int = 32 << 20, path: str = "path") -> DataFrame:
    """``files`` with ``content`` and ``read_error``, read where the rows are from folders that every executor mounts.

    Only the files asked for are opened; one that is too large, gone or locked is an error of its own row.
    Contents leave Python in batches of BATCH_BYTES, not of rows, so a task holds that much and one file.
    """
    at = files.columns.index(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        def out(b: pa.RecordBatch, first: int, made: list) -> pa.RecordBatch:
            part = b.slice(first, len(made))
            columns = [pa.array([c for c, _ in made], pa.binary()), pa.array([e for _, e in made], pa.string())]
            return pa.RecordBatch.from_arrays([*part.columns, *columns], [*b.schema.names, "content", "read_error"])

        for b in batches:
            first, made, size = 0, [], 0
            for p in b.column(at).to_pylist():
                try:
                    if os.path.getsize(p) > max_bytes:
                        made.append((None, "File is larger than the limit"))
                    else:
                        with open(p, "rb") as f:
                            made.append((f.read(), None))
                        size += len(made[-1][0])
                except (OSError, TypeError) as e:
                    made.append((None, str(e)))
                if size >= BATCH_BYTES:
                    yield out(b, first, made)
                    first, made, size = first + len(made), [], 0
            if made:
                yield out(b, first, made)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in files.dtypes), "content binary", "read_error string"])
    return files.mapInArrow(read, schema)
