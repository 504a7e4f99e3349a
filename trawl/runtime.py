"""What every operator needs from the session: tables, the shared folder, materialised steps."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SHIPPED: set[str] = set()
_SWEPT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each application, compiled and zipped.

    A session whose workers can't import the package otherwise would fail in the first Python step.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    at = tempfile.mkdtemp(prefix="trawl-ship-")  # the driver serves the file to the executors from here
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    try:
        with zipfile.PyZipFile(f"{at}/trawl.zip", "w", optimize=0) as z:
            z.writepy(package)
    except OSError:  # compiled files can't be written beside the sources
        with zipfile.ZipFile(f"{at}/trawl.zip", "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(package)))
    sc.addPyFile(f"{at}/trawl.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``: a file, or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session doesn't name one (tests, a single machine) a folder of
    our own is made, set as the checkpoint folder and removed when Python ends.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="trawl-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"file://{_LOCAL[0]}")
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; gone when the session's Python ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/trawl/{sc.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, sc._jvm, sc._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _sweep(jvm, conf, folder: str) -> None:
    """Delete what a session wrote, if its JVM is still there."""
    try:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM went first, and what it served is nobody's any more
        pass


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a step to the shared folder and read it again.

    Lineage ends there, so a lost executor costs a read and not the work before it,
    and a step that feeds several later ones runs once. Columnar and compressed,
    which a row checkpoint is not.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trawl_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for a step that nothing reads any more."""
    remove(df.sparkSession, df._trawl_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_json(spark: SparkSession, path: str):
    """What a JSON file holds; None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a JSON file whole or not at all: beside its place first, then renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    place, beside = Path(path), Path(f"{path}-{uuid.uuid4().hex}")
    out = place.getFileSystem(conf).create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, options)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    """Shuffle partitions of the session, at least one for each core, times ``factor``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) * factor


def lowest_hashed(rows: DataFrame, key: str, n: int, total: int, *ties: str) -> DataFrame:
    """The ``n`` of ``total`` rows whose key has the lowest hash.

    A threshold that lets through ``n`` rows and a little more is set before anything is sorted, so tasks
    send few rows to the driver, not ``n`` each.
    """
    share = (n + 8 * n**0.5 + 32) / max(total, 1)
    if share < 1:
        rows = rows.where(F.xxhash64(key) < int(-(1 << 63) + share * (1 << 64)))
    return rows.orderBy(F.xxhash64(key), key, *ties).limit(n)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
