"""What changed between full snapshots of a keyed table.

A snapshot index holds key -> fingerprint of the compared columns, bucketed by key, in a folder
that outlives the session. A new delivery is reduced to its last rows and written in the same
buckets, once; the two are joined bucket by bucket without a shuffle, and then the new one is the
index and the old one is deleted. Values lie beside the fingerprints in columns that the probe
doesn't read; old ones are fetched for the changed keys only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, new_path, partitions, read_json, remove, shared_dir, write_json

KEY, PRINT = "__key", "__print"
#: Rows that a bucket is meant to hold.
BUCKET_ROWS = 500_000


def fingerprint(columns: Sequence[str]) -> Column:
    """128 bits over the values. xxhash64 passes over nulls, so each value carries a flag."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *reversed(parts)).alias("b"))


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by ``order``, then by all other columns, so ties are settled.

    A ``max_by`` aggregate: combined on the map side, so a key sent a million times costs
    no task more than one row of it.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return rows.groupBy(*keys).agg(F.max(rank).alias("__last")).select(*keys, *[F.col("__last")[c].alias(c) for c in rest])


class SnapshotIndex:
    """The last snapshot taken in: key, fingerprint and values, as a bucketed table in ``folder``.

    Opened again on the same folder it goes on where it was. Without a folder it is one of its own in the
    shared folder, and :meth:`close` deletes it.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], compare: Sequence[str], folder: str | None = None, buckets: int | None = None):
        self.spark, self.keys, self.compare, self.buckets = spark, list(keys), list(compare), buckets
        self.own = folder is None
        self.folder = folder.rstrip("/") if folder else new_path(spark, "snapshots")
        self.current: dict | None = read_json(spark, f"{self.folder}/_CURRENT")
        if self.current and (self.current["keys"], self.current["compare"]) != (self.keys, self.compare):
            raise ValueError(f"the index in {folder} has other columns")
        self.staged: dict | None = None

    @property
    def snapshot(self):
        """What the last snapshot was called; None before the first."""
        return self.current["snapshot"] if self.current else None

    def _key(self) -> Column:
        # 128 bits stand for the key, so one column is joined and bucketed. Null is a key value like any other;
        # the flag keeps it apart from the empty string
        marked = [F.when(F.col(k).isNull(), "\x01").otherwise(F.concat(F.lit("\x02"), F.col(k).cast("string"))) for k in self.keys]
        return F.md5(F.concat_ws("\x00", *marked))

    def _buckets(self, rows: int) -> int:
        """By the number of rows, but as many as the index has while that is about right, so that no side is shuffled."""
        if self.buckets:
            return self.buckets
        wanted = max(partitions(self.spark), -(-rows // BUCKET_ROWS))
        held = self.current["buckets"] if self.current else 0
        return held if wanted / 4 <= held <= wanted * 4 else wanted

    def _table(self, kept: dict) -> DataFrame:
        """The table of a description; made known to the session if it isn't, as after a restart."""
        if not self.spark.catalog.tableExists(kept["name"]):
            self.spark.sql(
                f"CREATE TABLE {kept['name']} ({kept['schema']}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {kept['buckets']} BUCKETS LOCATION '{self.folder}/{kept['at']}'"
            )
        return self.spark.table(kept["name"])

    def stage(self, rows: DataFrame, snapshot=None, count: int | None = None) -> None:
        """Write a delivery (one row for each key) in buckets. ``count``: about how many rows, counted if not given."""
        self._drop(self.staged)
        made = rows.select(self._key().alias(KEY), *self.keys, fingerprint(self.compare).alias(PRINT), *self.compare)
        n, at = self._buckets(rows.count() if count is None else count), uuid.uuid4().hex
        kept = {"name": f"trawl_snapshot_{at}", "at": f"rows-{at}", "buckets": n, "keys": self.keys, "compare": self.compare, "snapshot": snapshot}
        kept["schema"] = ", ".join(f"`{c}` {t}" for c, t in made.dtypes)
        # by the buckets' own hash first, so each is one file
        writer = made.repartition(n, KEY).write.bucketBy(n, KEY).sortBy(KEY).option("path", f"{self.folder}/{kept['at']}")
        writer.format("parquet").saveAsTable(kept["name"])
        self.staged = kept

    def probe(self, fetch_old: bool = False) -> DataFrame:
        """Keys added, removed or changed in the staged delivery: ``keys``, ``change``, with ``fetch_old`` also old and new values.

        The probe reads key and fingerprint only, and neither side is shuffled. Written, as the index it is read from goes with :meth:`swap`.
        """
        if self.current is None:
            raise ValueError("no snapshot has been taken in yet")
        if self.staged is None:
            raise ValueError("no delivery has been staged")
        sides = [self._table(k).select(F.col(KEY).alias(f"{x}k"), F.col(PRINT).alias(f"{x}p"), *[F.col(k).alias(f"{x}_{i}") for i, k in enumerate(self.keys)]) for k, x in ((self.staged, "n"), (self.current, "o"))]
        change = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when(F.col("np") != F.col("op"), "changed")
        found = sides[0].join(sides[1], F.col("nk") == F.col("ok"), "full_outer").select(
            F.coalesce("nk", "ok").alias(KEY),
            *[F.when(F.col("nk").isNull(), F.col(f"o_{i}")).otherwise(F.col(f"n_{i}")).alias(k) for i, k in enumerate(self.keys)],
            change.alias("change"),
        ).where(F.col("change").isNotNull())
        if not fetch_old:
            return materialize(found.drop(KEY), "changes")
        found = materialize(found, "changed")
        out = found
        for kept, name in ((self.current, "old"), (self.staged, "new")):
            out = out.join(self._table(kept).select(KEY, *[F.col(c).alias(f"{name}_{c}") for c in self.compare]), KEY, "left")
        out = materialize(out.drop(KEY), "changes")
        remove(self.spark, found._trawl_path)
        return out

    def swap(self) -> None:
        """The staged delivery becomes the index, by one rename; the old one is deleted."""
        if self.staged is None:
            raise ValueError("no delivery has been staged")
        write_json(self.spark, f"{self.folder}/_CURRENT", self.staged)
        self._drop(self.current)
        self.current, self.staged = self.staged, None

    def _drop(self, kept: dict | None) -> None:
        if kept:
            self.spark.sql(f"DROP TABLE IF EXISTS {kept['name']}")
            remove(self.spark, f"{self.folder}/{kept['at']}")

    def close(self) -> None:
        """Forget the tables; an index without a folder of its own to stay in is deleted."""
        self._drop(self.staged)
        self.staged = None
        if self.current:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.current['name']}")
        if self.own:
            remove(self.spark, self.folder)


def snapshot_changes(
    rows: DataFrame,
    snapshot: str,
    keys: Sequence[str],
    compare: Sequence[str],
    received: str,
    fetch_old: bool = False,
    folder: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Changes of each snapshot of ``rows`` against the one before it.

    Of several rows with one snapshot and key the last by ``received`` holds; equal times are
    settled by the other values. Null equals null, in keys too. Rows without a snapshot number
    belong to no delivery. With fewer than two snapshots, or none, the result is empty.
    Columns other than those named are passed over, whatever their names.

    With ``folder`` the index is kept there: a later call compares with the last snapshot of the call
    before and takes in only snapshots of higher numbers. Without, all are taken in, from the first.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    rows = rows.select(F.col(snapshot), *keys, *compare, *([received] if received not in {*keys, *compare} else []))
    # the numbers of the deliveries: as many as there are snapshots, not rows
    numbers = {r[0]: r[1] for r in rows.where(F.col(snapshot).isNotNull()).groupBy(snapshot).count().collect()}
    index, parts = SnapshotIndex(spark, keys, compare, folder, buckets), []
    for n in sorted(numbers):
        if index.snapshot is not None and n <= index.snapshot:
            continue
        index.stage(last_rows(rows.where(F.col(snapshot) == F.lit(n)).drop(snapshot), keys, [received]), n, numbers[n])
        if index.current is not None:
            parts.append(index.probe(fetch_old).select(F.lit(n).cast(rows.schema[snapshot].dataType).alias(snapshot), "*"))
        index.swap()
    index.close()
    if parts:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    values = [F.col(c).alias(f"{side}_{c}") for side in ("old", "new") for c in compare] if fetch_old else []
    return rows.where(F.lit(False)).select(snapshot, *keys, F.lit("").alias("change"), *values)


__all__ = ["SnapshotIndex", "fingerprint", "last_rows", "snapshot_changes"]
