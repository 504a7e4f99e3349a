"""Keeping the index current: what a scan found against what is indexed, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import priority, state
from ..runtime import materialize


def scan_diff(scan: DataFrame, files: DataFrame, compare: Sequence[str] = ("size", "mtime_ns")) -> DataFrame:
    """``path``, ``status``: each path of a scan or of the index as ``new``, ``changed``, ``same`` or ``gone``.

    One full outer join on the path, of narrow rows. Of several scan rows of a path the greatest holds.
    """
    narrow = scan.groupBy("path").agg(F.max(F.struct(*compare)).alias("s"))
    old = files.select("path", F.col("id").alias("file_id"), F.struct(*compare).alias("o"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("s").isNull(), "gone").when(~F.col("s").eqNullSafe(F.col("o")), "changed").otherwise("same")
    return narrow.join(old, "path", "full_outer").select("path", "file_id", status.alias("status"))


def renames(gone: DataFrame, new: DataFrame, identity: Sequence[str]) -> DataFrame:
    """``old_path``, ``new_path``: gone and new paths of one identity; identities that aren't unique on both sides name nothing."""
    def alone(rows: DataFrame, name: str) -> DataFrame:
        known = rows.where(F.concat_ws("", *[F.col(c).cast("string") for c in identity]) != "")
        for c in identity:
            known = known.where(F.col(c).isNotNull())
        return known.groupBy(*identity).agg(F.min("path").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    return alone(gone, "old_path").join(alone(new, "new_path"), list(identity)).select("old_path", "new_path", *identity)


def renamed(files: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` with the new paths and names of those that a scan found elsewhere under one ``stable_id``, and the pairs.

    They keep their ids, chunks and vectors. As file systems give the numbers of deleted files to new ones, the time of
    change must be the same too. If the new name makes it a file of another kind, it is read anew. Files
    whose old path is still there, and identities that several files share, keep their rows.
    """
    gone, new = files.join(scan.select("path"), "path", "left_anti"), scan.join(files.select("path"), "path", "left_anti")
    pairs = materialize(renames(gone, new, ["root_id", "stable_id", "mtime_ns"]).select("old_path", "new_path"), "renames")
    facts = scan.select(F.col("path").alias("new_path"), *[F.col(c).alias(f"n_{c}") for c in ("name", "extension", "kind")])
    moved = files.join(pairs.join(facts, "new_path"), F.col("path") == F.col("old_path"), "left")
    hit, other = F.col("new_path").isNotNull(), F.col("new_path").isNotNull() & ~F.col("kind").eqNullSafe(F.col("n_kind"))
    value = {
        "path": F.coalesce("new_path", "path"), "content_hash": F.when(~other, F.col("content_hash")), "semantic": F.col("semantic") & ~other, "mtime_ns": F.when(other, 0).otherwise(F.col("mtime_ns")),
        **{c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("name", "extension", "kind")},
    }
    return moved.select(*[value.get(c, F.col(c)).alias(c) for c in files.columns]), pairs


def edited(before: DataFrame, after: DataFrame, compare: Sequence[str] = ("size", "mtime_ns")) -> DataFrame:
    """``path`` of what changed between two readings: results of the first are dropped, and the file is queued again."""
    a, b = (d.select("path", F.struct(*compare).alias(n)) for d, n in ((before, "a"), (after, "b")))
    return a.join(b, "path").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def restarted(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was under way is queued."""
    return jobs.withColumn("state", F.when(F.col("state") == "active", "queued").otherwise(F.col("state")))


def failed_with_job(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files with an error that are queued to be tried again."""
    return files.where("error IS NOT NULL").join(jobs.select(F.col("file_id").alias("id")), "id", "left_semi")


#: How the error of a file begins whose texts are searchable and whose vectors wait for a model (fixed value).
NO_MODEL = "Semantic model unavailable"


def waiting_for_model(files: DataFrame) -> DataFrame:
    """Files that are queued again when a model is there."""
    return files.where((F.col("state") == "partial") & F.startswith(F.col("error"), F.lit(NO_MODEL)))


def to_reconcile(roots: DataFrame, files: DataFrame, activity: DataFrame) -> DataFrame:
    """``id`` of the locations looked at again when idle: those that were away, and those with errors."""
    failed = activity.where("kind = 'error'").select(F.col("file_id").alias("id")).distinct()
    with_errors = files.join(failed, "id", "left_semi").select(F.col("root_id").alias("id")).distinct()
    known = roots.select("id", "online")
    return known.where("NOT online").select("id").unionByName(known.join(with_errors, "id", "left_semi").select("id")).distinct()


def with_ids(rows: DataFrame, order: Sequence[str], table: DataFrame) -> DataFrame:
    """``rows`` with ``__id``: consecutive numbers in the given order, behind the greatest id of ``table``.

    Positions within range partitions and a running count of the partitions' sizes: no task sees all rows.
    """
    start = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    placed = rows.orderBy(*order).withColumn("__p", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "placed")  # ranges are sampled, so a second sort might cut them elsewhere
    first = placed.groupBy("__part").agg(F.min("__p").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = first.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    # a row for each task, and one row
    joined = placed.join(F.broadcast(before), "__part").crossJoin(F.broadcast(start))
    number = F.col("__top") + F.col("__before") + F.col("__p") - F.col("__first") + 1
    return joined.withColumn("__id", number).drop("__top", "__before", "__first", "__p", "__part")


def running_total(rows: DataFrame, order: Sequence, value: str, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` (nulls count 0) up to and with each row in a global order.

    Sums within range partitions on top of those of the partitions before: no task sees all rows.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    placed = rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__p", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")  # ranges are sampled, so a second sort might cut them elsewhere
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__part").agg(F.sum(amount).alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(earlier), F.lit(0)))
    within = F.sum(amount).over(Window.partitionBy("__part").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("__w", within).join(F.broadcast(before.drop("__s")), "__part")  # a row for each task
    return joined.withColumn(name, F.col("__w") + F.col("__before")).drop("__part", "__p", "__w", "__before")


def upsert(files: DataFrame, scan: DataFrame, run: int) -> DataFrame:
    """The files table after a scan: unseen rows stay, same ones get the run's stamp, changed and new ones are queued.

    New ids follow the greatest old one, in order of path.
    """
    s = scan.dropDuplicates(["path"])
    cols = files.columns
    known = files.alias("f").join(s.alias("s"), "path", "left")
    hit = F.col("s.root_id").isNotNull()
    changed = hit & ~(F.col("f.size").eqNullSafe(F.col("s.size")) & F.col("f.mtime_ns").eqNullSafe(F.col("s.mtime_ns")))

    def value(c: str):
        if c == "path":
            return F.col("path")
        if c == "seen":
            return F.when(hit, F.lit(run)).otherwise(F.col("f.seen")).alias(c)
        if c == "online":
            return F.when(hit, F.lit(True)).otherwise(F.col("f.online")).alias(c)
        if c == "state":
            return F.when(changed, "queued").otherwise(F.col("f.state")).alias(c)
        if c in ("size", "mtime_ns", "modified", "stable_id") and c in s.columns:
            return F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
        return F.col(f"f.{c}")

    kept = known.select(*[value(c) for c in cols])
    fresh = s.join(files.select("path"), "path", "left_anti")
    numbered = with_ids(fresh, ["path"], files)
    extra = {"id": F.col("__id"), "seen": F.lit(run), "online": F.lit(True), "state": F.lit("queued"), "semantic": F.lit(False)}
    types = dict(files.dtypes)
    made = [(extra[c] if c in extra else F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in cols]
    return kept.unionByName(numbered.select(*made))


def tombstones(files: DataFrame, scan: DataFrame, errors: int = 0) -> DataFrame:
    """Files that a scan without errors didn't see; none after a scan with errors."""
    gone = files.join(scan.select("path").distinct(), "path", "left_anti")
    return gone if not errors else gone.where(F.lit(False))


def without(rows: DataFrame, gone: DataFrame, on: str, key: str) -> DataFrame:
    """``rows`` without those whose ``on`` is a ``key`` of ``gone``: one step of a cascade."""
    return rows.join(gone.select(F.col(key).alias(on)).distinct(), on, "left_anti")


def cascade(roots: DataFrame, files: DataFrame, chunks: DataFrame, root_ids: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots, files and chunks after some roots are removed."""
    removed = F.col("id").isin(*root_ids)
    lost = files.where(F.col("root_id").isin(*root_ids)).select("id")
    return roots.where(~removed), files.where(~F.col("root_id").isin(*root_ids)), without(chunks, lost, "file_id", "id")


def reuse(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks with ``vector`` taken over from a chunk of the same file and hash; null where there is none."""
    known = old.where("vector IS NOT NULL AND hash IS NOT NULL").groupBy("file_id", "hash").agg(F.min_by("vector", "id").alias("__v"))
    kept = [c for c in new.columns if c != "vector"]
    return new.join(known, ["file_id", "hash"], "left").select(*kept, F.col("__v").alias("vector"))


def commit_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks after those of the files in ``new`` are replaced; new ids follow the greatest old one."""
    rest = without(chunks, new, "file_id", "file_id")
    kept = [c for c in chunks.columns if c != "id"]
    fresh = with_ids(new, ["file_id", "seq"], chunks)
    return rest.unionByName(fresh.select(F.col("__id").alias("id"), *kept))


def file_states(files: DataFrame, chunks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``file_id``, ``state``, ``semantic`` as derived from a file's chunks and the error of its last reading."""
    n = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("vector").isNotNull()).alias("v"))
    rows = files.select(F.col("id").alias("file_id"), *([] if errors is not None else ["error"])).join(n, "file_id", "left")
    if errors is not None:
        rows = rows.join(errors.select("file_id", "error"), "file_id", "left")
    semantic = F.coalesce("v", F.lit(False))
    return rows.select("file_id", state(F.col("error"), semantic, F.coalesce("n", F.lit(0))).alias("state"), semantic.alias("semantic"))


def job_queue(files: DataFrame, pause_media: bool = False) -> DataFrame:
    """Jobs of the queued files in the order they are worked off: ``file_id``, ``kind``, ``priority``."""
    jobs = files.where((F.col("state") == "queued") & F.col("online"))
    if pause_media:
        jobs = jobs.where(~F.col("kind").isin("image", "audio", "video"))
    return jobs.select(F.col("id").alias("file_id"), "kind", priority(F.col("kind")).cast("long").alias("priority")).orderBy("priority", "file_id")


def root_offline(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files of roots that can't be reached are offline and keep their content."""
    off = roots.where(~F.col("online")).select(F.col("id").alias("root_id"), F.lit(True).alias("__off"))
    joined = files.join(off, "root_id", "left")
    return joined.select(*[F.when(F.col("__off"), False).otherwise(F.col("online")).alias(c) if c == "online" else F.col(c) for c in files.columns])


def reset_semantics(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors dropped and every file queued anew, as after a change of the embedding settings."""
    f = files.withColumns({"semantic": F.lit(False), "state": F.lit("queued"), "content_hash": F.lit(None).cast("string")})
    return f, chunks.withColumn("vector", F.lit(None).cast(dict(chunks.dtypes)["vector"]))
