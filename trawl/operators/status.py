"""Counts, progress and health of an index, from narrow columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ewma

ACTIVITY_KEPT = 2000


def counts(files: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: files, semantic files, errors, chunks with vectors, jobs."""
    f = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("semantic").alias("semantic"), F.count("error").alias("errors"), F.sum("size").alias("bytes")
    )
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("vector").alias("vectors"))
    return f.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(jobs.agg(F.count(F.lit(1)).alias("jobs"))))  # one row each


def pending_kinds(jobs: DataFrame) -> DataFrame:
    return jobs.where("online").groupBy("kind").agg(F.count(F.lit(1)).alias("pending"))


def root_counts(roots: DataFrame, files: DataFrame) -> DataFrame:
    """Each root with its files and its semantic files; 0 for roots without any."""
    per = files.groupBy(F.col("root_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.count_if("semantic").alias("indexed"))
    return roots.select("id", "path", "online").join(per, "id", "left").na.fill(0, ["files", "indexed"])


def signature(chunks: DataFrame, key: str = "id") -> DataFrame:
    """Count and greatest id of the vectors: what a saved vector index must match."""
    have = chunks.where("vector IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(key), F.lit(0)).alias("m"))
    return have.select(F.concat_ws(":", F.col("n").cast("string"), F.col("m").cast("string")).alias("signature"))


def health(roots: DataFrame, files: DataFrame, chunks: DataFrame, jobs: DataFrame, activity: DataFrame) -> DataFrame:
    """``check``, ``orphans``: rows whose parent is missing, by foreign key; null keys are no orphans."""
    def orphans(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        lost = child.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).join(parent.select("id"), "id", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check"), "orphans")

    return (
        orphans("files.root_id", files, "root_id", roots)
        .unionByName(orphans("chunks.file_id", chunks, "file_id", files))
        .unionByName(orphans("jobs.file_id", jobs, "file_id", files))
        .unionByName(orphans("activity.file_id", activity, "file_id", files))
    )


def trimmed(activity: DataFrame, keep: int = ACTIVITY_KEPT) -> DataFrame:
    """The log without what lies more than ``keep`` ids behind the last."""
    top = activity.agg((F.max("id") - keep).alias("__low"))
    return activity.crossJoin(F.broadcast(top)).where("id >= __low").drop("__low")  # one row


def last_activity(activity: DataFrame, n: int = 500) -> DataFrame:
    return activity.orderBy(F.desc("id")).limit(n)


def costs(samples: DataFrame, kind: str = "kind", order: str = "id", seconds: str = "seconds") -> DataFrame:
    """``kind``, ``samples``, ``cost``: the moving average of seconds a job, first to last.

    A geometric weight is a plain sum, so no kind's samples are gathered in one place: each sample counts
    0.2 * 0.8 ** (number of later ones), the first without the 0.2, and what lies 400 samples back is below
    1e-38 of the average. The limit reaches below the shuffle, so a task gets 400 rows of each other task at most.
    """
    back = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(order)))
    n = samples.groupBy(kind).agg(F.count(F.lit(1)).alias("samples"))
    recent = samples.withColumn("__back", back).where("__back <= 400").join(n, kind)
    weight = F.pow(F.lit(0.8), F.col("__back") - 1) * F.when(F.col("__back") == F.col("samples"), 1.0).otherwise(0.2)
    return recent.groupBy(F.col(kind).alias("kind"), "samples").agg(F.sum(F.col(seconds) * weight).alias("cost"))


def index_eta(cost: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: ``seconds`` and ``provisional``. Kinds of fewer than 3 samples cost the weighted mean of all."""
    mean = cost.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("all"), (F.sum(F.col("cost") * F.col("samples")) / F.sum("samples")).alias("mean"))
    known = cost.where("samples >= 3").select("kind", F.col("cost").alias("own"))
    rows = pending.join(known, "kind", "left").crossJoin(F.broadcast(mean))  # one row
    total = rows.agg(
        F.sum(F.col("pending") * F.coalesce("own", "mean")).alias("s"), F.bool_or(F.col("own").isNull()).alias("p"), F.max("all").alias("all"), F.count(F.lit(1)).alias("n")
    )
    return total.select(
        F.when(F.col("n") == 0, 0.0).when(F.col("all") >= 3, F.col("s")).alias("seconds"),
        F.when(F.col("n") == 0, False).when(F.col("all") < 3, True).otherwise(F.col("p")).alias("provisional"),
    )


def discovery(scans: DataFrame, done: str = "done", total: str = "total", seconds: str = "seconds") -> DataFrame:
    """The columns with ``eta``, seconds left (null before 128 files), and ``per_second``."""
    known = (F.col(done) >= 128) & (F.col(seconds) > 0)
    eta = F.when(known, F.greatest(F.col(total) - F.col(done), F.lit(0)) * F.col(seconds) / F.col(done))
    return scans.withColumn("eta", eta).withColumn("per_second", F.when(F.col(seconds) > 0, F.col(done) / F.col(seconds)))


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and for each name the least value that its share of the group's values doesn't exceed; exact.

    Values are counted, and counts summed over ranges of values, so no task holds a group. Nulls don't count.
    """
    from .upkeep import running_total

    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_total(counted, [group, value], "__c", "__upto")
    of = upto.groupBy(group).agg(F.max("__upto").alias("__end"), F.sum("__c").alias("__n"))
    placed = upto.join(of, group).withColumn("__at", F.col("__upto") - F.col("__end") + F.col("__n"))
    return placed.groupBy(group).agg(*[F.min(F.when(F.col("__at") >= F.col("__n") * share, F.col(value))).alias(name) for name, share in shares.items()])


#: Who is answered first.
PRIORITY = {"search": 3, "benchmark": 2}


def request_queue(requests: DataFrame, kind: str, key: str, n: int, priority: dict[str, int] = PRIORITY) -> DataFrame:
    """``key``, ``priority`` of the next ``n`` requests: by priority, then in the order they came."""
    p = F.lit(0)
    for name, value in priority.items():
        p = F.when(F.col(kind) == name, value).otherwise(p)
    return requests.select(key, p.cast("long").alias("priority")).orderBy(F.desc("priority"), key).limit(n)


def latest(requests: DataFrame, by: str, key: str) -> DataFrame:
    """``key`` of the last request of each asker: older ones are stale and aren't answered."""
    return requests.groupBy(by).agg(F.max(key).alias(key)).select(key)


def throttled(events: DataFrame, time: str, key: str, seconds: float) -> DataFrame:
    """``slot``, ``events``, ``last_id``: of the progress made in each slot of time one row, with the last of it."""
    slot = F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds)
    return events.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("events"), F.max(key).alias("last_id"))


def discovery_eta(done: int, total: int, seconds: float) -> float | None:
    """Seconds left of a scan; unknown before 128 files."""
    return max(total - done, 0) * seconds / done if done >= 128 and seconds > 0 else None


def preview(chunks: DataFrame, file_id: int, n: int = 50) -> DataFrame:
    """The first ``n`` texts of a file that aren't blank, in order, with a blank line between."""
    rows = chunks.where((F.col("file_id") == file_id) & (F.trim("text") != "")).select("seq", "id", "text").orderBy("seq", "id").limit(n)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "id", "text"))), lambda x: x["text"])
    return rows.agg(F.array_join(ordered, "\n\n").alias("preview"))


