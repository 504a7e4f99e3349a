"""Queries of the core's general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import snapshot_changes
from ..runtime import table
from .registry import query

_LAST = """
WITH last AS (
  SELECT snapshot_no, path, size, modified FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY received_at DESC NULLS LAST) AS rn FROM file_snapshots
  ) WHERE rn = 1
),
numbers AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT snapshot_no FROM last)),
old AS (SELECT n.snapshot_no, l.path, l.size, l.modified FROM numbers n JOIN last l ON l.snapshot_no = n.before_no),
new AS (SELECT l.* FROM numbers n JOIN last l ON l.snapshot_no = n.snapshot_no WHERE n.before_no IS NOT NULL),
diff AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         WHEN n.size IS DISTINCT FROM o.size OR n.modified IS DISTINCT FROM o.modified THEN 'changed' END AS change,
    o.size AS old_size, o.modified AS old_modified, n.size AS new_size, n.modified AS new_modified
  FROM new n FULL JOIN old o ON n.snapshot_no = o.snapshot_no AND n.path = o.path
)
"""


def _changes(spark: SparkSession, sf_dir: str, fetch_old: bool) -> DataFrame:
    return snapshot_changes(
        table(spark, sf_dir, "file_snapshots"), "snapshot_no", ["path"], ["size", "modified"], "received_at", fetch_old
    )


@query("JON-7", "SET-2", "FLT-10", sql=_LAST + "SELECT snapshot_no, path, change FROM diff WHERE change IS NOT NULL")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir, False)


@query(
    "JON-7",
    sql=_LAST + "SELECT snapshot_no, path, change, old_size, old_modified, new_size, new_modified FROM diff WHERE change IS NOT NULL",
)
def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with old and new values, fetched for what changed only."""
    return _changes(spark, sf_dir, True)
