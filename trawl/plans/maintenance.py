"""Queries of incremental upkeep, status and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.scalar import content_hash, priority
from ..operators import status, upkeep
from ..operators.snapshots import last_rows
from ..runtime import table
from ..streaming import changes
from .registry import query

_SNAP = """last AS (SELECT snapshot_no, root_id, path, size, modified, mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY received_at DESC NULLS LAST) AS rn FROM file_snapshots) WHERE rn = 1),
scan AS (SELECT * FROM last WHERE snapshot_no = 2), earlier AS (SELECT * FROM last WHERE snapshot_no = 1)"""
_DIFF = f"""{_SNAP}, diff AS (SELECT coalesce(s.path, f.path) AS path, f.id AS file_id,
CASE WHEN f.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'gone' WHEN s.size IS DISTINCT FROM f.size OR s.mtime_ns IS DISTINCT FROM f.mtime_ns THEN 'changed' ELSE 'same' END AS status
FROM scan s FULL JOIN files f ON f.path = s.path)"""


def _delivery(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return last_rows(table(spark, sf_dir, "file_snapshots").where(F.col("snapshot_no") == n).drop("snapshot_no"), ["path"], ["received_at"])


@query("JON-7", "FLT-10", "SNK-1", sql=f"WITH {_DIFF} SELECT path, file_id, status FROM diff")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.scan_diff(_delivery(spark, sf_dir, 2), table(spark, sf_dir, "files"))


@query("JON-7", "AGG-1", sql=f"WITH {_DIFF} SELECT status, count(*) AS paths FROM diff GROUP BY status")
def scan_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = upkeep.scan_diff(_delivery(spark, sf_dir, 2), table(spark, sf_dir, "files"))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("paths"))


@query(
    "JON-9", "SNK-2",
    sql=f"""WITH {_SNAP}, gone AS (SELECT root_id, size, kind, min(path) AS old_path FROM files WHERE path NOT IN (SELECT path FROM scan) AND size IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1),
fresh AS (SELECT root_id, size, kind, min('E:' || path) AS new_path FROM files WHERE size IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT old_path, new_path FROM gone JOIN fresh ON gone.root_id = fresh.root_id AND gone.size = fresh.size AND gone.kind = fresh.kind""",
)
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed files that a delivery lacks, found again on another drive: root, size and kind are their identity here."""
    files, there = table(spark, sf_dir, "files"), _delivery(spark, sf_dir, 2)
    gone = files.join(there.select("path"), "path", "left_anti")
    return upkeep.renames(gone, files.withColumn("path", F.concat(F.lit("E:"), "path")), ["root_id", "size", "kind"]).select("old_path", "new_path")


@query(
    "SNK-2", "JON-9",
    sql="""WITH shared AS (SELECT root_id, stable_id, mtime_ns FROM files WHERE kind IN ('text', 'code') AND stable_id <> '' AND mtime_ns IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT f.id, CASE WHEN s.root_id IS NULL THEN f.path ELSE f.path || '.moved' END AS path FROM files f LEFT JOIN shared s ON f.kind IN ('text', 'code') AND s.root_id = f.root_id AND s.stable_id = f.stable_id AND s.mtime_ns = f.mtime_ns""",
)
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan finds all texts and code under other paths; those of an identity of their own keep their ids."""
    files = table(spark, sf_dir, "files")
    elsewhere = F.when(F.col("kind").isin("text", "code"), F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))
    return upkeep.renamed(files, files.withColumn("path", elsewhere))[0].select("id", "path")


@query("JON-8", "SET-2", "SNK-4", "STR-8", sql=f"WITH {_SNAP} SELECT id FROM files WHERE path NOT IN (SELECT path FROM scan)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.tombstones(table(spark, sf_dir, "files"), _delivery(spark, sf_dir, 2)).select("id")


@query(
    "SNK-1",
    sql=f"""WITH {_DIFF}, top AS (SELECT max(id) AS m FROM files), fresh AS (SELECT path, row_number() OVER (ORDER BY path) AS rn FROM diff WHERE status = 'new')
SELECT f.id, f.path, CASE WHEN d.status = 'changed' THEN 'queued' ELSE f.state END AS state, CASE WHEN d.status = 'gone' THEN f.seen ELSE 77 END AS seen FROM files f JOIN diff d ON d.path = f.path
UNION ALL SELECT m + rn, path, 'queued', 77 FROM fresh, top""",
)
def upserted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.upsert(table(spark, sf_dir, "files"), _delivery(spark, sf_dir, 2), run=77).select("id", "path", "state", "seen")


@query(
    "SNK-6",
    sql="""SELECT 'roots' AS rows_of, count(*) AS n FROM roots WHERE id NOT IN (1, 4) UNION ALL SELECT 'files', count(*) FROM files WHERE root_id NOT IN (1, 4)
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id NOT IN (SELECT id FROM files WHERE root_id IN (1, 4))""",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = upkeep.cascade(*(table(spark, sf_dir, t) for t in ("roots", "files", "chunks")), [1, 4])
    counts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rows_of"), "n") for name, d in zip(("roots", "files", "chunks"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "JON-10", "SCL-9",
    sql="""WITH old AS (SELECT file_id, hash, min(id) AS id FROM chunks WHERE vector IS NOT NULL AND hash IS NOT NULL GROUP BY 1, 2)
SELECT c.id, o.id IS NOT NULL AS reused FROM chunks c LEFT JOIN old o ON o.file_id = c.file_id AND o.hash = c.hash""",
)
def reused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    return upkeep.reuse(c, c).select("id", F.col("vector").isNotNull().alias("reused"))


@query(
    "SNK-3", "SNK-7",
    sql="""WITH fresh AS (SELECT *, row_number() OVER (ORDER BY file_id, seq) AS rn FROM chunks WHERE file_id IN (SELECT id FROM files WHERE kind = 'text'))
SELECT id, file_id, seq, hash FROM chunks WHERE file_id NOT IN (SELECT file_id FROM fresh) UNION ALL SELECT (SELECT max(id) FROM chunks) + rn, file_id, seq, hash FROM fresh""",
)
def committed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files")
    c = c.select("id", "file_id", "seq", "hash")
    new = c.join(f.where("kind = 'text'").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return upkeep.commit_chunks(c, new)


@query(
    "SRT-5", "SCL-21", "STR-19",
    sql="""SELECT id AS file_id, kind, CASE kind WHEN 'text' THEN 0 WHEN 'code' THEN 1 WHEN 'document' THEN 2 WHEN 'pdf' THEN 2 WHEN 'image' THEN 3 WHEN 'audio' THEN 4 ELSE 5 END::BIGINT AS priority
FROM files WHERE state = 'queued' AND online AND kind NOT IN ('image', 'audio', 'video')""",
)
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.job_queue(table(spark, sf_dir, "files"), pause_media=True)


@query("SRT-5", sql="SELECT file_id FROM jobs WHERE online AND state = 'queued' ORDER BY priority, file_id LIMIT 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").where("online AND state = 'queued'").orderBy("priority", "file_id").select("file_id").limit(1)


@query("SCL-21", sql="SELECT kind, CASE kind WHEN 'text' THEN 0 WHEN 'code' THEN 1 WHEN 'document' THEN 2 WHEN 'pdf' THEN 2 WHEN 'image' THEN 3 WHEN 'audio' THEN 4 ELSE 5 END::BIGINT AS priority, count(*) AS files FROM files GROUP BY 1, 2")
def kind_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    return f.groupBy("kind", priority(F.col("kind")).cast("long").alias("priority")).agg(F.count(F.lit(1)).alias("files"))


@query("STR-12", "FLT-3", sql="SELECT f.id, CASE WHEN r.online = false THEN false ELSE f.online END AS online FROM files f LEFT JOIN roots r ON r.id = f.root_id")
def root_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.root_offline(table(spark, sf_dir, "files"), table(spark, sf_dir, "roots")).select("id", "online")


@query("SNK-9", "JON-15", sql="SELECT f.id FROM files f WHERE f.error IS NOT NULL AND EXISTS (SELECT 1 FROM jobs j WHERE j.file_id = f.id)")
def failed_with_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.failed_with_job(table(spark, sf_dir, "files"), table(spark, sf_dir, "jobs")).select("id")


@query("STR-18", sql="SELECT id FROM files WHERE state = 'partial' AND starts_with(error, 'Semantic model unavailable')")
def waiting_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.waiting_for_model(table(spark, sf_dir, "files")).select("id")


@query("STR-9", sql="SELECT file_id, CASE WHEN state = 'active' THEN 'queued' ELSE state END AS state FROM jobs")
def restarted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.restarted(table(spark, sf_dir, "jobs")).select("file_id", "state")


@query("SNK-9", sql="SELECT count(*) AS files, count(*) FILTER (WHERE false) AS semantic, 0::BIGINT AS vectors FROM files")
def semantics_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = upkeep.reset_semantics(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))
    return f.agg(F.count(F.lit(1)).alias("files"), F.count_if("semantic").alias("semantic")).crossJoin(F.broadcast(c.agg(F.count("vector").alias("vectors"))))


@query(
    "AGG-1", "AGG-2", "AGG-6", "AGG-8", "SNK-14",
    sql="""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE semantic) AS semantic, (SELECT count(error) FROM files) AS errors, (SELECT sum(size)::BIGINT FROM files) AS bytes,
(SELECT count(*) FROM chunks) AS chunks, (SELECT count(vector) FROM chunks) AS vectors, (SELECT count(*) FROM jobs) AS jobs""",
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.counts(*(table(spark, sf_dir, t) for t in ("files", "chunks", "jobs")))


@query("AGG-3", sql="SELECT kind, count(*) AS pending FROM jobs WHERE online GROUP BY kind")
def pending_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.pending_kinds(table(spark, sf_dir, "jobs"))


@query("AGG-4", "JON-4", sql="SELECT r.id, r.path, r.online, count(f.id) AS files, count(*) FILTER (WHERE f.semantic) AS indexed FROM roots r LEFT JOIN files f ON f.root_id = r.id GROUP BY ALL")
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.root_counts(table(spark, sf_dir, "roots"), table(spark, sf_dir, "files"))


@query("AGG-5", "AGG-7", sql="SELECT count(*) || ':' || coalesce(max(id), 0) AS signature FROM chunks WHERE vector IS NOT NULL")
def checkpoint_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.signature(table(spark, sf_dir, "chunks"))


@query("AGG-17", sql="SELECT file_id, bool_or(vector IS NOT NULL) AS semantic FROM chunks GROUP BY file_id")
def files_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("file_id").agg(F.bool_or(F.col("vector").isNotNull()).alias("semantic"))


@query(
    "SNK-6", "JON-16",
    sql=""" SELECT 'files.root_id' AS "check", count(*) AS orphans FROM files WHERE root_id NOT IN (SELECT id FROM roots)
UNION ALL SELECT 'chunks.file_id', count(*) FROM chunks WHERE file_id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'jobs.file_id', count(*) FROM jobs WHERE file_id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'activity.file_id', count(*) FROM activity WHERE file_id NOT IN (SELECT id FROM files)""",
)
def health_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.health(*(table(spark, sf_dir, t) for t in ("roots", "files", "chunks", "jobs", "activity")))


@query("SNK-10", sql="SELECT id, kind FROM activity WHERE id >= (SELECT max(id) - 2000 FROM activity)")
def activity_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.trimmed(table(spark, sf_dir, "activity")).select("id", "kind")


@query("SNK-10", "SRT-7", sql="SELECT id, logged, kind, message FROM activity ORDER BY id DESC LIMIT 500")
def activity_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.last_activity(table(spark, sf_dir, "activity")).select("id", "logged", "kind", "message")


@query("SRT-6", sql="SELECT id, seq FROM chunks WHERE file_id = 1 ORDER BY seq, id LIMIT 500")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("file_id = 1").orderBy("seq", "id").limit(500).select("id", "seq")


@query("AGG-20", sql="SELECT string_agg(text, chr(10) || chr(10) ORDER BY seq, id) AS preview FROM (SELECT * FROM chunks WHERE file_id = 1 AND trim(text) <> '' ORDER BY seq, id LIMIT 50)")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.preview(table(spark, sf_dir, "chunks"), 1)


@query("SRT-10", sql="SELECT id, name, size FROM files ORDER BY size DESC NULLS LAST, id LIMIT 8")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").orderBy(F.col("size").desc_nulls_last(), "id").limit(8).select("id", "name", "size")


_COST = """samples AS (SELECT event_type AS kind, event_id AS id, value AS seconds FROM events),
lists AS (SELECT kind, list(seconds ORDER BY id) AS l FROM samples GROUP BY kind),
cost AS (SELECT kind, len(l) AS samples, list_reduce(l, lambda a, x: a * 0.8 + x * 0.2) AS cost FROM lists)"""


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.costs(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("seconds")))


@query("AGG-13", "WIN-6", sql=f"WITH {_COST} SELECT kind, samples, round(cost, 6) AS cost FROM cost")
def ewma_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost(spark, sf_dir).withColumn("cost", F.round("cost", 6))


@query(
    "AGG-14",
    sql=f"""WITH {_COST}, pending AS (SELECT event_type AS kind, count(*) AS pending FROM events GROUP BY 1)
SELECT round(sum(pending * coalesce(CASE WHEN c.samples >= 3 THEN c.cost END, m.mean)), 4) AS seconds, bool_or(c.samples IS NULL OR c.samples < 3) AS provisional
FROM pending p LEFT JOIN cost c ON c.kind = p.kind, (SELECT sum(cost * samples) / sum(samples) AS mean FROM cost) m""",
)
def index_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("pending"))
    return status.index_eta(_cost(spark, sf_dir), pending).withColumn("seconds", F.round("seconds", 4))


@query(
    "AGG-15", "AGG-16",
    sql="""SELECT user_id, count(*) AS done, max(max(event_id)) OVER () AS total, sum(value) AS seconds,
CASE WHEN count(*) >= 128 AND sum(value) > 0 THEN round(greatest(max(max(event_id)) OVER () - count(*), 0) * sum(value) / count(*), 3) END AS eta,
CASE WHEN sum(value) > 0 THEN round(count(*) / sum(value), 6) END AS per_second FROM events WHERE value IS NOT NULL GROUP BY user_id""".replace("sum(value) AS seconds,", "round(sum(value), 4) AS seconds,"),
)
def discovery_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a scan of its own: some have seen 128 files, others haven't."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    total = e.agg(F.max("event_id").alias("total"))  # one row
    scans = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("done"), F.sum("value").alias("seconds")).crossJoin(F.broadcast(total))
    made = status.discovery(scans)
    return made.select("user_id", "done", "total", F.round("seconds", 4).alias("seconds"), F.round("eta", 3).alias("eta"), F.round("per_second", 6).alias("per_second"))


@query("AGG-19", sql="SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


_EVENTS = "ev AS (SELECT *, 'u' || user_id AS path, event_type IN ('create', 'rename', 'any', 'other', 'click') AS recursive FROM events WHERE event_type <> 'access')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return changes.intake(e, "event_type").withColumn("recursive", F.col("recursive") | (F.col("event_type") == "click"))


@query(
    "STR-1", "STR-2",
    sql=f"""WITH {_EVENTS}, gaps AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS s FROM gaps)
SELECT path, min(ts) AS started, max(ts) AS last, count(*) AS events, bool_or(recursive) AS recursive FROM sessions GROUP BY path, s""",
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.debounced(_events(spark, sf_dir), quiet="10 minutes")


@query(
    "STR-3", "STR-4", "SRT-8",
    sql=f"""WITH {_EVENTS}, waiting AS (SELECT path, bool_or(recursive) AS recursive, arg_max(event_type, event_id) <> 'error' AS "exists" FROM ev GROUP BY path)
SELECT path, recursive, "exists" FROM waiting ORDER BY "exists" DESC, path LIMIT 256""",
)
def micro_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = _events(spark, sf_dir).groupBy("path").agg(F.bool_or("recursive").alias("recursive"), (F.max_by("event_type", "event_id") != "error").alias("exists"))
    return changes.next_batch(waiting)


@query(
    "STR-4", "SET-3",
    sql="""WITH p AS (SELECT path, lower(replace(path, chr(92), '/')) AS n, extension IS NULL OR kind = 'binary' AS recursive FROM files),
d AS (SELECT DISTINCT lower(replace(regexp_replace(path, '[\\\\/][^\\\\/]*$', ''), chr(92), '/')) AS n FROM files WHERE kind = 'code'),
batch AS (SELECT n, false AS recursive FROM p UNION ALL SELECT n, true FROM d)
SELECT b.n AS path, bool_or(b.recursive) AS recursive FROM batch b WHERE NOT EXISTS (SELECT 1 FROM d WHERE starts_with(b.n, d.n || '/')) GROUP BY b.n""",
)
def covered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes without those that a changed folder above them covers."""
    from ..functions.scalar import normal_path, parent

    f = table(spark, sf_dir, "files")
    folders = f.where("kind = 'code'").select(normal_path(parent(F.col("path"))).alias("path"), F.lit(True).alias("recursive"))
    batch = f.select(normal_path(F.col("path")).alias("path"), F.lit(False).alias("recursive")).unionByName(folders)
    batch = batch.groupBy("path").agg(F.bool_or("recursive").alias("recursive"))
    return changes.covered(batch)


@query(
    "STR-7", "SRC-10",
    sql="""WITH d AS (SELECT file_id, max(end_sec) AS duration FROM chunks WHERE modality IN ('audio', 'video') GROUP BY 1),
n AS (SELECT file_id, duration, unnest(range(0, greatest(ceil((duration - 60) / 55), 0)::BIGINT + 1)) AS seq FROM d WHERE duration > 0)
SELECT file_id, seq, seq * 55.0::DOUBLE AS start_sec, least(seq * 55.0::DOUBLE + 60, duration) AS end_sec FROM n""",
)
def media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where(F.col("modality").isin("audio", "video")).groupBy("file_id").agg(F.max("end_sec").alias("duration"))
    made = chunking.segments(c, "duration", 60.0)
    return made.select("file_id", F.col("seq").cast("long").alias("seq"), "start_sec", "end_sec")


@query("SRC-7", sql="SELECT l_orderkey // 32 AS block, count(*) AS rows_in, string_agg(l_orderkey || chr(9) || l_linenumber, chr(10) ORDER BY l_orderkey, l_linenumber) AS text FROM lineitem GROUP BY 1")
def sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks of 32 rows made of a table: tab-separated lines, a block bounded by its key range."""
    row = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("r")))), lambda x: x["r"])
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_orderkey") / 32).alias("block")).agg(F.count(F.lit(1)).alias("rows_in"), F.array_join(ordered, "\n").alias("text"))


#: White space as Python's split() sees it (fixed values).
_SPACE = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: The greedy rule line by line: each chunk begins where the one before it says.
_CHUNKS = f"""WITH RECURSIVE texts AS (SELECT doc_id, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: CASE WHEN ends_with(x, chr(13)) THEN x[:-2] ELSE x END) AS lines
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
counted AS (SELECT doc_id, lines, list_transform(lines, lambda x: len(list_filter(string_split_regex(x, '{_SPACE}+'), lambda y: y <> ''))) AS w, list_transform(lines, lambda x: length(x)) AS c FROM texts WHERE len(lines) > 0),
sums AS (SELECT doc_id, lines, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) AS cw, list_transform(range(0, len(c) + 1), lambda i: coalesce(list_sum(c[1:i]), 0)) AS cc FROM counted),
steps(doc_id, a, b) AS (
 SELECT doc_id, 1::BIGINT, coalesce(list_max(list_filter(range(1, len(lines) + 1), lambda e: cw[e + 1] - cw[1] <= 400 AND cc[e + 1] - cc[1] <= 1800)), 1) FROM sums
 UNION ALL
 SELECT doc_id, s, greatest(s, coalesce(list_max(list_filter(range(s, len(lines) + 1), lambda e: cw[e + 1] - cw[s] <= 400 AND cc[e + 1] - cc[s] <= 1800)), s)) FROM (
  SELECT t.doc_id, lines, cw, cc, greatest(a + 1, coalesce(list_max(list_filter(range(a + 1, b + 1), lambda x: cw[b + 1] - cw[x] >= 60)), a + 1)) AS s
  FROM steps t JOIN sums u ON u.doc_id = t.doc_id WHERE b < len(lines))),
bodies AS (SELECT s.doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS body, substr(regexp_replace(lines[a], '^#+', ''), 1, 100) AS heading FROM steps s JOIN sums u ON u.doc_id = s.doc_id),
pieces AS (SELECT doc_id, a, b, heading, body, unnest(range(0, length(body), 1800)) AS off FROM bodies WHERE regexp_replace(body, '{_SPACE}', '', 'g') <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, off) - 1 AS seq, substr(body, off + 1, 1800) AS text, heading, a AS line_start, b AS line_end, sha256(substr(body, off + 1, 1800)) AS hash FROM pieces"""


@query("UDF-1", "WIN-4", "WIN-5", "SCL-15", sql=_CHUNKS)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    long = [F.col(c).cast("long").alias(c) for c in ("seq", "line_start", "line_end")]
    return chunking.chunked(d).select("doc_id", long[0], "text", "heading", *long[1:], "hash")


@query("UDF-2", "UDF-3")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code chunks cut at top-level definitions, each with its language's rules."""
    c = table(spark, sf_dir, "chunks").where("modality = 'code'").join(
        table(spark, sf_dir, "files").select(F.col("id").alias("file_id"), "extension"), "file_id", "left"
    )
    made = chunking.chunked(c.select("id", "text", "modality", "extension"), modality=F.col("modality"), extension=F.col("extension"))
    return made.select("id", "seq", "text", "heading", "line_start", "line_end")


@query("SCL-9", "SRC-16", sql="SELECT range AS id, 'report document ' || range || '.txt' AS name, sha256('report document ' || range || '.txt') AS content_hash FROM range(1000)")
def synthetic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1000).select("id", F.concat(F.lit("report document "), F.col("id").cast("string"), F.lit(".txt")).alias("name"))
    return n.withColumn("content_hash", content_hash(F.col("name")))


@query(
    "STR-2",
    sql="""WITH ev AS (SELECT *, 'u' || user_id AS path FROM events WHERE event_type <> 'access'),
gaps AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
bursts AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS s FROM gaps)
SELECT path, min(ts)::TIMESTAMP AS started, max(ts)::TIMESTAMP AS last, count(*) AS events, bool_or(event_type IN ('create', 'rename', 'any', 'other')) AS recursive
FROM bursts GROUP BY path, s HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR""",
)
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts of :func:`debounce_sessions` that a stream over the events has closed."""
    from ..runtime import ship

    ship(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    e = stream.withColumn("path", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("ts", F.col("ts").cast("timestamp"))
    made = changes.run_to_table(spark, changes.debounced(changes.intake(e, "event_type"), quiet="10 minutes", late="1 hour"), "debounced")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last")})
