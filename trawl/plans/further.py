"""Queries of the remaining operators: joins by root, encodings, queues, changes applied, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.filters import Exclusions
from ..operators import status, upkeep
from ..operators.snapshots import last_rows
from ..runtime import table
from ..streaming import changes
from .maintenance import _COST
from .registry import query


@query("JON-1", sql="SELECT f.root_id, c.id AS chunk_id FROM chunks c JOIN files f ON f.id = c.file_id WHERE f.root_id = 1")
def chunks_of_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("root_id = 1").select(F.col("id").alias("file_id"), "root_id")
    return table(spark, sf_dir, "chunks").join(files, "file_id").select("root_id", F.col("id").alias("chunk_id"))


@query("FLT-9", "UDF-6", sql="SELECT id FROM files WHERE NOT starts_with(lower(path) || chr(92), 'd:' || chr(92) || 'archive' || chr(92) || 'logs' || chr(92))")
def without_own_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Exclusions(["D:\\archive\\logs"])
    return table(spark, sf_dir, "files").where(~own.matches(F.col("path"))).select("id")


@query("SCL-2", "SRC-3", "UDF-7", sql="SELECT id, regexp_replace(text, '^\ufeff', '') AS text FROM chunks WHERE text IS NOT NULL")
def decoded_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as UTF-8, code as UTF-16, and read by what their bytes show."""
    from ..sources.extract import extract

    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL")
    data = F.when(F.col("modality") == "code", F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    # of a text that itself begins with the mark UTF-16 keeps it, behind its own
    files = c.select("id", data.alias("content"), F.lit("txt").alias("extension"), F.lit("text").alias("kind"))
    return extract(files).select("id", F.regexp_replace("text", "^\ufeff", "").alias("text"))


@query("SCL-8", "SNK-15", sql="SELECT id, 4 * len(vector) AS bytes, vector AS back FROM chunks WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    c = table(spark, sf_dir, "chunks").where(F.col("vector").isNotNull()).where(finite)
    packed = c.select("id", scalar.pack_vector(F.col("vector")).alias("p"))
    return packed.select("id", F.length("p").cast("long").alias("bytes"), scalar.unpack_vector(F.col("p")).alias("back"))


@query(
    "SCL-28",
    sql="""SELECT event_id, CASE WHEN ceil(value) < 60 THEN ceil(value)::BIGINT || ' s' WHEN ceil(value / 60) < 60 THEN ceil(value / 60)::BIGINT || ' min'
ELSE floor(ceil(value / 60) / 60)::BIGINT || ' h ' || (ceil(value / 60)::BIGINT % 60) || ' min' END AS shown FROM events WHERE value IS NOT NULL""",
)
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", scalar.duration_text(F.col("value")).alias("shown"))


@query("SCL-31", "SRC-12", sql="SELECT id, coalesce(extension, '-') || ':' || lower(kind) || ':' || length(name) AS label, printf('%05d', id) AS padded FROM files")
def builtin_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(":", F.coalesce("extension", F.lit("-")), F.lower("kind"), F.length("name").cast("string"))
    return table(spark, sf_dir, "files").select("id", label.alias("label"), F.format_string("%05d", F.col("id")).alias("padded"))


@query("SET-5", sql="WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 500) SELECT x::BIGINT AS x, x % 3 = 0 AS semantic FROM n")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 501).select(F.col("id").alias("x"), (F.col("id") % 3 == 0).alias("semantic"))


@query("SRT-9", sql="SELECT event_id, CASE event_type WHEN 'search' THEN 3 WHEN 'view' THEN 2 ELSE 0 END::BIGINT AS priority FROM events ORDER BY priority DESC, event_id LIMIT 64")
def request_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.request_queue(table(spark, sf_dir, "events"), "event_type", "event_id", 64, {"search": 3, "view": 2})


@query(
    "SCL-34", "STR-14",
    sql="SELECT event_id FROM events e WHERE event_id = (SELECT max(event_id) FROM events u WHERE u.user_id = e.user_id)",
)
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's requests only the last is answered; older ones are stale."""
    return status.latest(table(spark, sf_dir, "events"), "user_id", "event_id")


_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY received_at DESC NULLS LAST) AS rn FROM file_snapshots) WHERE rn = 1)"


def _delivery(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return last_rows(table(spark, sf_dir, "file_snapshots").where(F.col("snapshot_no") == n).drop("snapshot_no"), ["path"], ["received_at"])


@query(
    "STR-13",
    sql=f"WITH {_LAST} SELECT a.path FROM last a JOIN last b ON a.path = b.path AND a.snapshot_no = 2 AND b.snapshot_no = 3 WHERE a.size IS DISTINCT FROM b.size OR a.mtime_ns IS DISTINCT FROM b.mtime_ns",
)
def edited_meanwhile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed between two readings: their results are dropped and they are queued again."""
    return upkeep.edited(_delivery(spark, sf_dir, 2), _delivery(spark, sf_dir, 3))


@query("STR-11", sql="SELECT r.id FROM roots r WHERE NOT r.online OR EXISTS (SELECT 1 FROM activity a JOIN files f ON f.id = a.file_id WHERE a.kind = 'error' AND f.root_id = r.id)")
def roots_to_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.to_reconcile(*(table(spark, sf_dir, t) for t in ("roots", "files", "activity")))


@query("STR-16", sql="SELECT floor(epoch(ts) / 3600)::BIGINT AS slot, count(*) AS events, max(event_id) AS last_id FROM events GROUP BY 1")
def throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress row for each slot of time, the last of it."""
    return status.throttled(table(spark, sf_dir, "events"), "ts", "event_id", 3600)


@query(
    "STR-5", "SNK-1",
    sql=f"""WITH {_LAST}, seen AS (SELECT * FROM last WHERE snapshot_no = 2)
SELECT f.id, CASE WHEN s.size IS DISTINCT FROM f.size OR s.mtime_ns IS DISTINCT FROM f.mtime_ns THEN 'queued' ELSE f.state END AS state, 5 AS seen FROM files f JOIN seen s ON s.path = f.path""",
)
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all indexed paths: what a delivery has is there, and what it lacks is missing."""
    files, there = table(spark, sf_dir, "files"), _delivery(spark, sf_dir, 2)
    batch = files.select("path").join(there.select("path", F.lit(True).alias("exists")), "path", "left").na.fill(False, ["exists"])
    metadata = there.join(files.select("path"), "path", "left_semi")
    return changes.apply_batch(files, batch, metadata, run=5).select("id", "state", "seen")


@query("AGG-21", sql="SELECT id, used::BIGINT AS used FROM (SELECT id, sum(coalesce(size, 0)) OVER (ORDER BY modified DESC NULLS LAST, id) AS used FROM files) WHERE used <= 500000000")
def kept_in_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries that fit a budget."""
    f = table(spark, sf_dir, "files").select("id", "size", "modified")
    return upkeep.running_total(f, [F.col("modified").desc_nulls_last(), F.col("id")], "size", "used").where("used <= 500000000").select("id", "used")


@query("STR-6", sql=f"WITH {_COST} SELECT kind, samples, round(cost, 6) AS cost FROM cost")
def stream_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running averages of :func:`ewma_cost`, kept as the state of a stream."""
    from ..runtime import ship

    ship(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parq*")
    samples = stream.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("seconds"))
    return changes.run_to_table(spark, changes.running_costs(samples), "costs", "update").withColumn("cost", F.round("cost", 6))


@query("SCL-24", sql="SELECT sha256('[256, 60, 30, 1.0]') AS standard, sha256('[128, 60, 30, 1.0]') AS smaller")
def settings_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..engine import Settings

    return spark.createDataFrame([(Settings().fingerprint(), Settings(dimensions=128).fingerprint())], "standard string, smaller string")


@query("SRC-1", "SRC-2", "SCL-1", sql="SELECT doc_id || '.md' AS name, strlen(text)::BIGINT AS size, 'text' AS kind, sha256(text) AS content_hash, doc_id % 7 AS folder FROM documents WHERE text IS NOT NULL")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of nested folders, scanned and read. The shared folder must be one that every executor mounts."""
    from ..runtime import materialize, new_path
    from ..sources.scan import scan_local, with_contents

    at = new_path(spark, "files").removeprefix("file://")
    if "://" in at:
        raise ValueError("files are scanned in a mounted folder")

    def write(batches):
        import os

        for b in batches:
            for i, text in zip(b["doc_id"], b["text"]):
                os.makedirs(f"{at}/{i % 7}/deep", exist_ok=True)
                with open(f"{at}/{i % 7}/deep/{i}.md", "wb") as f:
                    f.write(text.encode())
            yield b[["doc_id"]]

    materialize(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").mapInPandas(write, "doc_id long"), "written")
    read = with_contents(scan_local(spark, at).where("error IS NULL").select("path", "name", "size", "kind"))
    folder = F.regexp_extract("path", r"/(\d)/deep/", 1).cast("long")
    return read.select("name", "size", "kind", F.sha2("content", 256).alias("content_hash"), folder.alias("folder"))


@query(
    "SNK-3", "SNK-11", "SNK-12", "SNK-13",
    sql="""SELECT 'files' AS name, count(*) AS stored, count(*) AS moved, 0::BIGINT AS cleared, sum(id)::BIGINT AS ids FROM files
UNION ALL SELECT 'chunks', count(*), count(*), 0, sum(id)::BIGINT FROM chunks UNION ALL SELECT 'roots', count(*), count(*), count(*), sum(id)::BIGINT FROM roots""",
)
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables committed to an index, compacted, moved to another folder, and the index cleared."""
    from ..engine import Engine
    from ..runtime import new_path

    names = ("files", "chunks", "roots")
    e = Engine(spark, new_path(spark, "index"))
    e.store.commit(**{t: table(spark, sf_dir, t) for t in names})
    count = lambda: {t: e.store.read(t).agg(F.count(F.lit(1)), F.sum("id")).first() for t in names}
    first = count()
    e.compact()
    e.move_index(new_path(spark, "moved"))
    second = count()
    e.clear()
    third = count()
    return spark.createDataFrame([(t, first[t][0], second[t][0], third[t][0], second[t][1]) for t in names], "name string, stored long, moved long, cleared long, ids long")


@query("UDF-5", "WIN-7", sql="SELECT id, CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN [length(text)::FLOAT, (length(text) - length(replace(text, 'e', '')))::FLOAT] END AS vector FROM chunks")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded in small batches, by a stand-in that counts characters; blank ones have no vector."""
    from ..engine import Engine
    from ..runtime import new_path

    e = Engine(spark, new_path(spark, "index"), lambda texts: [[float(len(t)), float(t.count("e")), 0.5] for t in texts])
    e.update_settings(dimensions=2)
    return e._embedded(table(spark, sf_dir, "chunks").select("id", "text", F.lit(None).cast("array<float>").alias("vector"))).select("id", "vector")


_LINES = "lines AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)"
_EDGE = "'^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$'"


def _written(spark: SparkSession, sf_dir: str, extension: str) -> DataFrame:
    from ..sources.extract import extract, written

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", written(F.col("text"), extension).alias("content"))
    return extract(d.withColumns({"extension": F.lit(extension), "kind": F.lit("document")}))


@query("UDF-4", "SRC-5", sql=f"WITH {_LINES}, made AS (SELECT doc_id, n, regexp_replace(line, {_EDGE}, '', 'g') AS text FROM lines) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS part, text FROM made WHERE text <> ''")
def office_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as .docx, a paragraph a line, and read again."""
    return _written(spark, sf_dir, "docx").select("doc_id", F.col("part").cast("long").alias("part"), "text")


@query("UDF-4", "SRC-6", sql=f"WITH {_LINES}, made AS (SELECT doc_id, n, regexp_replace(line, {_EDGE}, '', 'g') AS text FROM lines), kept AS (SELECT *, (n - 1) // 12 + 1 AS page FROM made WHERE text <> '') SELECT doc_id, page, 'Slide ' || page AS heading, string_agg(text, chr(10) ORDER BY n) AS text FROM kept GROUP BY 1, 2")
def slide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as .pptx, twelve lines a slide, and read again."""
    return _written(spark, sf_dir, "pptx").select("doc_id", F.col("page").cast("long").alias("page"), "heading", "text")


_SHEET = f"WITH {_LINES}, kept AS (SELECT doc_id, n, line, BLOCK AS block FROM lines WHERE regexp_replace(line, {_EDGE}, '', 'g') <> '') SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text, min(n) AS line_start, max(n) AS line_end, 'Sheet' AS heading FROM kept GROUP BY doc_id, block"


def _sheets(spark: SparkSession, sf_dir: str, extension: str) -> DataFrame:
    made = _written(spark, sf_dir, extension)
    return made.select("doc_id", "text", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "heading")


@query("UDF-4", "SRC-7", sql=_SHEET.replace("BLOCK", "(n - 1) // 32"))
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as .xlsx, a row a line, and read again in blocks of 32 row numbers."""
    return _sheets(spark, sf_dir, "xlsx")


@query("UDF-4", "SRC-8", sql=_SHEET.replace("BLOCK", "(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // 32"))
def open_sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as .ods, and read again in blocks of 32 rows that aren't blank."""
    return _sheets(spark, sf_dir, "ods")
