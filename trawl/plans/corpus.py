"""Queries over files: classes, filters, paths, exclusions and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.filters import overlaps, DEFAULT_EXCLUSIONS, Exclusions, excluded_by_root, in_scope, owning_root, sensitive
from ..request import parse
from ..runtime import table
from .registry import query

_KIND = """CASE
 WHEN lower(extension) = 'pdf' THEN 'pdf'
 WHEN lower(extension) IN ('docx','pptx','xlsx','ods') THEN 'document'
 WHEN lower(extension) IN ('jpg','jpeg','png','webp','bmp','tiff','tif','gif') THEN 'image'
 WHEN lower(extension) IN ('wav','mp3','m4a','aac','flac','ogg','opus','wma') THEN 'audio'
 WHEN lower(extension) IN ('mp4','mkv','mov','webm','avi','m4v') THEN 'video'
 WHEN lower(extension) IN ('py','js','ts','jsx','tsx','rs','go','java','kt','kts','c','h','cpp','hpp','cs','php','rb','swift','dart','sh','ps1','bat','cmd','vue','svelte') THEN 'code'
 WHEN lower(extension) IN ('txt','md','markdown','rst','log','ini','cfg','conf','toml','yaml','yml','json','jsonl','xml','csv','tsv','sql','html','htm','css','scss','less','eml') THEN 'text'
 ELSE 'binary' END"""
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(lower(replace(trim({0}), chr(92), '/')), '^//\\?/unc/', '//'), '^//\\?/', ''), '/+$', '')"


@query("SCL-1", "FLT-13", sql=f"SELECT id, {_KIND} AS kind FROM files")
def kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", scalar.kind(F.col("extension")).alias("kind"))


@query("SRC-2", sql="SELECT id, nullif(lower(regexp_extract(name, '[^.]\\.([^.\\\\/]+)$', 1)), '') AS extension FROM files")
def name_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", scalar.extension(F.col("name")).alias("extension"))


@query(
    "FLT-1", "FLT-2", "FLT-2a", "FLT-2f", "FLT-3",
    sql="""SELECT id, name, size FROM files WHERE (kind = 'pdf' OR lower(extension) = 'pdf') AND size > 10240 AND size < 20971520 AND online""",
)
def filter_kind_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, filters = parse("type:pdf size:>10KB size:<20MB")
    return table(spark, sf_dir, "files").where(filters.condition() & F.col("online")).select("id", "name", "size")


@query(
    "FLT-2b", "FLT-2e",
    sql="SELECT id, modified FROM files WHERE lower(extension) = 'md' AND modified >= epoch(TIMESTAMP '2024-01-01') AND modified < epoch(TIMESTAMP '2025-06-01')",
)
def filter_extension_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, filters = parse("ext:.MD after:2024-01-01 before:2025-05-31")
    return table(spark, sf_dir, "files").where(filters.condition()).select("id", "modified")


@query(
    "FLT-2c", "FLT-2d",
    sql="SELECT id, path FROM files WHERE starts_with(lower(path), 'd:' || chr(92) || 'archive') AND contains(lower(name), 'report')",
)
def filter_path_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, filters = parse('path:"D:\\archive" name:Report')
    return table(spark, sf_dir, "files").where(filters.condition()).select("id", "path")


@query("FLT-3", sql="SELECT count(*) AS files, count(*) FILTER (WHERE online) AS online FROM files")
def online_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").agg(F.count(F.lit(1)).alias("files"), F.count_if("online").alias("online"))


@query("FLT-4", "SCL-14", sql="SELECT id FROM files WHERE contains(lower(name), 'plan') OR contains(lower(path), 'plan')")
def filename_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(F.lower("name"), F.lit("plan")) | F.contains(F.lower("path"), F.lit("plan"))
    return table(spark, sf_dir, "files").where(hit).select("id")


@query("SCL-10", sql=f"SELECT id, {_NORMAL.format('path')} AS normal FROM files")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", scalar.normal_path(F.col("path")).alias("normal"))


@query("SCL-11", sql="SELECT id, path AS shown FROM files")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbatim = F.concat(F.lit("\\\\?\\"), F.col("path"))
    return table(spark, sf_dir, "files").select("id", scalar.display_path(verbatim).alias("shown"))


@query(
    "FLT-6", "FLT-6a", "FLT-6b", "FLT-6c", "SCL-12", "SCL-13", "JON-13", "SNK-5",
    sql=f"""SELECT f.id, coalesce(CASE
  WHEN r.exclusions LIKE '%node_modules%' THEN regexp_matches(rel, '(^|/)(node_modules|target)(/|$)')
  WHEN r.exclusions LIKE '%drafts/old%' THEN regexp_matches(rel, '(^|/)drafts/old(/|$)')
  WHEN r.exclusions LIKE '%cache%' THEN regexp_matches(rel, '^(.*/)?cache/.*$') ELSE false END, false) AS excluded
FROM (SELECT id, root_id, {_NORMAL.format('path')} AS p FROM files) f
LEFT JOIN roots r ON r.id = f.root_id,
LATERAL (SELECT CASE WHEN starts_with(f.p, {_NORMAL.format('r.path')} || '/') THEN substr(f.p, length({_NORMAL.format('r.path')}) + 2) ELSE f.p END AS rel)""",
)
def exclusions_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded_by_root(table(spark, sf_dir, "files"), table(spark, sf_dir, "roots")).select("id", "excluded")


@query("FLT-6d", "FLT-6e", sql=f"SELECT id FROM files WHERE regexp_matches({_NORMAL.format('path')}, '^(d:/archive/[^/]*_1[^/]*|c:/work/papers)(/|$)')")
def exclusions_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Exclusions(["D:\\archive\\*_1*", "C:/work/papers"])
    return table(spark, sf_dir, "files").where(rules.matches(F.col("path"))).select("id")


@query("FLT-6", "SET-4", "AGG-22", sql=f"SELECT id FROM files WHERE regexp_matches({_NORMAL.format('path')}, '(^|/)(build|dist|node_modules|target|coverage|obj|recovery|logs|backup_[0-9]*)(/|$)')")
def exclusions_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Exclusions([*DEFAULT_EXCLUSIONS, "Logs", "logs", "backup_*"])
    return table(spark, sf_dir, "files").where(rules.matches(F.col("path"))).select("id")


@query("FLT-7", sql="WITH named AS (SELECT id, unnest([name, '.ENV.' || name, name || '.Pem', '.env', 'a.' || extension]) AS name FROM files) SELECT id, name FROM named WHERE lower(name) IN ('.env','id_rsa','id_ed25519','credentials','login data') OR starts_with(lower(name), '.env.') OR regexp_matches(lower(name), '[^.]\\.(pem|key|pfx|p12)$')")
def sensitive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the tables are none of these, so each is looked at with beginnings and endings that are, too."""
    name = F.col("name")
    made = F.array(name, F.concat(F.lit(".ENV."), name), F.concat(name, F.lit(".Pem")), F.lit(".env"), F.concat(F.lit("a."), F.col("extension")))
    return table(spark, sf_dir, "files").select("id", F.explode(made).alias("name")).where(sensitive(F.col("name")))


@query("FLT-8", sql="SELECT id FROM files WHERE path >= 'D:' || chr(92) || 'office' || chr(92) AND path < 'D:' || chr(92) || 'office' || chr(93)")
def scope_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(in_scope(F.col("path"), "D:\\office")).select("id")


@query(
    "FLT-8",
    sql="SELECT id FROM files WHERE starts_with(path, 'D:' || chr(92) || 'archive' || chr(92) || 'logs' || chr(92)) AND NOT contains(substr(path, 17), chr(92))",
)
def scope_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(in_scope(F.col("path"), "D:\\archive\\logs", recursive=False)).select("id")


@query("FLT-12", sql="SELECT id, kind FROM files WHERE kind IN ('text','code','pdf')")
def enabled_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(F.col("kind").isin("text", "code", "pdf")).select("id", "kind")


@query("FLT-14", sql="SELECT id, semantic, error IS NOT NULL AS failed FROM files WHERE semantic OR error IS NOT NULL")
def partial_index_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    return f.where(F.col("semantic") | F.col("error").isNotNull()).select("id", "semantic", F.col("error").isNotNull().alias("failed"))


@query(
    "FLT-15",
    sql=f"""WITH places AS (SELECT id, path FROM roots UNION ALL SELECT DISTINCT -root_id, regexp_replace(path, '[\\\\/][^\\\\/]*$', '') FROM files)
SELECT a.id AS id_a, b.id AS id_b, b.path FROM places a JOIN places b ON a.id <> b.id
WHERE a.id > 0 AND ( {_NORMAL.format('a.path')} = {_NORMAL.format('b.path')} OR starts_with({_NORMAL.format('b.path')}, {_NORMAL.format('a.path')} || '/'))""",
)
def overlapping_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that can't become locations, as they lie in one: the roots and all folders with files (numbered -root_id)."""
    roots = table(spark, sf_dir, "roots").select("id", "path")
    folders = table(spark, sf_dir, "files").select((-F.col("root_id")).alias("id"), scalar.parent(F.col("path")).alias("path")).distinct()
    return overlaps(roots, roots.unionByName(folders))


@query(
    "JON-12",
    sql=f"""SELECT f.id, max(r.id) FILTER (WHERE r.id IS NOT NULL) AS owner FROM files f
LEFT JOIN roots r ON {_NORMAL.format('f.path')} = {_NORMAL.format('r.path')} OR starts_with({_NORMAL.format('f.path')}, {_NORMAL.format('r.path')} || '/') GROUP BY f.id""",
)
def owning_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owning_root(table(spark, sf_dir, "files").select("id", "path"), table(spark, sf_dir, "roots")).select("id", "owner")


@query("SCL-32", sql=f"SELECT id, len(string_split({_NORMAL.format('path')}, '/')) AS ancestors FROM files")
def ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", F.size(scalar.ancestors(scalar.normal_path(F.col("path")))).cast("long").alias("ancestors"))


@query("SCL-9", "AGG-12", sql="SELECT id, sha256(text) AS content_hash FROM chunks WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("id", scalar.content_hash(F.col("text")).alias("content_hash"))


@query("SCL-9", sql="SELECT sha256(text) AS content_hash, count(*) AS copies, min(id) AS first_id FROM chunks WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("id", scalar.content_hash(F.col("text")).alias("content_hash"))
    return c.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


@query("SCL-16", sql="SELECT id, length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS words, len(string_split(text, chr(10))) AS lines FROM chunks WHERE text IS NOT NULL")
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[^ \t\r\n]+")).cast("long")
    return c.select("id", F.length("text").cast("long").alias("chars"), words.alias("words"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query("SCL-15", sql="SELECT id, substr(regexp_replace(string_split(replace(text, chr(13), ''), chr(10))[1], '^#+', ''), 1, 100) AS heading FROM chunks WHERE text IS NOT NULL")
def heading_of_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part(F.replace(F.col("text"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("id", scalar.heading(first).alias("heading"))


@query("SCL-17", sql="SELECT id, unnest(range(0, (length(text) + 199) // 200)) AS seq, substr(text, 1 + 200 * unnest(range(0, (length(text) + 199) // 200)), 200) AS piece FROM chunks WHERE text <> ''")
def fixed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor((F.length("text") + 199) / 200).cast("int")
    c = table(spark, sf_dir, "chunks").where("text <> ''").select("id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return c.select("id", F.col("seq").cast("long").alias("seq"), F.substring(F.col("text"), F.col("seq") * 200 + 1, F.lit(200)).alias("piece"))


@query("SCL-18", sql="SELECT id, 'title: ' || coalesce(nullif(heading, ''), 'none') || ' | text: ' || text AS prompt FROM chunks WHERE text IS NOT NULL AND modality = 'text'")
def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL AND modality = 'text'")
    title = F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.lit("none"))
    return c.select("id", F.concat(F.lit("title: "), title, F.lit(" | text: "), F.col("text")).alias("prompt"))


@query("SCL-19", sql="SELECT CASE WHEN modality = 'code' THEN 'code' ELSE 'general' END AS namespace, count(*) AS chunks FROM chunks GROUP BY 1")
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy(scalar.namespace(F.col("modality")).alias("namespace")).agg(F.count(F.lit(1)).alias("chunks"))


@query("SCL-25", sql="SELECT id, unnest(from_json(exclusions, '[\"VARCHAR\"]')) AS rule FROM roots")
def root_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "roots").select("id", F.explode(F.from_json("exclusions", "array<string>")).alias("rule"))


@query(
    "SCL-26",
    sql="""SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0)
WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) WHEN size IS NOT NULL THEN printf('%.1f GB', size / 1073741824.0) END AS shown FROM files""",
)
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", scalar.human_bytes(F.col("size")).alias("shown"))


@query("SCL-27", sql="SELECT id, CASE WHEN start_sec IS NOT NULL THEN printf('%02d:%02d:%02d', floor(start_sec)::BIGINT // 3600, floor(start_sec)::BIGINT // 60 % 60, floor(start_sec)::BIGINT % 60) END AS shown FROM chunks WHERE modality IN ('audio', 'video')")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where(F.col("modality").isin("audio", "video")).select("id", scalar.clock(F.col("start_sec")).alias("shown"))


@query("SCL-29", "SCL-30", sql="SELECT id, substr(regexp_replace(text, '(report|page)', '<mark>\\1</mark>', 'gi'), 1, 220) AS shown FROM chunks WHERE contains(lower(text), 'report')")
def highlighted_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where(F.contains(F.lower("text"), F.lit("report")))
    return c.select("id", scalar.excerpt(scalar.highlight(F.col("text"), ["page", "report", "a"])).alias("shown"))


@query("SCL-20", sql="""SELECT f.id AS file_id, CASE WHEN f.error IS NOT NULL THEN 'partial' WHEN coalesce(c.v, false) THEN 'indexed' WHEN coalesce(c.n, 0) = 0 THEN 'metadata_only' ELSE 'partial' END AS state,
coalesce(c.v, false) AS semantic FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, bool_or(vector IS NOT NULL) AS v FROM chunks GROUP BY 1) c ON c.file_id = f.id""")
def derived_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.upkeep import file_states

    return file_states(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


@query("SCL-4", "SCL-3", sql="SELECT id, make_timestamp(modified * 1000000)::DATE AS day, size >= 1536 AS above FROM files WHERE modified IS NOT NULL")
def dates_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..request import parse_size

    f = table(spark, sf_dir, "files").where("modified IS NOT NULL")
    return f.select("id", F.to_date(F.timestamp_seconds("modified")).alias("day"), (F.col("size") >= parse_size("1.5KB")).alias("above"))
