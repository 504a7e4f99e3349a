"""Queries of lexical, vector and fused search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.fusion import lexical_list, name_list, search, semantic_list
from ..operators.lexical import LexicalIndex, bm25, term_statistics
from ..operators.vector import Cells, file_queries, nearest, nearest_of
from ..request import Filters, Request
from ..runtime import materialize, table
from .registry import query

_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _counted(prefixes: list[str]) -> str:
    f = ", ".join(f"(len(list_filter(t, lambda x: starts_with(x, '{p}'))) + len(list_filter(h, lambda x: starts_with(x, '{p}'))))::DOUBLE AS f{i}" for i, p in enumerate(prefixes))
    return f"""tokens AS (SELECT id, file_id, {_TOKENS.format('text')} AS t, {_TOKENS.format('heading')} AS h FROM chunks),
counted AS (SELECT id, file_id, (len(t) + len(h))::DOUBLE AS d, {f} FROM tokens),
totals AS (SELECT count(*) AS n, avg(d) AS mean, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS n{i}' for i in range(len(prefixes)))} FROM counted)"""


def _bm25(prefixes: list[str]) -> str:
    idf = [f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END" for i in range(len(prefixes))]
    score = " ".join(f"- ({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(prefixes)))
    return f"""{_counted(prefixes)},
scored AS (SELECT id, file_id, round(0 {score}, 6) AS score FROM counted, totals WHERE {' AND '.join(f'f{i} > 0' for i in range(len(prefixes)))})"""


_USABLE = "vector IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


@query("AGG-9", sql=f"WITH tokens AS (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(*) AS tf FROM tokens GROUP BY term")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_statistics(table(spark, sf_dir, "documents"), fold=False, columns=("text",)).select("term", "tf")


@query("AGG-9", sql=f"WITH tokens AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_statistics(table(spark, sf_dir, "documents"), fold=False, columns=("text",)).select("term", "df")


@query("AGG-9", sql=f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS mean, max(len({_TOKENS.format('text')})) AS longest FROM documents")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.size(scalar.words(F.col("text"), fold=False)).cast("long")
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.max(d).alias("longest"))


@query("AGG-9", "FLT-5", sql=f"WITH {_bm25(['photo'])} SELECT id, score FROM scored")
def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "chunks"), ["photo"], fold=False).select("id", F.round("score", 6).alias("score"))


@query("AGG-9", "FLT-5", "SRT-2", "JON-3", sql=f"WITH {_bm25(['report', 'extract', 'for'])} SELECT id, score, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM scored QUALIFY rank < 5000")
def bm25_and_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bm25(table(spark, sf_dir, "chunks"), ["report", "extract", "for"], fold=False).select("id", F.round("score", 6).alias("score"))
    first = scored.orderBy("score", "id").limit(5000)
    return first.withColumn("rank", (F.row_number().over(Window.orderBy("score", "id")) - 1).cast("long"))  # of at most 5,000 rows


@query("AGG-9", "FLT-5", sql=f"WITH {_bm25(['folder', 'old'])} SELECT id, score FROM scored")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by postings written once."""
    return LexicalIndex.build(table(spark, sf_dir, "chunks"), fold=False).search(["folder", "old"]).select("id", F.round("score", 6).alias("score"))


@query("FLT-5", sql="SELECT id, 0.0::DOUBLE AS score FROM chunks WHERE false")
def bm25_empty_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "chunks"), ["photo", "!!!"], fold=False)


_NAMES = """named AS (SELECT *, row_number() OVER (ORDER BY modified DESC NULLS LAST, id) - 1 AS rank FROM files WHERE contains(lower(name), '{0}') OR contains(lower(path), '{0}') QUALIFY rank < 5000),
names AS (SELECT id AS file_id, 1.0 / (60 + rank) + CASE WHEN lower(name) = '{0}' THEN 1.0 WHEN contains(lower(name), '{0}') THEN 0.3 ELSE 0.1 END AS part FROM named WHERE online{1})"""


@query("SRT-1", "WIN-1", "SCL-5", "SCL-22", "FLT-4", sql=f"WITH {_NAMES.format('readme.md', '')} SELECT file_id, round(part, 6) AS part FROM names")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_list(table(spark, sf_dir, "files"), "README.md", Filters()).select("file_id", F.round("part", 6).alias("part"))


_LEX = """ranked AS (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM scored QUALIFY rank < 5000),
hits AS (SELECT r.file_id, r.id AS chunk_id, r.rank FROM ranked r JOIN files f ON f.id = r.file_id WHERE f.online),
best AS (SELECT file_id, min(rank) AS rank, arg_min(chunk_id, rank) AS chunk_id FROM hits GROUP BY file_id)"""


@query("SCL-23", "AGG-10", "JON-5", "JON-6", "WIN-2", sql=f"""WITH {_bm25(['shared', 'folder'])}, {_LEX}
SELECT b.file_id, round(1.0 / (60 + b.rank) + CASE WHEN contains(lower(c.text), 'shared folder') THEN 0.2 ELSE 0 END, 6) AS part FROM best b JOIN chunks c ON c.id = b.chunk_id""")
def phrase_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _ = lexical_list(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), '"shared folder"', Filters(), fold=False)
    return best.select("file_id", F.round("part", 6).alias("part"))


@query("AGG-11", sql=f"""WITH {_bm25(['shared', 'folder'])}, {_LEX} SELECT file_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM hits GROUP BY file_id""")
def rrf_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = lexical_list(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), "shared folder", Filters(), fold=False)
    return hits.groupBy("file_id").agg(F.round(F.sum(scalar.rrf(F.col("rank"))), 6).alias("fused"))


_DEFAULT = "firsts AS (SELECT file_id, arg_min(id, (seq, id)) AS chunk_id FROM chunks GROUP BY file_id)"


def _fused(lists: str, matches: str, limit: int) -> str:
    return f"""{lists},
fused AS (SELECT file_id, sum(n) AS filename, sum(l) AS lexical, sum(s) AS semantic, max(cosine) AS cosine, round(sum(n) + sum(l) + sum(s), 6) AS score FROM parts GROUP BY file_id),
top AS (SELECT u.*, f.name, f.path FROM fused u JOIN files f ON f.id = u.file_id ORDER BY score DESC, f.modified DESC NULLS LAST, file_id LIMIT {limit}),
{matches},
listed AS (SELECT file_id, list(chunk_id ORDER BY o, q, r, chunk_id)[1:3] AS m FROM (SELECT file_id, chunk_id, min((o, q, r)) AS k, min(o) AS o, arg_min(q, (o, q, r)) AS q, arg_min(r, (o, q, r)) AS r FROM allhits GROUP BY file_id, chunk_id) GROUP BY file_id),
defaults AS (SELECT file_id, [chunk_id] AS m FROM firsts)
SELECT t.file_id, t.name, t.path, t.score, round(t.filename, 6) AS filename, round(t.lexical, 6) AS lexical, round(t.semantic, 6) AS semantic, round(t.cosine, 6) AS cosine,
array_to_string(coalesce(l.m, d.m), ',') AS matches FROM top t LEFT JOIN listed l ON l.file_id = t.file_id LEFT JOIN defaults d ON d.file_id = t.file_id"""


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("matches", F.array_join(F.col("matches").cast("array<string>"), ","))


EXACT = (
    f"""WITH {_bm25(['report'])}, {_NAMES.format('report', " AND lower(extension) IN ('txt')")},
{_LEX.replace('WHERE f.online', "WHERE f.online AND lower(f.extension) = 'txt'")},
{_DEFAULT}, parts AS (SELECT file_id, part AS n, 0e0 AS l, 0e0 AS s, NULL::DOUBLE AS cosine FROM names UNION ALL SELECT file_id, 0e0, 1.0 / (60 + rank), 0e0, NULL FROM best),
"""
    + _fused("dummy AS (SELECT 1)", "allhits AS (SELECT file_id, chunk_id, 0 AS o, 0 AS q, rank AS r FROM hits)", 100)
)


@query("FLT-1", "FLT-2", "AGG-10", "AGG-11", "SET-1", "SRT-4", "WIN-3", "JON-11", sql=EXACT)
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and texts, in exact mode with a filter."""
    return _shown(search(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), Request("report ext:txt", "exact"), fold=False))


@query("FLT-5", "AGG-9", "JON-3", sql=EXACT)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, its words looked up in postings."""
    chunks = table(spark, sf_dir, "chunks")
    index = LexicalIndex.build(chunks, fold=False)
    return _shown(search(table(spark, sf_dir, "files"), chunks, Request("report ext:txt", "exact"), fold=False, index=index))


_Q = f"(SELECT file_id FROM chunks WHERE {_USABLE} AND namespace = 'general' ORDER BY id LIMIT 1)"
_SEM = f"""asked AS (SELECT row_number() OVER (ORDER BY seq, id) - 1 AS qseq, namespace AS qns, vector::DOUBLE[] AS q FROM chunks WHERE vector IS NOT NULL AND file_id = {_Q} ORDER BY seq, id LIMIT 64),
near AS (SELECT qseq, c.id, c.file_id, round(list_cosine_similarity(c.vector::DOUBLE[], q), 6) AS cosine FROM (SELECT * FROM chunks WHERE {_USABLE}) c JOIN (SELECT * FROM asked WHERE len(q) = 128 AND len(list_filter(q, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(q, lambda x: x <> 0)) > 0) ON namespace = qns),
nearest AS (SELECT *, row_number() OVER (PARTITION BY qseq ORDER BY cosine DESC, id) - 1 AS rank FROM near QUALIFY rank < {{0}}),
shits AS (SELECT n.file_id, n.id AS chunk_id, n.qseq, n.rank, n.cosine FROM nearest n JOIN files f ON f.id = n.file_id WHERE f.online),
sbest AS (SELECT file_id, min((qseq, rank)) AS k, arg_min(rank, (qseq, rank)) AS rank, arg_min(cosine, (qseq, rank)) AS cosine FROM shits GROUP BY file_id)"""


def _asking(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, list[float]]]:
    """The vectors of the file of the first usable general vector."""
    chunks = table(spark, sf_dir, "chunks")
    usable = scalar.usable_vector(F.col("vector"), 128) & (F.col("namespace") == "general")
    first = chunks.where(usable).orderBy("id").select("file_id").limit(1).collect()
    return file_queries(chunks, first[0]["file_id"]) if first else []


@query(
    "AGG-10", "AGG-11", "SET-1", "SRT-4", "VEC-4", "JON-11", "STR-15",
    sql=f"""WITH {_bm25(['photos'])}, {_NAMES.format('photos', '')}, {_LEX}, {_SEM.format(800)}, {_DEFAULT},
parts AS (SELECT file_id, part AS n, 0e0 AS l, 0e0 AS s, NULL::DOUBLE AS cosine FROM names UNION ALL SELECT file_id, 0e0, 1.0 / (60 + rank), 0e0, NULL FROM best
 UNION ALL SELECT file_id, 0e0, 0e0, 1.2 / (60 + rank), cosine FROM sbest),
"""
    + _fused("dummy AS (SELECT 1)", "allhits AS (SELECT file_id, chunk_id, 0 AS o, 0 AS q, rank AS r FROM hits UNION ALL SELECT file_id, chunk_id, 1, qseq, rank FROM shits)", 100),
)
def search_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three lists: names, texts, and what is similar to a file."""
    found = search(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), Request("photos"), _asking(spark, sf_dir), fold=False)
    return _shown(found)


@query(
    "SRC-14", "JON-2", "VEC-4", "SRT-11",
    sql=f"""WITH {_SEM.format(256)}, {_DEFAULT}, parts AS (SELECT file_id, 0e0 AS n, 0e0 AS l, 1.2 / (60 + rank) AS s, cosine FROM sbest),
"""
    + _fused("dummy AS (SELECT 1)", "allhits AS (SELECT file_id, chunk_id, 1 AS o, qseq AS q, rank AS r FROM shits)", 20),
)
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files similar to a file, by its own vectors."""
    request = Request("", "semantic", results_count=20)
    return _shown(search(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), request, _asking(spark, sf_dir)))


@query("FLT-16", "SRT-4", sql=f"""WITH {_NAMES.format('', " AND kind = 'code'")}, {_DEFAULT}, hits AS (SELECT 1),
parts AS (SELECT file_id, part AS n, 0e0 AS l, 0e0 AS s, NULL::DOUBLE AS cosine FROM names),
""" + _fused("dummy AS (SELECT 1)", "allhits AS (SELECT file_id, chunk_id, 0 AS o, 0 AS q, 0 AS r FROM firsts)", 50).replace("[1:3]", "[1:1]"))
def search_filters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of filters alone lists everything that passes, the newest first."""
    return _shown(search(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), Request("type:code", results_count=50)))


@query(
    "VEC-1", "VEC-2", "VEC-3", "VEC-5", "SRT-3", "JON-14",
    sql="""WITH q AS (SELECT vec_id AS qseq, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT qseq, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q)
SELECT qseq, vec_id, cosine, row_number() OVER (PARTITION BY qseq ORDER BY cosine DESC, vec_id) - 1 AS rank FROM near QUALIFY rank < 20""",
)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks, against all."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    return nearest_of(e, asked, 20, key="vec_id", vector="embedding", namespace=None, asked_by="vec_id").withColumn("rank", F.col("rank").cast("long"))


@query("VEC-2", "VEC-6", "JON-14", sql=f"WITH {_SEM.format(50)} SELECT qseq, id, cosine, rank FROM nearest")
def knn_namespaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "chunks"), _asking(spark, sf_dir), 50).withColumn("rank", F.col("rank").cast("long"))


@query("VEC-1", "SNK-7", "VEC-2", sql=f"WITH {_SEM.format(50)} SELECT qseq, id, cosine, rank FROM nearest")
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index by cells, written once; as many cells are read as there are, so nothing is missed."""
    chunks = table(spark, sf_dir, "chunks").select("id", "namespace", "vector")
    cells = Cells.of(chunks)
    placed = materialize(cells.placed(chunks).where("cell IS NOT NULL").repartitionByRange("cell").sortWithinPartitions("cell", "id"), "cells")
    asked = _asking(spark, sf_dir)
    some = placed.where(F.col("cell").isin(cells.near(asked, 1 << 20)))
    return nearest(some, asked, 50).withColumn("rank", F.col("rank").cast("long"))


@query("VEC-3", "VEC-4", "WIN-2", sql=f"WITH {_SEM.format(256)} SELECT file_id, round(1.2 / (60 + rank), 6) AS part, cosine FROM sbest")
def knn_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _ = semantic_list(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), _asking(spark, sf_dir), Filters(), False, 256)
    return best.select("file_id", F.round("part", 6).alias("part"), "cosine")


@query("SCL-6", "VEC-5", sql="""SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, len(v) AS dimensions
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings))""")
def truncated_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", scalar.unit_vector(F.col("embedding"), 32).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("v").cast("long").alias("dimensions"))


@query("SCL-7", sql="""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("f"), (F.col("vec_id") - 1).alias("vec_id"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id_a"), "id_b", F.round(scalar.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))
