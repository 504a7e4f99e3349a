"""Three ranked lists of candidates, fused by reciprocal rank and grouped by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rrf
from ..request import Filters, Request, parse, phrase, terms
from ..runtime import materialize
from .lexical import LexicalIndex, bm25
from .vector import nearest

CANDIDATES = 5000
SEMANTIC_WEIGHT = 1.2
BONUS_EXACT, BONUS_NAME, BONUS_PATH, BONUS_PHRASE = 1.0, 0.3, 0.1, 0.2
MATCHES = 3


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The first CANDIDATES rows with a 0-based rank. They pass through one task, which a fixed number may."""
    first = rows.orderBy(*order).limit(CANDIDATES)
    return first.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def _kept(filters: Filters, show_offline: bool) -> Column:
    return F.coalesce(filters.condition(), F.lit(False)) & (F.lit(show_offline) | F.col("online"))


def name_list(files: DataFrame, text: str, filters: Filters, show_offline: bool = False, filter_first: bool = False) -> DataFrame:
    """``file_id``, ``part``: files whose name or path holds the whole text, the newest first.

    With ``filter_first`` ranks count what passes the filters; else ranks are given before, as an index with a
    fixed candidate list does.
    """
    needle = text.strip('"').lower()
    name, path = F.lower("name"), F.lower("path")
    hit = files.where(F.contains(name, F.lit(needle)) | F.contains(path, F.lit(needle)))
    if filter_first:
        hit = hit.where(_kept(filters, show_offline))
    ranked = _ranked(hit, F.col("modified").desc_nulls_last(), F.col("id"))
    if not filter_first:
        ranked = ranked.where(_kept(filters, show_offline))
    bonus = F.when(name == needle, BONUS_EXACT).when(F.contains(name, F.lit(needle)), BONUS_NAME).otherwise(BONUS_PATH)
    return ranked.select(F.col("id").alias("file_id"), (rrf(F.col("rank")) + bonus).alias("part"))


def lexical_list(
    files: DataFrame, chunks: DataFrame, text: str, filters: Filters, show_offline: bool = False, filter_first: bool = False, fold: bool = True, index: LexicalIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """``file_id``, ``part`` of each file's best chunk, and the hits ``file_id``, ``chunk_id``, ``rank``; from an index if there is one."""
    scored = (index.search(terms(text)) if index else bm25(chunks, terms(text), fold)).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))
    narrow = chunks.select(F.col("id").alias("chunk_id"), "file_id")
    of_file = files.where(_kept(filters, show_offline)).select(F.col("id").alias("file_id"))
    if filter_first:
        scored = scored.join(narrow.join(of_file, "file_id", "left_semi"), "chunk_id")
        hits = _ranked(scored, F.col("score"), F.col("chunk_id"))
    else:
        hits = _ranked(scored, F.col("score"), F.col("chunk_id")).join(narrow, "chunk_id").join(of_file, "file_id", "left_semi")
    hits = materialize(hits.select("file_id", "chunk_id", "rank"), "hits")  # at most CANDIDATES rows, read several times
    best = hits.groupBy("file_id").agg(F.min(F.struct("rank", "chunk_id")).alias("b"))
    quoted = phrase(text)
    if quoted is None:
        bonus = F.lit(0.0)
        joined = best
    else:
        texts = chunks.select(F.col("id").alias("c"), F.lower("text").alias("t"))  # of at most CANDIDATES chunks
        joined = best.join(texts, F.col("b.chunk_id") == F.col("c"), "left")
        bonus = F.when(F.contains(F.col("t"), F.lit(quoted)), BONUS_PHRASE).otherwise(0.0)
    return joined.select("file_id", (rrf(F.col("b.rank")) + bonus).alias("part")), hits


def semantic_list(
    files: DataFrame, chunks: DataFrame, queries: list[tuple[int, str, list[float]]], filters: Filters, show_offline: bool, k: int, vectors: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``file_id``, ``part``, ``cosine`` of each file's first hit, and the hits; earlier queries come first.

    ``vectors``: those of the chunks that are searched (``id``, ``file_id``, ``namespace``, ``vector``), all if not given.
    """
    vectors = chunks if vectors is None else vectors
    of_file = files.where(_kept(filters, show_offline)).select(F.col("id").alias("file_id"))
    hits = nearest(vectors, queries, k).join(vectors.select("id", "file_id"), "id").join(of_file, "file_id", "left_semi")
    hits = materialize(hits.select("file_id", F.col("id").alias("chunk_id"), "qseq", "rank", "cosine"), "near")  # k rows a query
    first = hits.groupBy("file_id").agg(F.min(F.struct("qseq", "rank", "cosine")).alias("h"))
    return first.select("file_id", rrf(F.col("h.rank"), SEMANTIC_WEIGHT).alias("part"), F.col("h.cosine").alias("cosine")), hits


def search(
    files: DataFrame,
    chunks: DataFrame,
    request: Request,
    queries: list[tuple[int, str, list[float]]] | None = None,
    filter_first: bool = False,
    fold: bool = True,
    index: LexicalIndex | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranked files: ``file_id``, ``name``, ``path``, ``score``, its parts, ``cosine`` and up to three ``matches``.

    Modes: ``exact`` leaves out the semantic list, ``semantic`` the other two. ``queries`` are embedded queries
    or another file's vectors; without them there is no semantic list. With an ``index`` texts aren't read for their
    words, with ``vectors`` only those are searched. Ties come by time of change, then id.
    """
    text, filters = parse(request.query, request.filters)
    none = files.select(F.col("id").alias("file_id"), F.lit(0.0).alias("part")).where(F.lit(False))
    parts, matches = [], []
    lists = request.mode != "semantic" and (bool(text) or not queries)
    by_name = name_list(files, text, filters, request.show_offline, filter_first) if lists else none
    parts.append(by_name.select("file_id", F.lit("filename").alias("of"), "part", F.lit(None).cast("double").alias("cosine")))
    if lists and terms(text):
        best, hits = lexical_list(files, chunks, text, filters, request.show_offline, filter_first, fold, index)
        parts.append(best.select("file_id", F.lit("lexical").alias("of"), "part", F.lit(None).cast("double").alias("cosine")))
        matches.append(hits.select("file_id", "chunk_id", F.lit(0).alias("o"), F.lit(0).cast("long").alias("q"), F.col("rank").cast("long").alias("r")))
    if queries and request.mode != "exact":
        k = max(8 * request.results_count, 256)
        best, hits = semantic_list(files, chunks, queries, filters, request.show_offline, k, vectors)
        parts.append(best.select("file_id", F.lit("semantic").alias("of"), "part", "cosine"))
        matches.append(hits.select("file_id", "chunk_id", F.lit(1).alias("o"), F.col("qseq").alias("q"), F.col("rank").cast("long").alias("r")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("of") == name, F.col("part"))), F.lit(0.0))
    fused = rows.groupBy("file_id").agg(
        of("filename").alias("filename"), of("lexical").alias("lexical"), of("semantic").alias("semantic"), F.max("cosine").alias("cosine")
    )
    fused = fused.withColumn("score", F.round(F.col("filename") + F.col("lexical") + F.col("semantic"), 6))
    order = (F.desc("score"), F.col("modified").desc_nulls_last(), F.col("file_id"))
    top = fused.join(files.select(F.col("id").alias("file_id"), "name", "path", "modified"), "file_id").orderBy(*order).limit(request.results_count)
    top = materialize(top, "top")  # at most results_count rows, read twice
    # the join loses the order
    return top.join(_matches(chunks, top.select("file_id"), matches), "file_id", "left").orderBy(*order).select(
        "file_id", "name", "path", "score", *[F.round(c, 6).alias(c) for c in ("filename", "lexical", "semantic", "cosine")], "matches"
    )


def _matches(chunks: DataFrame, top: DataFrame, hits: list[DataFrame]) -> DataFrame:
    """``file_id``, ``matches``: the best chunks, lexical before semantic ones; the file's first chunk if there are none."""
    first = chunks.join(top, "file_id", "left_semi").groupBy("file_id").agg(F.min(F.struct("seq", "id")).alias("f"))
    rows = first.select("file_id", F.col("f.id").alias("chunk_id"), F.lit(2).alias("o"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r"))
    for h in hits:
        rows = rows.unionByName(h.join(top, "file_id", "left_semi"))
    once = rows.groupBy("file_id", "chunk_id").agg(F.min(F.struct("o", "q", "r")).alias("at"))
    # only the default chunk stands where nothing was hit
    lone = F.min("at.o").over(Window.partitionBy("file_id"))
    w = Window.partitionBy("file_id").orderBy("at", "chunk_id")
    kept = once.withColumn("lone", lone).where((F.col("at.o") < 2) | (F.col("lone") == 2)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= MATCHES)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"])  # three of each file
    return kept.groupBy("file_id").agg(listed.alias("matches"))
