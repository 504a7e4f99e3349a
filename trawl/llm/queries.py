"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import language, lookalike, mixing, mojibake, neardup, neighbours, sentences, splitting, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors"))


def p1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of every chunk whose id is divisible by 100, of any cosine, against all rows."""
    found = neighbours.neighbours(
        table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors"), every=100, pivots=256, lists=4, probes=72, rerank=1024
    )
    return found.select("id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "chunks"))
    return pieces.where("piece_no = 0").select(F.col("id").alias("chunk_id"), "boundary")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks")).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = language.relabel(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_labels"))
    return made.where(~F.col("agrees")).select(F.col("id").alias("chunk_id"), "seg_no", "lang")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = language.relabel(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_labels"))
    return made.select(F.col("id").alias("chunk_id"), "seg_no", "lang", F.round("confidence", 4).alias("confidence"), "line_from", "line_to")


#: What TESTDATA.md asks for.
_NEAR = {"words": 3, "threshold": 0.7, "least_words": 40}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked_rows(*neardup.near_duplicates(table(spark, sf_dir, "chunks"), **_NEAR))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each chunk that has copies or near copies, with its group."""
    return neardup.near_duplicate_groups(table(spark, sf_dir, "chunks"), **_NEAR)


def _texts_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk_text").alias("field"), "id", F.col("text").alias("value"))
    return chunks.unionByName(table(spark, sf_dir, "files").select(F.lit("file_name").alias("field"), "id", F.col("name").alias("value")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alikes(_texts_and_names(spark, sf_dir))


def p5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common form of every text and name that isn't blank."""
    return lookalike.normalised(_texts_and_names(spark, sf_dir)).select("field", "id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(_texts_and_names(spark, sf_dir))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled texts and names with what could be restored."""
    return mojibake.restored(_texts_and_names(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the texts must come back."""
    return tokens.decode_corpus(p8_ids(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix that was made: sources used as often as they may be, whose tokens are still too few."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    report = mixing.report(documents, table(spark, sf_dir, "mix_targets"))
    return report.where(~F.col("reaches") & (F.col("used_tokens") == F.col("max_repeats") * F.col("tokens"))).select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(documents, table(spark, sf_dir, "mix_targets"))[0].select("doc_id", "source", "copy_no", "n_tokens", "text")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.report(documents, table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, "documents"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, "documents"), with_text=True)


_P2 = """
WITH sized AS (
  SELECT id AS chunk_id, text, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS words, string_split(text, chr(10)) AS lines FROM chunks
)
SELECT chunk_id, CASE
  WHEN list_max(list_transform(lines, lambda x: length(x))) <= 1800
   AND list_max(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\n]+')))) <= 400 THEN 'line'
  WHEN list_max(list_transform(words, lambda x: length(x))) <= 1800 THEN 'space' ELSE 'nospace' END AS boundary
FROM sized WHERE length(text) > 1800 OR len(words) > 400
"""


#: All pairs by brute force, for small tables.
_P1 = """
WITH usable AS (
  SELECT c.id, c.namespace, c.vector::DOUBLE[] AS v FROM chunks c JOIN vectors n ON n.namespace = c.namespace
  WHERE c.vector IS NOT NULL AND len(c.vector) = n.dimensions
    AND len(list_filter(c.vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(c.vector, lambda x: x <> 0)) > 0
),
units AS (SELECT id, namespace, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT)::FLOAT[128] AS u FROM usable),
near AS (SELECT a.id AS a, b.id AS b, array_inner_product(a.u, b.u) AS c FROM units a JOIN units b ON a.namespace = b.namespace AND a.id <> b.id),
top AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM near WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM top WHERE r <= 10
"""
_SETS = """
words AS (SELECT id, text, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS w FROM chunks WHERE text IS NOT NULL),
sets AS (
  SELECT id, md5(text) AS t, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) AS s
  FROM words WHERE len(w) >= 40
),
one AS (SELECT id, t, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m
  FROM one a JOIN one b ON a.x = b.x AND a.id < b.id AND a.t <> b.t GROUP BY 1, 2
),
pairs AS (SELECT id_a, id_b FROM shared WHERE k / (n + m - k) >= 0.7)"""
_P4 = f"WITH {_SETS} SELECT id_a, id_b FROM pairs"
#: Components by following links and copies from every row.
_P4_GROUPS = f"""
WITH RECURSIVE {_SETS},
copies AS (SELECT id, min(id) OVER (PARTITION BY t) AS rep, count(*) OVER (PARTITION BY t) AS copies FROM sets WHERE len(s) > 0),
links AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM pairs p JOIN copies a ON a.id = p.id_a JOIN copies b ON b.id = p.id_b),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, x FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
labels AS (SELECT x, min(y) AS label FROM reach GROUP BY x)
SELECT c.id, coalesce(l.label, c.rep) AS class_id, c.copies FROM copies c LEFT JOIN labels l ON l.x = c.rep WHERE c.copies > 1 OR l.x IS NOT NULL
"""


#: Every look-alike folded to one letter, whatever the word and whether or not the corpus has it: less careful than the
#: operator, with a table of its own (fixed values), and the same pairs.
_P5_FROM = "АВСЕНІЈКМОРЅТХУасеһіјӏорԛѕԝхуԁΑΒΕΗΙΚΜΝΟΡΤΧΥΖονёЁїЇ"
_P5_TO = "ABCEHIJKMOPSTXYacehijlopqswxydABEHIKMNOPTXYZovëËïÏ"
_P5_WIDE = "！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～"
_P5_NARROW = "!\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
_P5_HIDDEN = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}]"
_P5_SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_P5 = f"""
WITH texts AS (
  SELECT 'chunk_text' AS field, id, text AS value FROM chunks WHERE text IS NOT NULL
  UNION ALL SELECT 'file_name', id, name FROM files WHERE name IS NOT NULL
),
plain AS (SELECT *, regexp_replace(regexp_replace(value, '{_P5_HIDDEN}', '', 'g'), '{_P5_SPACES}', ' ', 'g') AS p FROM texts),
forms AS (SELECT field, id, value, nfc_normalize(translate(nfc_normalize(translate(p, '{_P5_WIDE}', '{_P5_NARROW}')), '{_P5_FROM}', '{_P5_TO}')) AS form FROM plain)
SELECT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.form = b.form AND a.id < b.id
WHERE a.value <> b.value AND regexp_matches(a.form, '[^\\s]')
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_knn, p2_found, p2_pieces, p3_found, p3_segments, p4_found, p4_groups, p5_found, p5_normalised, p7_found, p7_restored, p8_ids, p8_decoded, p9_found, p9_mix, p9_shares, p10_found, p10_sentences)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p2_found": _P2, "p4_found": _P4, "p4_groups": _P4_GROUPS, "p5_found": _P5, "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
