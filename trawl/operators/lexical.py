"""Lexical search: prefix terms joined by AND, ranked by BM25 over text and heading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import strip_accents, word_count, words
from ..runtime import materialize

K1, B = 1.2, 0.75


def split_terms(terms: list[str], fold: bool = True) -> list[list[str]]:
    """The tokens of each term. A term of several is a phrase of which the last token is a prefix."""
    import re
    import unicodedata

    def tokens(t: str) -> list[str]:
        t = t.lower()
        if fold:
            t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        return re.findall(r"[^\W_]+", t)

    return [tokens(t) for t in terms]


def instances(tokens: Column, term: list[str]) -> Column:
    """How often a prefix term, or a phrase ending in a prefix, occurs in an array of tokens."""
    if len(term) == 1:
        return F.size(F.filter(tokens, lambda x: F.startswith(x, F.lit(term[0]))))
    n = len(term)

    def here(i: Column) -> Column:
        same = [F.get(tokens, i + k) == term[k] for k in range(n - 1)]
        return reduce(lambda a, b: a & b, [*same, F.startswith(F.get(tokens, i + (n - 1)), F.lit(term[-1]))])

    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    return F.size(F.filter(starts, here))


def bm25(chunks: DataFrame, terms: list[str], fold: bool = True, key: str = "id", columns: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """``key``, ``score`` of the chunks in which every term occurs; lower is better.

    One pass over the texts counts tokens and matches, written as a few numbers for each row; totals and scores
    are made from those. For many searches of one corpus there is :class:`LexicalIndex`.
    A term without any letter or digit matches nothing, and so does the whole query. Null columns are empty.
    """
    split = split_terms(terms, fold)
    if not split or not all(split):
        return chunks.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = {c: words(F.col(c), fold) for c in columns}

    def occurrences(c: str, term: list[str]) -> Column:
        # most texts don't even hold the characters, and are neither cut into words nor searched
        plain = F.lower(F.coalesce(F.col(c), F.lit("")))
        held = F.contains(strip_accents(plain) if fold else plain, F.lit(term[-1]))
        return F.when(held, instances(tokens[c], term)).otherwise(0)

    hits = [reduce(lambda a, b: a + b, [occurrences(c, term) for c in columns]).cast("double").alias(f"f{i}") for i, term in enumerate(split)]
    length = reduce(lambda a, b: a + b, [word_count(F.col(c), fold) for c in columns]).cast("double").alias("d")
    counted = materialize(chunks.select(key, length, *hits), "counted")
    return _score(counted, counted.agg(*_totals(len(split))), len(split), key)


def _totals(n: int) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.avg("d").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)]]


def _score(counted: DataFrame, totals: DataFrame, n: int, key: str) -> DataFrame:
    score = F.lit(0.0)
    for i in range(n):
        f, df = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.log((F.col("rows") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("mean")))
    kept = counted.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(n)]))
    return kept.crossJoin(F.broadcast(totals)).select(key, score.alias("score"))  # one row of totals


def posted(chunks: DataFrame, fold: bool = True, key: str = "id", columns: tuple[str, ...] = ("text", "heading"), carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Postings ``term``, ``id``, ``tf`` and lengths ``id``, ``d`` of chunks, with the columns to carry."""
    tokens = F.concat(*[words(F.col(c), fold) for c in columns])
    rows = chunks.select(F.col(key).alias("id"), *carry, tokens.alias("tokens"))
    postings = rows.select("id", *carry, F.explode("tokens").alias("term")).groupBy("term", "id", *carry).agg(F.count(F.lit(1)).alias("tf"))
    return postings, rows.select("id", *carry, F.size("tokens").cast("double").alias("d"))


class LexicalIndex:
    """Postings ``(term, id, tf)`` sorted by term, and a length for each chunk, written once and searched often.

    A prefix is a range of terms, which Parquet's statistics turn into a few row groups of a few files. Phrases are
    looked up word by word, and only texts that hold all of them are read.
    """

    def __init__(self, postings: DataFrame, lengths: DataFrame, fold: bool, texts: DataFrame | None = None, columns: tuple[str, ...] = ("text", "heading")):
        self.postings, self.lengths, self.fold, self.texts, self.columns = postings, lengths, fold, texts, columns

    @classmethod
    def build(cls, chunks: DataFrame, key: str = "id", columns: tuple[str, ...] = ("text", "heading"), fold: bool = True) -> LexicalIndex:
        postings, lengths = posted(chunks, fold, key, columns)
        postings = materialize(postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")
        return cls(postings, materialize(lengths, "lengths"), fold, chunks.select(F.col(key).alias("id"), *columns), columns)

    def _holding(self, word: str, prefix: bool) -> DataFrame:
        some = (F.col("term") >= word) & (F.col("term") < word + "\U0010ffff") if prefix else F.col("term") == word
        return self.postings.where(some)

    def _phrase(self, term: list[str], name: str) -> DataFrame:
        if self.texts is None:
            raise ValueError("this index has no texts to look for phrases in")
        ids = None
        for i, word in enumerate(term):
            some = self._holding(word, i == len(term) - 1).select("id").distinct()
            ids = some if ids is None else ids.join(some, "id")
        found = reduce(lambda a, b: a + b, [instances(words(F.col(c), self.fold), term) for c in self.columns]).cast("double")
        return self.texts.join(ids, "id", "left_semi").select("id", found.alias(name)).where(F.col(name) > 0)

    def search(self, terms: list[str]) -> DataFrame:
        """``id``, ``score`` as :func:`bm25`."""
        split = split_terms(terms, self.fold)
        if not split or not all(split):
            return self.lengths.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
        counts = None
        for i, term in enumerate(split):
            name = f"f{i}"
            some = self._phrase(term, name) if len(term) > 1 else self._holding(term[0], True).groupBy("id").agg(F.sum("tf").cast("double").alias(name))
            counts = some if counts is None else counts.join(some, "id", "full_outer")
        counts = materialize(counts.na.fill(0.0), "counts")  # of the chunks with any of the terms
        all_rows = self.lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("d").alias("mean"))
        frequency = counts.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(split))])
        kept = counts.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(split))]))
        return _score(kept.join(self.lengths, "id"), all_rows.crossJoin(frequency), len(split), "id")


def term_statistics(chunks: DataFrame, fold: bool = True, columns: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """``term``, ``tf``, ``df`` over all chunks; counted within a chunk first, so a frequent word isn't shuffled as often as it occurs."""
    tokens = F.concat(*[words(F.col(c), fold) for c in columns])
    rows = chunks.select(tokens.alias("tokens")).withColumn("r", F.monotonically_increasing_id())
    per_row = rows.select("r", F.explode("tokens").alias("term")).groupBy("term", "r").agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
