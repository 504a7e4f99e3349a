"""Cutting oversized texts into pieces at natural boundaries.

Every place where a text may be cut has a strength: a line end is stronger than a sentence end, that
stronger than a space, and that stronger than the middle of a word. A sparse table over the strengths
answers which cut is strongest in the window of permitted ends, the rightmost of equals; then the next
piece begins some words further back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^ \t\r\n]+"
LINE, SENTENCE, SPACE, ANY = 4, 3, 2, 1
_SENTENCE_END = re.compile(r"[.!?…؟।]+[)\]}\"'»”’“]*[ \t]+|[。！？]+[」』）”’]*")
_SPACE_END = re.compile(r"[ \t\r]+(?=[^ \t\r\n])")


class StrongestCut:
    """Sparse table for range maxima over cut places; equals go to the right.

    Level j holds for each place i the best of the 2**j places from i on. Levels end with the widest
    window that is ever asked for, so the table stays linear in the text.
    """

    def __init__(self, places: np.ndarray, strengths: np.ndarray, widest: int):
        self.places, self.strengths = places, strengths
        self.levels = [np.arange(len(places), dtype=np.int32)]
        step = 1
        while 2 * step <= min(widest, len(places)):
            left, right = self.levels[-1][:-step], self.levels[-1][step:]
            self.levels.append(np.where(strengths[left] > strengths[right], left, right))
            step *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """The place in [low, high] to cut at and its strength; (-1, 0) if there is none."""
        i, j = np.searchsorted(self.places, [low, high + 1])
        if i >= j:
            return -1, 0
        level = min(int(j - i).bit_length() - 1, len(self.levels) - 1)
        table, width = self.levels[level], 1 << level
        best = -1
        for at in [*range(i, j - width, width), j - width]:
            k = table[at]
            if best < 0 or self.strengths[k] >= self.strengths[best]:
                best = k
        return int(self.places[best]), int(self.strengths[best])


def boundary_class(text: str, max_chars: int, max_words: int) -> str:
    """``line`` if every line keeps both limits, else ``space`` if no word is too long, else ``nospace``."""
    words = re.compile(WORD)
    if all(len(x) <= max_chars and (len(x) <= 2 * max_words or sum(1 for _ in words.finditer(x)) <= max_words) for x in text.split("\n")):
        return "line"
    return "space" if all(m.end() - m.start() <= max_chars for m in words.finditer(text)) else "nospace"


class Splitter:
    """Cuts one text; all offsets are code points."""

    def __init__(self, text: str, max_chars: int, max_words: int, overlap_words: int):
        self.n, self.max_chars, self.max_words, self.overlap = len(text), max_chars, max_words, overlap_words
        spans = np.array([m.span() for m in re.finditer(WORD, text)], np.int64).reshape(-1, 2)
        self.starts, self.ends = spans[:, 0], spans[:, 1]
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        strength = np.zeros(self.n + 1, np.int8)
        for pattern, value in ((_SPACE_END, SPACE), (_SENTENCE_END, SENTENCE)):
            strength[[m.end() for m in pattern.finditer(text)]] = value
        strength[np.nonzero(codes == 10)[0] + 1] = LINE
        strength[[0, self.n]] = 0
        places = np.nonzero(strength)[0]
        self.table = StrongestCut(places, strength[places], max_chars)
        # a mark that belongs to the character before it, or what a joiner joins, isn't cut off
        kinds = {int(c) for c in np.unique(codes) if unicodedata.category(chr(c))[0] == "M"}
        self.tied = np.zeros(self.n + 1, bool)
        self.tied[:-1] = np.isin(codes, list(kinds))
        self.tied[1:] |= codes == 0x200D
        self.tied[1:-1] |= (codes[:-1] == 13) & (codes[1:] == 10)
        self.line_end = strength == LINE

    def limit(self, start: int) -> int:
        """The last permitted end of a piece from ``start``."""
        k = int(np.searchsorted(self.ends, start, "right"))  # the first word that ends behind start
        last = k + self.max_words
        by_words = int(self.starts[last]) if last < len(self.starts) else self.n
        return min(start + self.max_chars, by_words, self.n)

    def cut(self, low: int, high: int) -> tuple[int, int]:
        place, strength = self.table.query(low, high)
        if place >= 0:
            return place, strength
        place = high
        while place > low and self.tied[place]:
            place -= 1
        return (place if not self.tied[place] else high), ANY

    def restart(self, start: int, end: int) -> int:
        """Where the piece after [start, end) begins: about ``overlap`` words back, less where that would cost a better cut."""
        if not self.overlap:
            return end
        k = int(np.searchsorted(self.starts, end, "left"))
        back = int(self.starts[k - self.overlap]) if k >= self.overlap else 0
        floor = max(start + 1, end - self.max_chars // 3)
        if back < floor:  # words too long for that: as many as fit, or part of the only one
            j = int(np.searchsorted(self.starts, floor, "left"))
            back = int(self.starts[j]) if j < len(self.starts) and self.starts[j] < end else floor
            while self.tied[back] and back < end:
                back += 1
        if self.limit(end) < self.n:
            without = self.cut(end + 1, self.limit(end))[1]
        elif self.line_end[end]:
            without = LINE  # the rest is whole lines
        else:
            without = self.cut(end + 1, self.n - 1)[1] if end + 1 < self.n else 0
        if self._reach(back, end) >= without:
            return back
        # the later begin of a word from which that cut can be reached
        later = self.starts[np.searchsorted(self.starts, back) : k]
        lo, hi = 0, len(later)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self._reach(int(later[mid]), end) >= without else (mid + 1, hi)
        return int(later[lo]) if lo < len(later) else end

    def _reach(self, begin: int, end: int) -> int:
        limit = self.limit(begin)
        if limit >= self.n:
            return LINE
        return self.cut(end + 1, limit)[1] if limit > end else 0

    def pieces(self) -> list[tuple[int, int]]:
        out, start, done = [], 0, 0
        while done < self.n:
            high = self.limit(start)
            if high <= done:  # nothing new would fit behind the overlap
                start = done
                high = self.limit(start)
            end = self.n if high >= self.n else self.cut(done + 1, high)[0]
            out.append((start, end))
            start, done = self.restart(start, end), end
        return out


PIECES = "piece_no int, start_char int, end_char int, piece string, line_from int, line_to int"


def split_oversized(
    rows: DataFrame,
    key: str = "id",
    text: str = "text",
    max_chars: int = 1800,
    max_words: int = 400,
    overlap_words: int = 60,
    carry: tuple[str, ...] = ("heading", "page", "line_start"),
) -> DataFrame:
    """Pieces of the texts beyond either limit, and nothing of the others.

    ``key``, ``boundary``, ``piece_no`` from 0, ``start_char``, ``end_char`` (offsets into the text), ``piece``,
    ``heading``, ``page``, ``line_start``, ``line_end``. The pieces cover the text, each keeps both limits and
    goes beyond the one before. Line numbers are null where the item's own is. Null, empty and blank texts
    within the limits give nothing; a row given twice comes out twice. No shuffle: whole texts, one at a time.
    """
    long = F.length(text) > max_chars
    many = (F.length(text) > 2 * max_words) & (F.regexp_count(text, F.lit(WORD)) > max_words)
    big = rows.select(key, F.col(text).alias("__text"), *carry).where(F.col("__text").isNotNull())
    big = big.where(F.length("__text") > min(max_chars, 2 * max_words)).withColumnRenamed("__text", text).where(long | many)

    @F.pandas_udf(f"boundary string, pieces array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            kinds, all_pieces = [], []
            for t in texts:
                kinds.append(boundary_class(t, max_chars, max_words))
                feeds = np.array([m.start() for m in re.finditer("\n", t)], np.int64)
                found = []
                for i, (s, e) in enumerate(Splitter(t, max_chars, max_words, overlap_words).pieces()):
                    first = int(np.searchsorted(feeds, s))
                    last = int(np.searchsorted(feeds, max(s, e - 1)))
                    found.append({"piece_no": i, "start_char": s, "end_char": e, "piece": t[s:e], "line_from": first, "line_to": last})
                all_pieces.append(found)
            yield pd.DataFrame({"boundary": kinds, "pieces": all_pieces})

    cut = big.withColumn("__cut", split(text))
    named = [c for c in carry if c != "line_start"]
    at = F.col("line_start") if "line_start" in carry else F.lit(None).cast("int")
    return cut.select(key, *named, at.alias("__at"), F.col("__cut.boundary").alias("boundary"), F.explode("__cut.pieces").alias("p")).select(
        key,
        "boundary",
        "p.piece_no",
        "p.start_char",
        "p.end_char",
        "p.piece",
        *named,
        (F.col("__at") + F.col("p.line_from")).alias("line_start"),
        (F.col("__at") + F.col("p.line_to")).alias("line_end"),
    )
