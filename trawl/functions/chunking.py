"""Cutting extracted text and code into chunks: whole lines, greedily, with an overlap of whole lines."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_CHARS, OVERLAP_WORDS = 400, 1800, 60
CHUNK = "seq int, text string, heading string, line_start int, line_end int, hash string"


def _lines(text: str) -> list[str]:
    """Lines without their ends; a last end begins no line."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def text_chunks(text: str | None) -> list[tuple[str, str, int, int]]:
    """Text, heading and 1-based inclusive line range of each chunk.

    A chunk takes its first line whatever its length and more lines while 400 words and 1,800 characters hold;
    what is longer is cut into pieces of 1,800 characters under the same heading. The next chunk begins up to
    60 words back, by whole lines, and at least one line further than the last.
    """
    lines = _lines(text or "")
    counts = [(len(x.split()), len(x)) for x in lines]
    out, start = [], 0
    while start < len(lines):
        end, n_words, n_chars = start + 1, *counts[start]
        while end < len(lines) and n_words + counts[end][0] <= MAX_WORDS and n_chars + counts[end][1] <= MAX_CHARS:
            n_words, n_chars, end = n_words + counts[end][0], n_chars + counts[end][1], end + 1
        body = "\n".join(lines[start:end])
        if body.strip():
            head = lines[start].lstrip("#")[:100]
            out += [(body[i : i + MAX_CHARS], head, start + 1, end) for i in range(0, len(body), MAX_CHARS)]
        if end >= len(lines):
            break
        back, shared = end, 0
        while shared < OVERLAP_WORDS and back > start + 1:
            back -= 1
            shared += counts[back][0]
        start = back
    return out


#: What begins a top-level definition, by extension (fixed values).
DEFINITIONS = {
    "rs": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\S+\s+)*(?:fn|struct|enum|trait|impl|mod|static|type|macro_rules!|union)\b",
    "js": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|class\b|const\b|let\b|var\b)",
    "ts": r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|const\b|let\b|var\b|interface\b|type\b|enum\b|namespace\b)",
}
DEFINITIONS |= {"jsx": DEFINITIONS["js"], "tsx": DEFINITIONS["ts"]}
_LEADING = re.compile(r"\s*(?://|/\*|\*|#\[|@|\"\"\")")


def _python_parts(text: str) -> list[tuple[int, str]]:
    """0-based first line and text of each top-level statement and each comment between them, in order."""
    try:
        nodes = ast.parse(text).body
        comments = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return []
    lines = text.splitlines(keepends=True)
    wide = [x.encode() for x in lines]  # the tree's columns are bytes
    spans = []
    for n in nodes:
        first = min([n, *getattr(n, "decorator_list", [])], key=lambda x: x.lineno)
        column = first.col_offset - (first is not n)  # a decorator's place is behind its mark
        spans.append(((first.lineno - 1, len(wide[first.lineno - 1][:column].decode())), (n.end_lineno - 1, len(wide[n.end_lineno - 1][: n.end_col_offset].decode()))))
    begins = [x[0] for x in spans]
    for t in comments:
        at, to = (t.start[0] - 1, t.start[1]), (t.end[0] - 1, t.end[1])
        k = bisect_right(begins, at) - 1
        inside = k >= 0 and at < spans[k][1]
        # what is set in under a definition belongs to it, also behind its last statement
        under = k >= 0 and k < len(nodes) and at[1] > 0 and not lines[at[0]][: at[1]].strip()
        if not inside and not under:
            spans.append((at, to))
    out = []
    for (r, c), (q, d) in sorted(spans):
        body = lines[r][c:d] if r == q else "".join([lines[r][c:], *lines[r + 1 : q], lines[q][:d]])
        out.append((r, body))
    return out


def _definitions(text: str, extension: str) -> list[tuple[int, str]]:
    """0-based first line and text of each top-level part; in languages cut by their definitions comments go with what follows."""
    if extension == "py":
        return _python_parts(text)
    if extension not in DEFINITIONS:
        return []
    lines = _lines(text)
    begins = [i for i, x in enumerate(lines) if re.match(DEFINITIONS[extension], x)]
    cuts = []
    for i in begins:
        while i > 0 and lines[i - 1].strip() and _LEADING.match(lines[i - 1]) and not lines[i - 1].startswith((" ", "\t", "}")):
            i -= 1
        cuts.append(i)
    if cuts and cuts[0] > 0:
        cuts.insert(0, 0)
    return [(a, "\n".join(lines[a:b])) for a, b in zip(cuts, [*cuts[1:], len(lines)])]


def code_chunks(text: str | None, extension: str) -> list[tuple[str, str, int, int]]:
    """Chunks of each top-level part, line numbers of the file; :func:`text_chunks` for other languages.

    All chunks of a part have its first line as their heading.
    """
    out = []
    for first_line, part in _definitions(text or "", extension):
        head = next(iter(_lines(part)), "")[:120]
        out += [(body, head, first_line + first, first_line + last) for body, _, first, last in text_chunks(part)]
    return out or text_chunks(text)


def chunked(rows: DataFrame, text: str = "text", modality: Column | None = None, extension: Column | None = None) -> DataFrame:
    """The other columns of ``rows`` with each chunk's ``seq``, ``text``, ``heading``, lines and ``hash``.

    Null, empty and blank texts have no chunk. A text is cut where it lies; nothing is shuffled.
    """
    from hashlib import sha256

    @F.pandas_udf(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds, extensions in batches:
            out = []
            for t, m, e in zip(texts, kinds, extensions):
                made = code_chunks(t, e or "") if m == "code" else text_chunks(t)
                out.append(
                    [
                        {"seq": i, "text": x, "heading": h, "line_start": a, "line_end": b, "hash": sha256(x.encode()).hexdigest()}
                        for i, (x, h, a, b) in enumerate(made)
                    ]
                )
            yield pd.Series(out)

    kept = [c for c in rows.columns if c != text]
    none = F.lit(None).cast("string")
    cut = cut.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    made = rows.select(*kept, cut(F.col(text), modality if modality is not None else none, extension if extension is not None else none).alias("__c"))
    return made.select(*kept, F.inline("__c"))


def segments(rows: DataFrame, duration: str, seconds: float, overlap: float = 5.0) -> DataFrame:
    """``start_sec`` and ``end_sec`` of media segments that overlap; the last one ends with the item.

    Nulls and durations that aren't positive have no segment.
    """
    d = F.col(duration).cast("double")
    step = seconds - overlap
    last = F.greatest(F.ceil((d - seconds) / step), F.lit(0)).cast("int")
    at = F.explode(F.sequence(F.lit(0), last))
    return (
        rows.where(d > 0)
        .select("*", at.alias("seq"))
        .withColumn("start_sec", F.col("seq") * F.lit(step))
        .withColumn("end_sec", F.least(F.col("start_sec") + seconds, d))
    )
