"""One form for texts that look the same and differ in their characters.

Width, composition of accents, invisible characters and kinds of space are folded in every text. Letters of
other scripts are put right with care: each word's dominant script is that of its letters that have no
look-alike (those of its line if it has none), look-alikes of other scripts are replaced by that script's
letters, and the result is taken only if the corpus has that word. A word of a single foreign script, all of
look-alikes, is no different from one that is meant so; it is put right only in a text that has a word of mixed
scripts besides, or in a line without any letter that only its script has. What counts for dominance isn't changed by the replacement, so all spellings of a word are judged alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Latin letters and their look-alikes, in the same order (fixed values).
LATIN_CYRILLIC = "ABCEHIJKMOPSTXYacehijlopqswxyd"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеһіјӏорԛѕԝхуԁ"
LATIN_GREEK = "ABEHIKMNOPTXYZov"
GREEK = "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖον"
#: Removed wherever they stand (first and last code point of each range).
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
#: Taken for a plain space.
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SCRIPT_RANGES = (("L", 0x41, 0x24F), ("L", 0x1E00, 0x1EFF), ("G", 0x370, 0x3FF), ("C", 0x400, 0x52F))

_TO = {
    "L": dict(zip(CYRILLIC, LATIN_CYRILLIC)) | dict(zip(GREEK, LATIN_GREEK)),
    "C": dict(zip(LATIN_CYRILLIC, CYRILLIC)),
    "G": dict(zip(LATIN_GREEK, GREEK)),
}
_TO["C"] |= {g: _TO["C"][x] for g, x in zip(GREEK, LATIN_GREEK) if x in _TO["C"]}
_TO["G"] |= {c: _TO["G"][x] for c, x in zip(CYRILLIC, LATIN_CYRILLIC) if x in _TO["G"]}
#: Letters that have a look-alike in another of the scripts.
AMBIGUOUS = frozenset(CYRILLIC) | frozenset(GREEK) | frozenset(LATIN_CYRILLIC) | frozenset(LATIN_GREEK)


def _width_and_spaces() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    # full and half width forms, ligatures of Latin letters, Roman numerals of one code point
    for o in (*range(0xFF00, 0xFFF0), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180)):
        folded = unicodedata.normalize("NFKC", chr(o))
        if folded != chr(o):
            table[o] = folded
    for first, last in SPACES:
        table.update(dict.fromkeys(range(first, last + 1), " "))
    for first, last in INVISIBLE:
        table.update(dict.fromkeys(range(first, last + 1)))
    return table


_FOLD = _width_and_spaces()


def fold(text: str) -> str:
    """Width, spaces, invisible characters and composition; line breaks, case and punctuation stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_FOLD))


def _script(ch: str) -> str:
    o = ord(ch)
    for name, first, last in SCRIPT_RANGES:
        if first <= o <= last:
            return name if ch.isalpha() else ""
    return "O" if ch.isalpha() else ""


_SCRIPT: dict[str, str] = {}


def _counts(word: str) -> tuple[dict[str, int], dict[str, int]]:
    """Letters of each script, all and unambiguous ones, of a decomposed word."""
    every: dict[str, int] = {}
    sure: dict[str, int] = {}
    for ch in word:
        s = _SCRIPT.get(ch)
        if s is None:
            s = _SCRIPT[ch] = _script(ch)
        if s:
            every[s] = every.get(s, 0) + 1
            if ch not in AMBIGUOUS:
                sure[s] = sure.get(s, 0) + 1
    return every, sure


class Repairer:
    """Finds the words of a folded text that may be put right, and how."""

    def __init__(self):
        import regex

        self.word = regex.compile(r"[\p{L}\p{M}]+")
        self.odd = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
        self.seen: dict[str, tuple] = {}

    def _fact(self, word: str) -> tuple:
        f = self.seen.get(word)
        if f is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            split = unicodedata.normalize("NFD", word)
            f = self.seen[word] = (split, *_counts(split))
        return f

    def repair(self, word: str, line_script: str) -> str | None:
        split, every, sure = self._fact(word)
        own = {s for s in every if s in "LCG"}
        if not own or "O" in every:
            return None
        if sure:
            top = max(sure.values())
            best = [s for s in sure if sure[s] == top]
            if len(best) > 1 or best[0] not in "LCG":
                return None
            target = best[0]
        else:
            target = line_script
        if own == {target} or target not in _TO:
            return None
        out = []
        for ch in split:
            s = _SCRIPT.get(ch, "")
            if s and s != target:
                ch = _TO[target].get(ch, "")
                if not ch:
                    return None
            out.append(ch)
        return unicodedata.normalize("NFC", "".join(out))

    def sure_letters(self, words: list[str]) -> dict[str, int]:
        """How many letters each script has that are no look-alikes."""
        total: dict[str, int] = {}
        for w in words:
            for s, n in self._fact(w)[2].items():
                if s in "LCG":
                    total[s] = total.get(s, 0) + n
        return total

    def mixed(self, word: str) -> bool:
        """Whether a word has letters of several of the scripts."""
        return sum(s in "LCG" for s in self._fact(word)[1]) > 1

    def of_lines(self, text: str) -> list[dict[str, str]]:
        """For each line the words that may be put right, and what they become."""
        lines = [self.word.findall(line) if self.odd.search(line) else [] for line in text.split("\n")]
        among = any(self.mixed(w) for words in lines for w in words)
        out = []
        for words in lines:
            sure = self.sure_letters(words)
            script = max(sorted(sure, reverse=True), key=sure.get) if sure else "L"
            fixed = {w: self.repair(w, script) for w in set(words) if among or not any(s in sure for s in self._fact(w)[1])}
            out.append({w: r for w, r in fixed.items() if r is not None and r != w})
        return out

    def repairs(self, text: str) -> set[tuple[str, str]]:
        if text.isascii() or not self.odd.search(text):
            return set()
        return {x for found in self.of_lines(text) for x in found.items()}

    def apply(self, text: str, accepted: set[tuple[str, str]]) -> str:
        def put(line: str, found: dict[str, str]) -> str:
            return self.word.sub(lambda m: found[m[0]] if (m[0], found.get(m[0])) in accepted else m[0], line) if found else line

        return unicodedata.normalize("NFC", "\n".join(map(put, text.split("\n"), self.of_lines(text))))


def folded(values: DataFrame) -> DataFrame:
    """``field``, ``id``, ``vkey``, ``text`` (folded), ``repairs``; null and blank values are left out."""

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        repairer = Repairer()
        pair = pa.list_(pa.struct([("word", pa.string()), ("fixed", pa.string())]))
        for b in batches:
            fields, ids, keys, texts, repairs = [], [], [], [], []
            for field, i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = fold(value)
                if not text.strip():
                    continue
                fields.append(field)
                ids.append(i)
                keys.append(hashlib.md5(value.encode()).digest())
                texts.append(text)
                repairs.append([{"word": w, "fixed": r} for w, r in sorted(repairer.repairs(text))] or None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields, pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(repairs, pair)],
                ["field", "id", "vkey", "text", "repairs"],
            )

    return (
        values.select("field", F.col("id").cast("long"), "value")
        .where("id IS NOT NULL AND value IS NOT NULL")
        .mapInArrow(fold_all, "field string, id long, vkey binary, text string, repairs array<struct<word:string,fixed:string>>")
    )


def accepted_repairs(rows: DataFrame) -> DataFrame:
    """``word``, ``fixed``: those whose result the corpus has as a word."""
    wanted = rows.where("repairs IS NOT NULL").select(F.explode("repairs").alias("r")).select("r.word", "r.fixed").distinct()
    wanted = materialize(wanted, "repairs")
    # distinct within a text and on the map side before the words of the corpus are shuffled
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))).alias("fixed")).distinct()
    return wanted.join(words, "fixed").select("word", "fixed")


def normalised(values: DataFrame) -> DataFrame:
    """``field``, ``id``, ``vkey``, ``ckey`` (of the common form), ``text`` (the common form) of every value that isn't blank."""
    rows = materialize(folded(values), "folded")
    accepted = accepted_repairs(rows)
    # only the texts with a word to put right go through this, each distinct one once
    odd = rows.where("repairs IS NOT NULL").groupBy("vkey").agg(F.first("text").alias("text"), F.first("repairs").alias("repairs"))
    chosen = odd.select("vkey", F.explode("repairs").alias("r")).select("vkey", "r.word", "r.fixed").join(accepted, ["word", "fixed"])
    by_text = chosen.groupBy("vkey").agg(F.collect_set(F.struct("word", "fixed")).alias("chosen"))  # words of one text

    @F.pandas_udf("string")
    def apply(text, repairs):
        import pandas as pd

        r = Repairer()
        return pd.Series([r.apply(t, {(p["word"], p["fixed"]) for p in c}) for t, c in zip(text, repairs)])

    fixed = materialize(odd.join(by_text, "vkey").select("vkey", apply("text", "chosen").alias("fixed")), "fixed")
    joined = rows.select("field", "id", "vkey", "text").join(fixed, "vkey", "left")
    return joined.select("field", "id", "vkey", F.coalesce("fixed", "text").alias("text"))


def look_alikes(values: DataFrame) -> DataFrame:
    """``field``, ``id_a`` < ``id_b``: rows of one field whose values differ and have the same common form.

    ``values``: ``field``, ``id``, ``value``. Copies of a value form a class; pairs are made between classes and
    then spelled out, so no copies are paired with each other, however many there are.
    """
    keys = normalised(values).select("field", "id", "vkey", F.md5(F.encode("text", "utf-8")).alias("ckey"))
    keys = materialize(keys, "forms").distinct()
    classes = keys.select("field", "ckey", "vkey").distinct()
    several = classes.groupBy("field", "ckey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field", "ckey")
    classes = materialize(classes.join(several, ["field", "ckey"]), "classes")
    a = classes.withColumnRenamed("vkey", "va")
    b = classes.withColumnRenamed("vkey", "vb")
    pairs = a.join(b, ["field", "ckey"]).where("va < vb").select("field", "va", "vb")
    members = keys.select("field", "id", "vkey").join(classes.select("field", "vkey"), ["field", "vkey"], "left_semi")
    left = members.withColumnsRenamed({"id": "x", "vkey": "va"})
    right = members.withColumnsRenamed({"id": "y", "vkey": "vb"})
    out = pairs.join(left, ["field", "va"]).join(right, ["field", "vb"]).where("x <> y")
    return out.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
