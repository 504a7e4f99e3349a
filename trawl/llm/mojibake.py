"""Texts read with a wrong character encoding: which they are, and what they were.

For every distinct clean word of the corpus its garbled forms are made under all encoding chains: written in
an encoding and read in another, once or twice. The words of the documents are joined with that table by
hash. A match is verified by garbling the original again. A word that looks odd marks its document; of words
that look clean, as Hebrew read as Cyrillic does, the original must be in far more different texts, and the word be
long or two match in one row under one chain. The original is put in the place of the match. Scripts without spaces have no words to look up; there the garbled forms of short sequences
of characters are made, and all windows of an odd run are joined. Odd words that match nothing, as their originals are
nowhere clean, tell by themselves where they hold a replacement character or where a chain written in UTF-8 reads
them back to a clean word that garbles to them. In a document so found, other odd words are read back by the
chain of their neighbours.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, partitions
from .lookalike import AMBIGUOUS

#: Encodings a text may have been written in, by script, and those it may have been read in.
WRITTEN = {
    "LATIN": ("utf-8", "cp1252", "cp850", "mac_roman", "cp1250", "cp1254"),
    "GREEK": ("utf-8", "cp1253"),
    "CYRILLIC": ("utf-8", "cp1251", "koi8_r", "cp866", "iso8859_5"),
    "HEBREW": ("utf-8", "cp1255"),
    "ARABIC": ("utf-8", "cp1256"),
    "DEVANAGARI": ("utf-8",),
    "THAI": ("utf-8", "cp874"),
    "CJK": ("utf-8", "gbk", "euc_jp", "shift_jis", "big5"),
    "HANGUL": ("utf-8", "cp949"),
}
READ = ("cp1252", "latin_1", "cp1251", "cp1255", "cp850", "cp437", "cp1250", "cp1253", "cp1254", "cp1256", "koi8_r", "cp866", "mac_roman", "utf-8")
#: How UTF-8 may have been read twice.
TWICE = (*((r, r) for r in READ if r != "utf-8"), ("cp1252", "latin_1"), ("latin_1", "cp1252"))
#: Characters of a window's original in scripts without spaces.
UNIT = {"CJK": 2, "THAI": 4}
#: Code points of a window of garbled text: from what tells anything to four characters of three bytes garbled twice.
WINDOWS = range(3, 37)
#: Of windows of other encodings than UTF-8: a unit's characters have one or two bytes there.
LEGACY = (3, 4)
REPLACED = "�"
#: A run of ASCII letters and other characters but spaces and invisible ones; one of them isn't ASCII.
RUN = re.compile(r"[A-Za-z]*[\x80-῿‎‏‐-‧‰-⁞⁰-⿿、-﻾＀-\U0010ffff][A-Za-z\x80-῿‎‏‐-‧‰-⁞⁰-⿿、-﻾＀-\U0010ffff]*")


def _byte_map(encoding: str) -> list[str]:
    """What each byte reads as; bytes that an encoding leaves open read as the control of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_MAPS = {e: "".join(_byte_map(e)) for e in READ if e != "utf-8"}
_BACK = {e: {c: b for b, c in reversed(list(enumerate(m)))} for e, m in _MAPS.items()}


def read_as(data: bytes, encoding: str) -> str:
    if encoding == "utf-8":
        return data.decode("utf-8", "replace")
    return codecs.charmap_decode(data, "strict", _MAPS[encoding])[0]


def bytes_of(text: str, encoding: str) -> bytes | None:
    """The bytes that read as ``text``; None if there are none."""
    back = _BACK[encoding]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def chains(script: str) -> list[tuple[str, ...]]:
    """Written, read, written, read ... in pairs; a second pair is UTF-8 read twice."""
    out = [(w, r) for w in WRITTEN.get(script, ("utf-8",)) for r in READ if w != r]
    return out + [("utf-8", r, "utf-8", again) for r, again in TWICE]


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """``text`` under a chain; None where it can't be written in an encoding."""
    for w, r in zip(chain[::2], chain[1::2]):
        try:
            text = read_as(text.encode(w), r)
        except UnicodeEncodeError:
            return None
    return text


def garbled_under(word: str, chains_: list[tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The garbled forms of a word, each with the first chain that makes it; what chains share is made once."""
    written: dict[str, bytes | None] = {}
    once: dict[tuple[str, ...], str | None] = {}
    forms: dict[str, tuple[str, ...]] = {}
    for chain in chains_:
        w, r = chain[:2]
        if w not in written:
            try:
                written[w] = word.encode(w)
            except UnicodeEncodeError:
                written[w] = None
        if written[w] is None:
            continue
        g = once.get((w, r))
        if g is None:
            g = once[w, r] = read_as(written[w], r)
        if len(chain) > 2:
            g = garble(g, chain[2:])
        if g is not None and g != word and not g.isascii():
            forms.setdefault(g, chain)
    return forms


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text that garbles to ``text`` under the chain; None where there is none, or more than one could be."""
    whole = text
    for w, r in zip(chain[-2::-2], chain[::-2]):
        if r == "utf-8":
            return None
        data = bytes_of(text, r)
        if data is None:
            return None
        try:
            text = data.decode(w)
        except UnicodeDecodeError:
            return None
    return text if garble(text, chain) == whole else None


def script_of(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "LATIN" if ch.isalpha() else ""
    for name, first, last in (
        ("GREEK", 0x370, 0x3FF),
        ("CYRILLIC", 0x400, 0x52F),
        ("HEBREW", 0x590, 0x5FF),
        ("ARABIC", 0x600, 0x6FF),
        ("DEVANAGARI", 0x900, 0x97F),
        ("THAI", 0xE00, 0xE7F),
        ("CJK", 0x3040, 0x30FF),
        ("CJK", 0x3400, 0x9FFF),
        ("HANGUL", 0xAC00, 0xD7A3),
    ):
        if first <= o <= last:
            return name
    return "OTHER" if unicodedata.category(ch)[0] in "LM" else ""


#: Characters besides letters that clean words have: quotation marks, apostrophes, dashes and stops (fixed values).
CLEAN_MARKS = frozenset("’‘‚“”„‹›«»–—…¿¡•ºª׳״؟،؛।、。「」『』（），：；！？・ー‎‏")
RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
#: What Ukrainian, Belarusian and Serbian words have besides.
CYRILLIC_TOO = frozenset("іїєґўјљњћђџ")


def utf8_inside(run: str) -> bool:
    """Whether some part of the run is UTF-8 read in a one-byte encoding."""
    for e in ("cp1252", "latin_1", "cp1251", "cp1255", "cp850", "cp437"):
        back = _BACK[e]
        data = bytes([back.get(c, 0x20) for c in run])
        if _UTF8.search(data):
            return True
    return False


#: How the first two bytes of a character of UTF-8 read.
_BEGINS = frozenset(m[a] + m[b] for m in _MAPS.values() for a in range(0xC2, 0xF5) for b in range(0x80, 0xC0))
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf](?![\x80-\xbf])|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def kind_of(run: str) -> str:
    """``clean``, ``odd``, or ``""`` for what is neither: no source of garbled forms, and not looked up."""
    if REPLACED in run:
        return "odd"
    body = run.strip("\xa0\xad")
    scripts = {s for s in map(script_of, body) if s}
    marks = [c for c in body if not c.isascii() and not script_of(c)]
    plain = all(c in CLEAN_MARKS for c in marks)
    if any(0x80 <= ord(c) <= 0x9F for c in run):
        return "odd"
    if plain and len(scripts) <= 1 or scripts == {"LATIN", "CJK"} or scripts == {"LATIN", "THAI"}:
        script = next(iter(scripts - {"LATIN"} or scripts), "")
        if script in ("CJK", "THAI", "DEVANAGARI", "ARABIC", "HANGUL"):
            return "clean" if plain else "odd"
        letters = [c for c in body if c.isalpha()]
        if script == "HEBREW":
            return "odd" if any(0x591 <= ord(c) <= 0x5C7 or 0x5F0 <= ord(c) <= 0x5F2 for c in body) else "clean"
        regular = not any(a.islower() and b.isupper() for a, b in zip(body, body[1:]))
        if script == "CYRILLIC":
            shouted = len(letters) > 1 and all(c.isupper() for c in letters)
            others = [c for c in letters if c.lower() not in RUSSIAN]
            known = all(c.lower() in CYRILLIC_TOO for c in others) and len(others) * 3 <= len(letters) and not (others and utf8_inside(run))
            return "clean" if regular and not shouted and known else "odd"
        if script == "GREEK":
            return "clean" if regular and len(letters) > 2 else "odd"
        inside = any(a.isalpha() and b in CLEAN_MARKS and b not in "’‘·ºª" and c.isalpha() for a, b, c in zip(body, body[1:], body[2:]))
        accented = [c for c in letters if not c.isascii()]
        shouted = len(letters) > 2 and all(c.isupper() for c in letters) and len(accented) * 2 > len(letters)
        if not letters:
            return "odd" if len(marks) > 1 and utf8_inside(run) else "clean"
        if regular and not inside and not shouted and (len(accented) * 2 <= len(letters) or len(letters) < 4):
            return "odd" if utf8_inside(run) else "clean"
        return "odd"
    if scripts == {"LATIN"} and not marks:
        return ""
    return "odd"


def may_deceive(run: str) -> bool:
    """Whether a clean word could be another one garbled, in a script with spaces: three characters or more, as of
    shorter ones, pieces of words cut by invisible characters too, many are each other's forms; two in Latin."""
    least = 2 if all(script_of(c) in ("LATIN", "") for c in run) else 3
    return len(run.strip("\xa0\xad")) >= least and not {"CJK", "THAI"} & {script_of(c) for c in run}


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def runs(values: DataFrame) -> DataFrame:
    """``kind``, ``run``, ``n``, ``field``, ``id``, ``text``: the words of the values that aren't all ASCII.

    ``clean`` and ``odd`` words come with their rows and the hash of the whole value. In scripts without spaces the
    units of clean words are ``unit`` instead, counted within a batch, without rows. ``bare`` are clean words without
    the marks around them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            clean: Counter = Counter()
            units: Counter = Counter()
            rows: list[tuple] = []
            for field, i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = _hash(value)
                for run in set(RUN.findall(value)):
                    if len(known) > 200_000:
                        known.clear()
                    k = known.get(run)
                    if k is None:
                        k = known[run] = kind_of(run)
                    if k:
                        rows.append((k, run, 1, field, i, text))
                    if k == "clean":
                        clean[run] += 1
            spaceless: set[str] = set()
            bare: set[str] = set()
            for run, n in clean.items():
                script = {script_of(c) for c in run}
                size = UNIT["CJK"] if "CJK" in script else UNIT["THAI"] if "THAI" in script else 0
                if size:
                    spaceless.add(run)
                    for part in re.split(r"[A-Za-z]+", run):
                        for at in range(max(1, len(part) - size + 1)):
                            units[part[at : at + size]] += n
                else:
                    stripped = run.strip("’‘‚“”„‹›«»–—…¿¡")
                    if stripped != run and stripped and not stripped.isascii():
                        bare.add(stripped)
            rows = [r for r in rows if r[0] == "odd" or r[1] not in spaceless]
            rows += [("bare", r, 0, None, None, None) for r in bare] + [("unit", r, n, None, None, None) for r, n in units.items() if r]
            columns = list(zip(*rows)) if rows else [[], [], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "run", "n", "field", "id", "text"])

    kept = values.select("field", F.col("id").cast("long"), "value").where("id IS NOT NULL AND value IS NOT NULL")
    return kept.where(F.col("value").rlike(r"[^\x00-\x7f]")).mapInArrow(cut, "kind string, run string, n long, field string, id long, text long")


def garbled_forms(words: DataFrame) -> DataFrame:
    """``form`` (hash of the garbled form), ``unit``, ``word``, ``n``, ``rows``, ``chain``: for every clean word under every chain."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: chains(s) for s in WRITTEN}
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for kind, word, n, in_rows in zip(*(c.to_pylist() for c in b.columns)):
                script = next((s for s in map(script_of, word) if s and s != "LATIN"), "LATIN")
                for g, chain in garbled_under(word, known.get(script, known["DEVANAGARI"])).items():
                    if kind == "unit" and (len(g) not in WINDOWS or REPLACED in g):
                        continue
                    for column, value in zip(out, (_hash(g), kind == "unit", word, n, in_rows, " ".join(chain))):
                        column.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["form", "unit", "word", "n", "rows", "chain"])

    return words.select("kind", "run", "n", "rows").mapInArrow(make, "form long, unit boolean, word string, n long, rows long, chain string")


def probes(odd: DataFrame) -> DataFrame:
    """``run``, ``n_run``, ``rows_run``, ``form``, ``unit``: the hash of each odd run, and of its windows, with the run's counts."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for run, n, in_rows in zip(*(c.to_pylist() for c in b.columns)):
                # a word garbled inside quotation marks that were garbled too
                forms = {(_hash(run), False), (_hash(run.strip("\xa0\xad")), False)}
                if len(run) >= WINDOWS[0] and sum(not c.isascii() for c in run) >= WINDOWS[0] - 1:
                    for at in range(len(run) - WINDOWS[0] + 1):
                        # windows of UTF-8 begin as its characters do
                        sizes = WINDOWS if run[at : at + 2] in _BEGINS else LEGACY
                        forms.update((_hash(run[at : at + size]), True) for size in sizes if at + size <= len(run))
                for form, unit in forms:
                    for column, value in zip(out, (run, n, in_rows, form, unit)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["run", "n_run", "rows_run", "form", "unit"])

    return odd.select("run", "n_run", "rows_run").mapInArrow(probe, "run string, n_run long, rows_run long, form long, unit boolean")


#: How many times more frequent than a clean word the word must be of which it is taken for a garbled form.
FAR_MORE = 4
#: A word of so many letters is no other one's garbled form by chance; of shorter ones a row must have two.
LONG = 6
#: Nor of one so long that only one character is strange.
LONGER = 8
#: What a match tells: nothing, that it is garbled if another match of the same chain in the row says more, that the
#: row is garbled if it has another match of the chain, that it is garbled.
NOTHING, COMPANY, WITH_ANOTHER, ALONE = range(4)


def verified(run: str, word: str, chain: str, unit: bool, often: bool = True, far: bool = True, odd: bool = True) -> int:
    """What the match tells: the word garbles to the run (or to part of it), and the run isn't a look-alike spelling.

    ``often``: the word is in as many different texts as the run, so that copies of a garbled text don't make it
    right; ``far``: in far more, or in as many and far more rows.
    """
    if not odd and (unit or not often and not far):
        return NOTHING
    # a Latin word of accented letters only is no original of what looks clean
    if not odd and len(word) > 1 and all(not c.isascii() and script_of(c) == "LATIN" for c in word):
        return NOTHING
    g = garble(word, tuple(chain.split(" ")))
    if g is None or (g not in run if unit else g.strip("\xa0\xad") != run.strip("\xa0\xad")):
        return NOTHING
    long = odd or len(run) >= LONG and sum(not c.isascii() and c.isalpha() for c in run) >= 3 or len(run) >= LONGER and far
    if REPLACED in run:
        return ALONE
    strange = [c for c in g if not c.isascii()]
    if all(c in AMBIGUOUS for c in strange):
        return NOTHING
    if not odd and not far:
        return COMPANY
    if not long:
        return WITH_ANOTHER
    # text written in UTF-8 shows it; of others short runs may be what they seem
    if chain.startswith("utf-8"):
        return NOTHING if len(g) < 2 else ALONE
    if len(run) >= LONGER and not odd:
        return ALONE
    symbol = any(not c.isalpha() and c not in CLEAN_MARKS for c in strange)
    telling = len(strange) > 1 or len(g) > 3 or symbol
    if not (unit or len(g) > 2 and telling):
        return NOTHING
    # short words of letters only that are more frequent than the word, as abbreviations are, need another one
    sure = unit or symbol or often or len(g) >= LONG
    return ALONE if sure else WITH_ANOTHER


def matches(rows: DataFrame) -> DataFrame:
    """``run``, ``sure``, ``chain``, ``word`` (null where only windows matched), ``chains`` with what they tell: runs that are garbled clean words."""
    texts = rows.where("text IS NOT NULL").groupBy("kind", "run", "text").agg(F.sum("n").alias("rows")).drop("text").withColumn("n", F.lit(1))
    others = rows.where("text IS NULL").select(F.when(F.col("kind") == "bare", "clean").otherwise(F.col("kind")).alias("kind"), "run", "n", F.col("n").alias("rows"))
    counted = texts.unionByName(others).groupBy("kind", "run").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))  # n: different texts
    counted = materialize(counted, "words")
    words = counted.where("kind <> 'odd'")
    odd = counted.where("kind = 'odd'").select("run", F.col("n").alias("n_run"), F.col("rows").alias("rows_run"))

    @F.pandas_udf("boolean")
    def deceives(run):
        return run.map(may_deceive).astype(bool)

    @F.pandas_udf("long")
    def hashed(run):
        return run.map(_hash)

    clean = counted.where("kind = 'clean' AND n > 0").where(deceives("run"))
    clean = clean.select("run", F.col("n").alias("n_run"), F.col("rows").alias("rows_run"), F.lit(False).alias("sure"), hashed("run").alias("form"), F.lit(False).alias("unit"))
    asked = probes(odd).withColumn("sure", F.lit(True)).unionByName(clean)
    # few rows, each of which makes many: as many tasks as there are cores
    forms = garbled_forms(words.repartition(partitions(rows.sparkSession), "run"))
    # merged: by the size of the words' file, from which Python makes far more, the planner would broadcast a side
    hit = asked.join(forms.hint("merge"), ["form", "unit"])

    @F.pandas_udf("int")
    def tells(run, word, chain, unit, often, far, sure):
        import pandas as pd

        return pd.Series([verified(*x) for x in zip(run, word, chain, unit, often, far, sure)], dtype="int32")

    tells = tells.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    often = F.col("n") >= F.col("n_run")
    far = (F.col("n") >= FAR_MORE * F.col("n_run")) | often & (F.col("rows") >= FAR_MORE * F.col("rows_run"))
    best = hit.withColumn("tells", tells("run", "word", "chain", "unit", often, far, "sure")).where(F.col("tells") > NOTHING).groupBy("run", "sure").agg(
        F.max(F.struct((~F.col("unit")).alias("whole"), "n", "chain", "word")).alias("best"),
        F.collect_set(F.struct("chain", "tells")).alias("chains"),  # there are few chains
    )
    return best.select("run", "sure", "best.chain", F.when(F.col("best.whole"), F.col("best.word")).alias("word"), "chains")


def read_back(run: str) -> str | None:
    """The chain, written in UTF-8, that reads an odd run back to a clean word which garbles to it."""
    strange = [c for c in run if not c.isascii() and c not in "\xa0\xad"]
    if REPLACED in run or len(strange) < 2 or all(c in AMBIGUOUS for c in strange) or not utf8_inside(run):
        return None
    for chain in _UTF8_CHAINS:
        back = ungarble(run.strip("\xa0"), chain)
        if back is not None and back != run and not back.isascii() and _clean(back):
            return " ".join(chain)
    return None


_UTF8_CHAINS = [("utf-8", r) for r in READ if r != "utf-8"] + [("utf-8", r, "utf-8", again) for r, again in TWICE]


def found_runs(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs by row (``field``, ``id``, ``run``, ``sure``), and those that are garbled, as from :func:`matches`.

    Of the odd runs that match nothing those are garbled that hold a replacement character or that can be read back.
    """
    rows = materialize(runs(values), "runs")
    match = materialize(matches(rows), "matches")
    by_row = rows.where("kind IN ('odd', 'clean')").select("field", "id", "run", (F.col("kind") == "odd").alias("sure")).distinct()

    @F.pandas_udf("string")
    def chain_of(run):
        return run.map(read_back)

    chain_of = chain_of.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    rest = rows.where("kind = 'odd'").select("run").distinct().join(match.where("sure").select("run").hint("merge"), "run", "left_anti")
    none = F.lit(None).cast("string")
    lost = rest.withColumn("chain", chain_of("run")).where(F.col("chain").isNotNull() | F.col("run").contains(REPLACED))
    lost = lost.select("run", F.lit(True).alias("sure"), "chain", none.alias("word"), F.array(F.struct("chain", F.lit(ALONE).alias("tells"))).alias("chains"))
    return by_row, match.unionByName(lost)


def _marked(by_row: DataFrame, found: DataFrame) -> DataFrame:
    hits = by_row.join(found.select("run", "sure", F.explode("chains").alias("c")), ["run", "sure"])
    # counts and flags only: combined on the map side, however many words a row has
    word = F.xxhash64("run")
    by_chain = hits.groupBy("field", "id", "c.chain").agg(F.max("c.tells").alias("tells"), (F.min(word) < F.max(word)).alias("two"))
    told = by_chain.where((F.col("tells") == ALONE) | (F.col("tells") == WITH_ANOTHER) & F.col("two"))
    return told.select("field", "id").distinct()


def garbled(values: DataFrame) -> DataFrame:
    """``field``, ``id`` of each row of which some part is garbled. Null, blank and ASCII values never are."""
    return _marked(*found_runs(values))


def restored(values: DataFrame) -> DataFrame:
    """``field``, ``id``, ``restored``, ``complete``: garbled rows with their originals put in place.

    ``complete`` is false where some odd run could not be read back; that run is left as it was.
    """
    by_row, found = found_runs(values)
    marked = _marked(by_row, found)
    # the odd and the matched words of one row
    of_row = by_row.join(marked, ["field", "id"], "left_semi").join(found, ["run", "sure"], "left").where("sure OR chain IS NOT NULL")
    fixes = of_row.groupBy("field", "id").agg(F.collect_list(F.struct("run", "chain", "word")).alias("runs"))

    @F.pandas_udf("restored string, complete boolean")
    def put(value, runs_):
        import pandas as pd

        made = [restore(v, {r["run"]: (r["chain"], r["word"]) for r in rs}) for v, rs in zip(value, runs_)]
        return pd.DataFrame(made, columns=["restored", "complete"])

    rows = values.select("field", F.col("id").cast("long").alias("id"), "value").where("value IS NOT NULL")
    return rows.join(fixes, ["field", "id"]).withColumn("p", put("value", "runs")).select("field", "id", "p.restored", "p.complete")


def _plausible(run: str) -> bool:
    """Clean, or clean in lower case, as abbreviations and shouted words are."""
    return kind_of(run) == "clean" or kind_of(run.lower()) == "clean" and len({script_of(c) for c in run} - {""}) == 1


def _clean(text: str) -> bool:
    return all(map(_plausible, RUN.findall(text))) and not any(0x80 <= ord(c) <= 0x9F for c in text)


def _readings(chain: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A chain, and the one that reads the same but for control characters."""
    twin = {"cp1252": "latin_1", "latin_1": "cp1252"}
    return [chain] + ([tuple(twin.get(x, x) if i % 2 else x for i, x in enumerate(chain))] if chain[1] in twin else [])


def _regions(value: str, chain: tuple[str, ...], garbled_runs: set[str]) -> str:
    """Longest stretches that a chain may have made, read back whole where that gives clean text only.

    What was read may hold ASCII characters that were no characters of their own, so runs alone aren't enough.
    """
    readable = _BACK.get(chain[-1])
    if readable is None:
        return value
    marked = [m.span() for m in RUN.finditer(value) if m[0] in garbled_runs]
    out, at = [], 0
    for m in re.finditer("[" + re.escape("".join(readable)) + "]+", value):
        a, b = m.span()
        if not m[0].isascii() and any(s < b and a < e for s, e in marked):
            back = ungarble(m[0], chain)
            if back is not None and back != m[0] and _clean(back):
                out += [value[at:a], back]
                at = b
    return "".join(out) + value[at:]


def restore(value: str, facts: dict[str, tuple[str | None, str | None]]) -> tuple[str, bool]:
    """One value with its garbled runs replaced, and whether all of them could be."""
    votes = Counter(chain for chain, _ in facts.values() if chain)
    order = [tuple(c.split(" ")) for c, _ in votes.most_common()]
    complete = True
    named = {run for run, (chain, _) in facts.items() if chain}
    for c in dict.fromkeys(r for c in order for r in _readings(c)):
        value = _regions(value, c, named)

    def put(m: re.Match) -> str:
        nonlocal complete
        run = m[0]
        if run not in facts:
            return run
        chain, word = facts[run]
        if word is not None and garble(word, tuple(chain.split(" "))) == run:
            return word
        for c in [r for o in ([tuple(chain.split(" "))] if chain else []) + order for r in _readings(o)]:
            back = ungarble(run, c)
            if back is not None and _clean(back):
                return back
        if word is not None:
            return word
        complete = complete and not (chain or REPLACED in run or utf8_inside(run))
        return run

    out = RUN.sub(put, value)
    return out, complete
