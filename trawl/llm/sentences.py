"""Sentences of documents in any language and script, as offsets into the text.

A text is cut into units first: blank lines end one, list marks and heading marks begin one. Within a unit
every place where a sentence might end is a node of a lattice: a run of final marks with what closes behind
it, and in scripts without spaces a space. A node costs something to end at and something to pass, by what
stands before it (abbreviations, initials, ordinals) and what opens behind it (case, file names); a sentence,
an edge between two nodes, can't be nothing but a quotation that goes on. The cheapest path is the text's sentences.

In Chinese and Japanese the words beside a gap are found by a word lattice whose dictionary is learnt from
the whole corpus (:func:`learn`): a particle behind a quotation goes on, and a space ends a sentence between
a word that closes sentences and one that opens them. In Thai every single space ends one.

All scans go from offset to offset, so time grows in proportion to a text's length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: Words before a full stop (fixed values). Titles and the like never end a sentence.
TITLES = frozenset("Dr Mr Mrs Ms Prof St Sr Sra Srta Dra Hr Fr Frl M MM Mme Mlle Sig sig dott prof Dhr dhr Mevr mevr dr drs ir mr Herr г Г гр акад проф डॉ श्री".split())
PHRASES = frozenset(
    "e.g i.e z u bzw vgl cf cfr ej bijv d.w.z d.h z.B u.a o.ä c.-à-d incl inkl excl exkl vs см ср т т.е напр вкл искл ок approx aprox ca env resp evtl ggf sog "
    "dept ad es ex v.a m.a.w m.b.t i.v.m o.a p.ej p.ex".split()
)
#: These go on where a number or a small letter follows.
NUMBERED = frozenset(
    "No no Nr nr Nrn fig figs Fig Abb Abschn Kap p pp P Pg pag págs pág pgs n N núm num art Art arts apdo cap sect Sect Sec sec sez secç cláus par blz afb hfst ch "
    "стр рис разд гл п пп табл ص पृ क्र सं Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec vol Vol Bd ed Ed".split()
)
#: These may end a sentence and may not.
EITHER = frozenset("etc usw ecc enz a.m p.m др пр dgl".split())
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: Words of Japanese and Chinese known beforehand (fixed values): particles that go on after a quotation, words that
#: end a sentence, words that open one, and words that only begin like one of these.
GO_ON = ("と", "って", "という", "との", "に", "を", "が", "は", "の", "も", "で", "や", "へ", "から", "より", "まで", "など", "的", "地", "得", "着", "等")
FINAL = ("です", "ます", "でした", "ました", "ません", "ませんでした", "ください", "だ", "だった", "である", "ない", "なかった", "た", "ね", "よ", "か", "了", "吗", "呢", "吧", "啊", "的")
OPENING = ("今朝", "今日", "昨日", "明日", "最後に", "最初に", "次に", "しかし", "そして", "また", "ただし", "なお", "今天", "昨天", "明天", "最后", "首先", "然后", "根据", "但是", "而且", "因此", "所以", "请", "我们", "他们")
OTHER = ("とても", "ところが", "ところで", "とくに", "とりあえず", "もう", "もし", "もっと", "でも", "では", "のち", "はい", "はじめ", "にわか", "がんばる", "的确", "地图", "地方", "得分", "了解", "等待", "あした", "きた", "した")

_OPEN = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "»": "«"}
_QUOTE = re.compile("[«»“”„「」『』‹›\"]")
_TERM = re.compile(r"[.!?…。！？؟।｡]+|(?<=[฀-๿]) (?=[฀-๿])|(?<=[぀-ヿ㐀-鿿])[ 　]+(?=[぀-ヿ㐀-鿿])")
_CLOSERS = ")]）】』」”»›"
_CJK = re.compile("[぀-ヿ㐀-鿿，、：；]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿]+")
_FILE = re.compile(r"[\w\-.]*\w\.\w{1,5}(?!\w)")
_MARK = re.compile(r"[^\S\n]*(?:[-*•][ ]|(#+)(?:[^\S\n]|$))")
_WORD = re.compile(r"\w+")
_NEXT = re.compile(r"\s(?=[^\W_])")
#: Where a word before a full stop begins, and marks that may close it.
_BEFORE, _BEHIND = frozenset("(（[«“„\"'‘"), ")]»”\""
#: Passed over before what opens a sentence.
_OPENERS = frozenset("\"'“„«‘‚([¿¡」』》‹（ \t\r\n\xa0 ")

#: The longest word learnt, how often one must be seen, and how many the dictionary holds, the most frequent.
LONGEST, SEEN, MAX_WORDS = 4, 4, 1 << 16
#: From which score on a word closes or opens a sentence, and below which what follows a quotation goes on.
TELLS, GOES_ON = 0.7, -4.0


class Lexicon:
    """A dictionary of scripts without spaces: what a word costs in the lattice, and how it stands to sentence ends.

    ``counts``: word -> how often it is seen, how often a sentence opens with it and closes with it.
    """

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None):
        counts = counts or {}
        total = sum(c[0] for c in counts.values())
        known = max(5.0, total * 1e-4)  # what the words known beforehand are taken to be seen, besides what is counted
        self.cost: dict[str, float] = {}
        for w in (*counts, *GO_ON, *FINAL, *OPENING, *OTHER):
            n = counts.get(w, (0, 0, 0))[0] + (known if w in _KNOWN else 0.0)
            self.cost[w] = math.log((total + 100 * known) / n)
        self.unknown = math.log(total + 100 * known) + 1.0
        self.longest = max(map(len, self.cost))
        rates = [max(1, sum(c[i] for c in counts.values())) / max(1, total) for i in (1, 2)]
        self.opens, self.closes = (
            {w: math.log((c[i] + 20 * r) / ((c[0] + 20) * r)) for w, c in counts.items()} for i, r in ((1, rates[0]), (2, rates[1]))
        )
        for scores, words, score in ((self.opens, OPENING, 2.0), (self.closes, FINAL, 2.0), (self.opens, GO_ON, -8.0)):
            for w in words:
                scores[w] = scores.get(w, 0.0) + score

    def cut(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The cheapest path through the word lattice of a stretch: its words' offsets."""
        n, words = b - a, self.cost
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            least, size = self.unknown + best[i + 1], 1
            for k in range(1, min(self.longest, n - i) + 1):
                c = words.get(text[a + i : a + i + k])
                if c is not None and c + best[i + k] < least:
                    least, size = c + best[i + k], k
            best[i], step[i] = least, size
        out, i = [], 0
        while i < n:
            out.append((a + i, a + i + step[i]))
            i += step[i]
        return out

    def opening(self, text: str, at: int, last: int) -> float:
        """How the word that begins at ``at`` stands to opening a sentence: above 0 it does so more often than others."""
        m = _SPACELESS.match(text, at, last)
        if not m:
            return 0.0
        a, b = self.cut(text, *m.span())[0]
        return self.opens.get(text[a:b], 0.0)

    def closing(self, text: str, first: int, at: int) -> float:
        """The same for closing one and the word that ends at ``at``."""
        a = at
        while a > first and _SPACELESS.match(text[a - 1]):
            a -= 1
        if a == at:
            return 0.0
        a, b = self.cut(text, a, at)[-1]
        return self.closes.get(text[a:b], 0.0)


_KNOWN = frozenset((*GO_ON, *FINAL, *OPENING, *OTHER))
_PLAIN = Lexicon()


def grams(text: str, counts: Counter, opens: Counter, closes: Counter) -> None:
    """Count the character sequences of a text's stretches without spaces, and those that open and close sentences beyond doubt."""
    for m in _SPACELESS.finditer(text):
        a, b = m.span()
        run = m[0]
        for n in range(1, min(LONGEST, b - a) + 1):
            counts.update([run[i : i + n] for i in range(b - a - n + 1)])
        before = a - 1
        while before >= 0 and text[before] in "“「『«\"　 ":
            before -= 1
        sizes = range(1, min(LONGEST, b - a) + 1)
        if before < 0 or text[before] in "\n。！？｡":
            opens.update([run[:n] for n in sizes])
        if text[b : b + 1] in ("。", "！", "？", "｡"):
            closes.update([run[-n:] for n in sizes])


def learn(documents: DataFrame, text: str = "text") -> Lexicon:
    """The dictionary of a corpus, from all its texts: character sequences, counted on the map side first.

    It holds at most MAX_WORDS words, those seen most; how often a word must be seen for that is read off a
    histogram of counts, so nothing but the dictionary comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, opens, closes = Counter(), Counter(), Counter()
            for t in b.column(0).to_pylist():
                grams(t, counts, opens, closes)
            words = list(counts)
            columns = [pa.array([c[w] for w in words], pa.int64()) for c in (counts, opens, closes)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", "n", "opens", "closes"])

    spaceless = documents.select(F.col(text).alias("t")).where(F.col("t").rlike("[぀-ヿ㐀-鿿]"))
    made = spaceless.mapInArrow(count, "word string, n long, opens long, closes long")
    made = materialize(made.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "opens", "closes")]).where(F.col("n") >= SEEN), "grams")
    steps = made.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # some hundred rows
    room, lowest = MAX_WORDS, None
    for r in sorted(steps, reverse=True):
        room -= r["words"]
        if room < 0:
            break
        lowest = r["step"]
    kept = made.where(F.floor(F.log2("n") * 8) >= lowest).collect() if lowest is not None else []
    discard(made)
    return Lexicon({r["word"]: (r["n"], r["opens"], r["closes"]) for r in kept})


def units(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text that no sentence crosses, without list and heading marks."""
    start = end = None
    at = 0
    for line in text.split("\n"):
        stop = at + len(line)
        m = _MARK.match(line)
        if not line.strip():
            if start is not None:
                yield start, end
            start = None
        elif m:
            if start is not None:
                yield start, end
            start, end = at + m.end(), stop
            if m[1]:  # a heading ends with its line
                yield start, end
                start = None
        else:
            start, end = at if start is None else start, stop
        at = stop + 1
    if start is not None:
        yield start, end


def quotations(text: str, first: int, last: int) -> dict[int, int]:
    """Opening place -> closing place of each closed quotation between two offsets, the outer ones only."""
    marks = [(m.start(), m[0]) for m in _QUOTE.finditer(text, first, last)]
    near = lambda p: text[p] if first <= p < last else ""
    closers: dict[str, list[int]] = {}
    for k, (p, c) in enumerate(marks):
        if c != '"' or not (near(p - 1).isalpha() and near(p + 1).isalpha()):
            closers.setdefault(c, []).append(k)
    spans, i = {}, 0
    while i < len(marks):
        place, mark = marks[i]
        before, after = near(place - 1), near(place + 1)
        i += 1
        if mark == '"':
            if before.isalpha() and after.isalpha() or not after.strip():
                continue
            closing = '"'
        elif mark in _OPEN:
            closing = _OPEN[mark]
            if mark == "»" and (not after or after.isspace()):
                continue
        else:
            continue
        found = []
        for c in closing:
            at = closers.get(c, [])
            k = bisect_left(at, i)
            if k < len(at):
                found.append(at[k])
        if found:
            spans[place] = marks[min(found)][0]
            i = min(found) + 1
    return spans


def _skip(text: str, at: int, last: int) -> int:
    while at < last and text[at].isspace():
        at += 1
    return at


def _opening(text: str, at: int, last: int) -> tuple[int, str]:
    """Where what follows begins, behind quotation marks and the like, and its kind: upper, lower, digit, caseless, other or none."""
    while at < last and (text[at].isspace() or text[at] in _OPENERS):
        at += 1
    if at >= last:
        return last, "none"
    c = text[at]
    if c.isdigit():
        return at, "digit"
    if c.isalpha() or unicodedata.category(c)[0] == "M":
        return at, "lower" if c.islower() else "upper" if c.isupper() else "caseless"
    return at, "other"


def _token(text: str, first: int, end: int) -> int:
    """Where the word that ends at ``end`` begins."""
    at = end
    while at > first and not text[at - 1].isspace() and text[at - 1] not in _BEFORE:
        at -= 1
    return at


def _follows(text: str, first: int, at: int, stop: str) -> bool:
    """Whether ``stop`` and a space stand before the word at ``at``."""
    p = at
    while p > first and text[p - 1].isspace():
        p -= 1
    return p < at and text.startswith(stop, p - len(stop)) and p - len(stop) >= first


#: How much a node's decision weighs in the lattice: marks that always end, others, ends of quotations, and what may be either.
SURE, USUAL, QUOTED, OPEN = 10.0, 4.0, 3.0, 1.0


def _stop(text: str, first: int, a: int, b: int, last: int) -> tuple[bool, float]:
    """Whether one full stop at ``a`` ends a sentence, and how sure that is."""
    begin = _token(text, first, a)
    word = text[begin:a].rstrip(_BEHIND)
    short = re.split("[’']", word)[-1] or word
    body, kind = _opening(text, b, last)
    if short in TITLES or short in PHRASES or word in PHRASES:
        p = _back(text, first, begin)
        ad_es = p < begin and text[_token(text, first, p) : p] == "ad"
        if not (short == "es" and not ad_es or short == "ad"):
            return False, USUAL
    if len(short) == 1 and short.isalpha() and not _CJK.match(short):
        if not (short in "дп" and _follows(text, first, a - 1, "т.")):
            return False, USUAL
    if short in NUMBERED:
        at = _skip(text, b, last)
        return kind not in ("digit", "lower", "none") and not text.startswith("(", at, last), USUAL
    if short in EITHER or short in ("д", "п") and _follows(text, first, a - 1, "т."):
        if kind == "other":  # a symbol or markup between two words says nothing
            later = _NEXT.search(text, body, last)
            body, kind = _opening(text, later.end(), last) if later else (last, "none")
        return kind in ("upper", "caseless") or kind == "lower" and short not in ("m", "a.m", "p.m") and bool(_FILE.match(text, body, last)), OPEN
    if kind == "lower":
        return bool(_FILE.match(text, body, last)) and not text.startswith("www", body), USUAL
    if word.isdigit() and len(word) <= 2:
        following = _WORD.match(text, body, last)
        if following and following[0] in MONTHS:
            return False, USUAL
    return True, USUAL


def _back(text: str, first: int, at: int) -> int:
    while at > first and text[at - 1].isspace():
        at -= 1
    return at


def _judge(text: str, first: int, last: int, a: int, b: int, mark: str, quote: tuple[int, int] | None, lexicon: Lexicon) -> tuple[bool, float, bool]:
    """Whether a sentence ends at ``b`` behind the final marks ``mark`` at ``a``, how sure, and whether only if it began before the quotation."""
    at = _skip(text, b, last)
    if at >= last:
        return True, SURE, False
    following = text[b]
    body, kind = _opening(text, b, last)
    if quote is not None:
        if not following.isspace() and not _CJK.match(following) and mark[-1] not in "。！？｡" and following not in "«“„\"「":
            return False, USUAL, False
        if kind == "lower":
            return bool(_FILE.match(text, body, last)), QUOTED, True
        if _CJK.match(following) or kind == "caseless":
            goes_on = following in "，、：；" or lexicon.opening(text, at, last) < GOES_ON
            return not goes_on, QUOTED, True
        return True, USUAL, False
    if mark[-1] in "。！？｡।":
        return True, SURE, False
    if set(mark) <= {"…"} or set(mark) == {"."} and len(mark) > 1:
        if not following.isspace() or kind in ("lower", "digit", "other"):
            return False, USUAL, False
        return kind == "upper" or not (a > first and text[a - 1].isspace()), USUAL, False
    if not following.isspace():
        return mark[-1] in "!?؟" and bool(_CJK.match(following)), USUAL, False
    if mark == ".":
        return *_stop(text, first, a, b, last), False
    return kind != "lower" or bool(_FILE.match(text, body, last)), USUAL, False


def nodes(text: str, first: int, last: int, lexicon: Lexicon) -> list[tuple[int, float, float, int | None]]:
    """The nodes of a unit's lattice in order: offset, cost of ending there, cost of passing, and the least offset
    at which a sentence that ends there may not begin any more (None: anywhere)."""
    spans = quotations(text, first, last)
    opens = sorted(spans)
    out: list[tuple[int, float, float, int | None]] = []
    done = first
    k = 0
    for m in _TERM.finditer(text, first, last):
        a, b = m.span()
        if a < done:
            continue
        while k < len(opens) and spans[opens[k]] < a:
            k += 1
        quote = (opens[k], spans[opens[k]]) if k < len(opens) and opens[k] < a else None
        if m[0].isspace():  # in Thai an end by itself, elsewhere between a word that closes and one that opens
            if quote is None:
                thai = "฀" <= text[b] <= "๿"
                ends = text[b] not in "ๆฯ" if thai else lexicon.closing(text, first, a) > TELLS and lexicon.opening(text, b, last) > TELLS
                out.append((b, 0.0, USUAL, None) if ends else (b, USUAL, 0.0, None))
                if ends:
                    done = b
            continue
        if quote is not None:
            if _skip(text, b, quote[1]) < quote[1]:
                continue
            b = quote[1] + 1
        while b < last and text[b] in _CLOSERS and b not in spans:
            b += 1
        # final marks behind a closing mark decide by themselves
        if quote is not None and (later := _TERM.match(text, b, last)) and not later[0].isspace():
            continue
        ends, weight, not_alone = _judge(text, first, last, a, b, m[0], quote, lexicon)
        out.append((b, 0.0 if ends else weight, weight if ends else 0.0, _back(text, first, quote[0]) if not_alone else None))
        done = b
    return out


def cheapest(first: int, made: list[tuple[int, float, float, int | None]]) -> list[int]:
    """The offsets at which the sentences of the cheapest path end.

    What a path pays up to a node is what its sentences' ends cost and what it passed. Costs of passing are
    sums, so the best place to have begun is a minimum over all earlier nodes, kept as one goes.
    """
    begins, value, before = [first], [0.0], [-1]  # where a sentence may begin, what the path there cost less what it passed, and the begin before
    least = [0]  # the best begin up to and with each
    for at, end, skip, not_from in made:
        upto = len(begins) if not_from is None else bisect_left(begins, not_from)
        if upto:
            i = least[upto - 1]
            begins.append(at)
            value.append(value[i] + end - skip)
            before.append(i)
            least.append(len(begins) - 1 if value[-1] < value[least[-1]] else least[-1])
    out, i = [], least[-1]
    while i > 0:
        out.append(begins[i])
        i = before[i]
    return out[::-1]


def sentences(text: str | None, lexicon: Lexicon = _PLAIN) -> list[tuple[int, int]]:
    """Start and end of each sentence, in order."""
    out: list[tuple[int, int]] = []
    text = text or ""
    for first, last in units(text):
        at = first
        for end in (*cheapest(first, nodes(text, first, last, lexicon)), last):
            s, e = _skip(text, at, end), _back(text, at, end)
            if s < e:
                out.append((s, e))
            at = end
    return out


def sentence_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """``key``, ``start_char``, ``end_char`` (code points, end exclusive), and with ``with_text`` ``sent_no`` and ``sentence``.

    Null, empty and blank texts have no sentence. Rows given twice come out twice. The dictionary is learnt from the
    documents unless one is given; the sentences themselves are one pass without a shuffle.
    """
    # at most MAX_WORDS words
    shared = documents.sparkSession.sparkContext.broadcast(lexicon if lexicon is not None else learn(documents, text))

    @F.arrow_udf("array<struct<start_char:int,end_char:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = shared.value
        kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"start_char": s, "end_char": e} for s, e in sentences(t, words)] for t in batch.to_pylist()], kind)

    cut = cut.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    if not with_text:
        return documents.select(key, cut(F.col(text)).alias("__s")).select(key, F.inline("__s"))
    made = documents.select(key, F.col(text).alias("__t"), cut(F.col(text)).alias("__s")).select(key, "__t", F.posexplode("__s").alias("sent_no", "s"))
    sentence = F.substring(F.col("__t"), F.col("s.start_char") + 1, F.col("s.end_char") - F.col("s.start_char"))
    return made.select(key, "sent_no", "s.start_char", "s.end_char", sentence.alias("sentence"))
