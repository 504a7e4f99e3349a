"""A language, with a confidence, for each document and each segment of a mixed document.

A word's script narrows the languages it can be of. Within them it scores by how often labelled texts of
each language have it, or, if none has, by its letter trigrams. A Viterbi pass over the words of a text,
with a penalty for switching that is small at line ends and large within a line, labels spans; a line takes
the language of most of its words, and a segment is a longest run of lines of one language.

The word scores are fitted to at most ``TRAIN_ROWS`` labelled rows, those of lowest hash of their id; that
is the one bounded sample here. Labels may be wrong and texts mixed: after the first fit the lines of the
sample are labelled anew by the model and it is fitted again.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lowest_hashed, partitions

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "he", "ar", "hi", "zh", "ja", "th")
#: First and last code point of a script, and the languages written in it.
SCRIPTS = (
    (0x0041, 0x024F, "en de fr es pt it nl"),
    (0x1E00, 0x1EFF, "en de fr es pt it nl"),
    (0x0400, 0x052F, "ru"),
    (0x0590, 0x05FF, "he"),
    (0x0600, 0x077F, "ar"),
    (0x0900, 0x097F, "hi"),
    (0x0E00, 0x0E7F, "th"),
    (0x3040, 0x30FF, "ja"),
    (0x3400, 0x9FFF, "zh ja"),
)
TRAIN_ROWS = 4000
#: Nats: a word tells against a language at most so much, if known, unknown, or of another script.
KNOWN, UNKNOWN, FOREIGN = -6.0, -3.0, -6.0
SWITCH_IN_LINE, SWITCH_AT_LINE = 12.0, 4.0
TOKEN = (
    r"(?V1)\n|\p{Han}|[\p{Hiragana}\p{Katakana}ー]+|\p{Thai}[\p{Thai}\p{M}]*"
    r"|[[\p{L}\p{M}'’]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+"
)


def candidates(word: str) -> np.ndarray | None:
    """Which languages a word's script allows; None if no language here is written in it."""
    for ch in word:
        o = ord(ch)
        for first, last, names in SCRIPTS:
            if first <= o <= last and ch.isalpha():
                return np.array([x in names.split() for x in LANGUAGES])
    return None


def normal_label(label: Column) -> Column:
    """The language of a label without case, region and script; null for none, placeholders and other languages."""
    base = F.element_at(F.split(F.lower(F.trim(label)), "[-_]"), 1)
    return F.when(base.isin(*LANGUAGES), base)


class Model:
    """Scores of words by language: logarithms of the posterior under equal priors, floored."""

    def __init__(self, words: dict[str, np.ndarray], trigrams: dict[str, np.ndarray], spread: float = 8.0):
        self.words, self.trigrams, self.spread = words, trigrams, spread
        self._start()

    def __getstate__(self):
        return self.words, self.trigrams, self.spread

    def __setstate__(self, state):
        self.__init__(*state)

    def _start(self) -> None:
        import regex

        self.index: dict[str, int] = {"\n": 0}
        self.table = np.zeros((1024, len(LANGUAGES)), np.float32)
        self.tokens = regex.compile(TOKEN).findall

    def _row(self, word: str) -> np.ndarray:
        w = word.strip("'’").lower()
        if w in self.words:
            return self.words[w]
        allowed = candidates(w)
        if allowed is None:
            return np.zeros(len(LANGUAGES), np.float32)
        row = np.full(len(LANGUAGES), FOREIGN, np.float32)
        if allowed.sum() == 1:
            row[allowed] = 0
            return row
        total = np.zeros(len(LANGUAGES))
        padded = f" {w} "
        for i in range(len(padded) - 2):
            t = self.trigrams.get(padded[i : i + 3])
            if t is not None:
                total += t
        total[~allowed] = -np.inf
        total -= total.max()
        total -= math.log(np.exp(total).sum())
        row[allowed] = np.maximum(total[allowed], UNKNOWN)
        return row

    def indices(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        if len(index) > 300_000:
            self._start()
            index = self.index
        out = np.empty(len(tokens), np.int32)
        for i, t in enumerate(tokens):
            k = index.get(t)
            if k is None:
                k = index[t] = len(index)
                if k >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[k] = self._row(t)
            out[i] = k
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str | None, float]]]:
        """For each text its segments: first line, line behind the last, language and confidence."""
        found: list = [None] * len(texts)
        todo = []
        for i, t in enumerate(texts):
            todo.append((i, self.indices(self.tokens(t))))
        todo.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(todo):
            to = at + 1
            while to < len(todo) and to - at < 512 and (to - at + 1) * len(todo[to][1]) < 400_000:
                to += 1
            for (i, seq), states in zip(todo[at:to], self._viterbi([s for _, s in todo[at:to]])):
                found[i] = self._segments(seq, states)
            at = to
        return found

    def _viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """The best state at each token. Kept for each token: the best state before it, and who switched to it."""
        b, n, size = len(seqs), max((len(s) for s in seqs), default=0), len(LANGUAGES)
        padded = np.zeros((b, n), np.int32)
        for k, s in enumerate(seqs):
            padded[k, : len(s)] = s
        value = np.zeros((b, size), np.float32)
        best_before = np.zeros((n, b), np.int8)
        switched = np.zeros((n, b), np.uint16)
        bits = (1 << np.arange(size)).astype(np.uint16)
        rows = np.arange(b)
        penalty = np.full(b, SWITCH_AT_LINE, np.float32)
        for t in range(n):
            top = value.argmax(1)
            other = value[rows, top] - penalty
            move = other[:, None] > value
            best_before[t], switched[t] = top, (move * bits).sum(1)
            value = np.where(move, other[:, None], value) + self.table[padded[:, t]]
            penalty = np.where(padded[:, t] == 0, SWITCH_AT_LINE, SWITCH_IN_LINE).astype(np.float32)
        # padding scores nothing and looks like line ends, so a text's last state is still its best one's
        state = value.argmax(1)
        out = np.zeros((n, b), np.int8)
        for t in range(n - 1, -1, -1):
            out[t] = state
            state = np.where(switched[t] >> state.astype(np.uint16) & 1, best_before[t], state)
        return [out[: len(s), k] for k, s in enumerate(seqs)]

    def _segments(self, seq: np.ndarray, states: np.ndarray) -> list[tuple[int, int, str | None, float]]:
        size = len(LANGUAGES)
        line = np.cumsum(seq == 0) - (seq == 0)
        lines = int((seq == 0).sum()) + 1
        telling = (seq != 0) & (self.table[seq].min(1) < 0)
        if not telling.any():
            return []
        votes = np.zeros((lines, size))
        np.add.at(votes, (line[telling], states[telling]), 1)
        scores = np.zeros((lines, size))
        np.add.at(scores, line[telling], self.table[seq[telling]])
        count = votes.sum(1)
        have = np.nonzero(count)[0]
        language = (votes[have] + scores[have] * 1e-6).argmax(1)
        # lines without words belong to the run before them, or to the first
        cuts = [0, *(int(have[k]) for k in range(1, len(have)) if language[k] != language[k - 1]), lines]
        names = [language[0], *(language[k] for k in range(1, len(have)) if language[k] != language[k - 1])]
        out = []
        for k, lang in enumerate(names):
            part = slice(cuts[k], cuts[k + 1])
            p = confidences(scores[part].sum(0), count[part].sum(), self.spread)
            out.append((cuts[k], cuts[k + 1], LANGUAGES[lang], float(p[lang])))
        return out


def confidences(scores: np.ndarray, words: float, spread: float) -> np.ndarray:
    """The probability of each language. Words of a text aren't independent evidence: however many, they count as ``spread``."""
    total = scores / max(1.0, words / spread)
    p = np.exp(total - total.max())
    return p / p.sum()


#: From so many labelled texts on confidences are fitted to labels, to one of these numbers of words.
ENOUGH, SPREADS = 200, (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def calibrated(labelled: list[tuple[str, str | None]]) -> float:
    """The spread under which the labels of one half of the texts are likeliest, by a model fitted to the other half.

    Only texts that are one segment count. As labels may be wrong, confidences come to how often they agree.
    """
    model = fit(labelled[::2], spread=SPREADS[-1])
    loss = np.zeros(len(SPREADS))
    held = [(t, lang) for t, lang in labelled[1::2] if lang in LANGUAGES]
    for at in range(0, len(held), 512):
        some = held[at : at + 512]
        for (text, lang), spans in zip(some, model.spans([t for t, _ in some])):
            if len(spans) == 1:
                seq = model.indices(model.tokens(text))
                telling = (seq != 0) & (model.table[seq].min(1) < 0)
                scores = model.table[seq[telling]].sum(0)
                for i, spread in enumerate(SPREADS):
                    loss[i] -= math.log(max(1e-6, confidences(scores, telling.sum(), spread)[LANGUAGES.index(lang)]))
    return SPREADS[int(loss.argmin())]


def fit(labelled: list[tuple[str, str | None]], rounds: int = 2, spread: float | None = None) -> Model:
    """A model from texts and their languages; languages without any text keep what their script tells.

    ``spread`` is :func:`calibrated` unless it is given or the texts are too few.
    """
    if spread is None:
        spread = calibrated(labelled) if len(labelled) >= ENOUGH else 8.0
    model = Model({}, {})
    lines = [(line, lang) for text, lang in labelled for line in text.split("\n")]
    tokens = [[w.strip("'’").lower() for w in model.tokens(line)] for line, _ in lines]
    languages: list[str | None] = [lang for _, lang in lines]
    for turn in range(rounds):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        letters: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for words, lang in zip(tokens, languages):
            if lang in LANGUAGES:
                k = LANGUAGES.index(lang)
                for w in words:
                    counts[w][k] += 1
        for w, c in counts.items():
            if w and w[0].isalpha() and (allowed := candidates(w)) is not None and allowed.sum() > 2:
                padded = f" {w} "
                for i in range(len(padded) - 2):
                    letters[padded[i : i + 3]] += np.minimum(c, 3)
        model = Model(_posterior(counts, KNOWN, 2.0), _posterior(letters, -8.0, 0.0), spread)
        if turn + 1 < rounds:
            languages = []
            for start in range(0, len(labelled), 512):
                part = labelled[start : start + 512]
                for (text, _), spans in zip(part, model.spans([t for t, _ in part])):
                    of: list[str | None] = [None] * (text.count("\n") + 1)
                    for a, b, lang, _ in spans:
                        of[a:b] = [lang] * (b - a)
                    languages.extend(of)
    return model


def _posterior(counts: dict[str, np.ndarray], floor: float, least: float) -> dict[str, np.ndarray]:
    if not counts:
        return {}
    total = sum(counts.values())
    present = total > 0
    rate = (total + 0.1 * len(counts)) / 1.0
    out = {}
    for w, c in counts.items():
        if c.sum() < least or not w:
            continue
        p = np.where(present, (c + 0.1) / rate, 0.0)
        if not p.sum():
            continue
        out[w] = np.maximum(np.log(np.maximum(p / p.sum(), 1e-30)), floor).astype(np.float32)
    return out


#: Rows that a task labels; labelling is heavy for its bytes.
TASK_ROWS = 4000


def sample(labelled: DataFrame, total: int, rows: int = TRAIN_ROWS) -> list[tuple[str, str | None]]:
    """At most ``rows`` texts with a usable label, of lowest hash among about ``total``: the bounded sample for the driver."""
    good = labelled.select("id", "text", normal_label(F.col("lang")).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    return [(r["text"], r["lang"]) for r in lowest_hashed(good, "id", rows, total, "text").select("text", "lang").collect()]


def segments(texts: DataFrame, model: Model, key: str = "id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``seg_no`` from 0, ``lang``, ``confidence``, ``line_from``, ``line_to`` (0-based, inclusive), ``segments``.

    ``segments`` is how many the text has. Null texts, and texts without a word in a script known here, have none.
    Lines without words belong to the run before them. Rows given twice come out twice; no shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted to

    @F.arrow_udf("array<struct<seg_no:int,lang:string,confidence:double,line_from:int,line_to:int>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kind = pa.list_(
            pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("line_from", pa.int32()), ("line_to", pa.int32())])
        )
        for batch in batches:
            all_texts = [t or "" for t in batch.to_pylist()]
            out = []
            for at in range(0, len(all_texts), 2048):
                for spans in m.spans(all_texts[at : at + 2048]):
                    out.append(
                        [{"seg_no": i, "lang": lang, "confidence": c, "line_from": a, "line_to": b - 1} for i, (a, b, lang, c) in enumerate(spans)]
                    )
            yield pa.array(out, kind)

    label = label.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    made = texts.select(key, *carry, label(F.col(text)).alias("__s"))
    return made.select(key, *carry, F.size("__s").alias("segments"), F.inline("__s"))


def labelled_texts(chunks: DataFrame, labels: DataFrame, tasks: int) -> DataFrame:
    """``id``, ``text``, ``lang`` of the chunks that have a row among the labels, in so many partitions; a row given twice counts once."""
    wanted = labels.select(F.col("chunk_id").alias("id"), "lang").where("id IS NOT NULL").distinct()
    texts = chunks.select("id", "text").where("text IS NOT NULL")
    return wanted.repartition(tasks, "id").join(texts.repartition(tasks, "id"), "id").select("id", "text", "lang")


def relabel(chunks: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The segments of every labelled chunk, with its ``label`` and whether that ``agrees``: it is the language of the only segment.

    Texts are shuffled once, to where they are labelled; the sample's threshold is set below that join.
    """
    total, usable = labels.agg(F.count("chunk_id"), F.count_if(normal_label(F.col("lang")).isNotNull())).first()
    rows = labelled_texts(chunks, labels, max(partitions(chunks.sparkSession), -(-total // TASK_ROWS)))
    return rename(segments(rows, fit(sample(rows, usable, train_rows)), carry=("lang",)))


def rename(made: DataFrame) -> DataFrame:
    label, lang = made.columns.index("lang"), len(made.columns) - 1 - made.columns[::-1].index("lang")
    names = list(made.columns)
    names[label] = "label"
    assert names[lang] == "lang"
    made = made.toDF(*names)
    agrees = (F.col("segments") == 1) & normal_label(F.col("label")).eqNullSafe(F.col("lang"))
    return made.withColumn("agrees", agrees)
