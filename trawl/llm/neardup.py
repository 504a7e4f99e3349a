"""Near-duplicate texts by a MinHash LSH forest, with exact verification.

Each distinct text is a set of word sequences (shingles). It has a label of up to ``depth`` MinHash values in
each of ``trees`` tries, and two texts meet in a trie when their labels share a prefix. Prefixes are as long as
they can be: a text's prefix is shortened, value by value, while the node it leads to holds no more than
``crowd`` texts, so how long it is depends on how full the trie is there. Where crowded nodes leave a text
below the target recall, its prefixes are shortened further, at 16 times the crowd, 256 times, and at last
whatever the crowd, until a text at the threshold meets it in some trie with that probability. Below
:func:`prefix_length` no prefix has to go: there every text reaches the target. Where a text's prefixes make it
as likely that another at the threshold meets it in two tries, one meeting is no reason to compare them. Texts
that have met often enough are compared by their exact shingle sets.

Scale: copies are one text here, so a text copied a million times costs as much as one. Labels travel as a
64-bit key of the shortest prefix beside the other values; a key that only one text has is dropped by a count
before anything is sorted or paired. Nodes are counted over distinct labels, combined on the map side, so a
family of near copies isn't gathered in a task. Pairs of unlike sizes are dropped before they are made one, and
pairs met in several tries are made one before their sets are fetched. Nothing is capped. What is found grows
as the square of a family only where all its pairs are asked for (:func:`near_duplicates`);
:func:`near_duplicate_groups` compares with a node's representative first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: A word is a run of characters other than space, tab, CR and LF.
WORD = r"[^ \t\r\n]+"


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, at most ``depth``, with which in all trees a pair at the threshold meets with probability ``recall``."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def _hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def shingle_hashes(words: list[str], n: int, seen: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of ``n`` words; empty if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = _hashes(words, {} if seen is None else seen)
    mixed = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            mixed = (mixed ^ (h[i : i + len(mixed)])) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


#: Bits of each value of a label behind its shortest prefix; false meetings only add to what is verified.
BITS = 10


class Signer:
    """MinHash labels of a shingle set: in each tree a key of the first ``shortest`` values, and the others packed."""

    def __init__(self, trees: int, shortest: int, depth: int, seed: int = 11):
        if (depth - shortest) * BITS > 60:
            raise ValueError("the values behind the shortest prefix don't fit a long")
        rng = np.random.default_rng(seed)
        size = trees * depth
        self.trees, self.shortest, self.depth = trees, shortest, depth
        self.a = rng.integers(1, 1 << 32, size, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, np.uint32)
        self.start = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # keys of different trees differ

    def labels(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(short), 2048):  # bounded memory for texts of any length
                part = short[at : at + 2048, None] * self.a[None, :] + self.b[None, :]
                np.minimum(least, part.min(axis=0), out=least)
            values = least.reshape(self.trees, self.depth).astype(np.uint64)
            key = self.start.copy()
            for i in range(self.shortest):
                key = (key ^ values[:, i]) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            tail = np.zeros(self.trees, np.uint64)
            for i in range(self.shortest, self.depth):
                mixed = (values[:, i] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                tail = (tail << np.uint64(BITS)) | mixed
        return key.view(np.int64), tail.view(np.int64)


def distinct_texts(rows: DataFrame, key: str, text: str, least_words: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, rep) and ``texts`` (rep, text), one row for each distinct text of enough words.

    Texts are told apart by 128 bits of hash. Null texts, null ids and texts of fewer words are left out, as
    no pair can hold them. Only hashes and ids are shuffled, and the texts of representatives are read again.
    """
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & (F.regexp_count("text", F.lit(WORD)) >= least_words)
    )
    prints = kept.select("id", F.md5("text").alias("print"))
    # map-side combined: a text that fills a third of the table is one row of each task here
    reps = prints.groupBy("print").agg(F.min("id").alias("rep"))
    members = materialize(prints.join(reps, "print").select("id", "rep").distinct(), "members")
    # an id given twice with different texts is in two classes
    texts = kept.withColumn("print", F.md5("text")).join(reps, "print").where("id = rep").select("rep", "text").dropDuplicates(["rep", "text"])
    return members, texts


def signed(texts: DataFrame, n: int, trees: int, shortest: int, depth: int) -> DataFrame:
    """``rep``, ``shingles`` (sorted hashes), ``keys`` and ``tails`` (one for each tree) of each text with a shingle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        words, signer, seen = re.compile(WORD).findall, Signer(trees, shortest, depth), {}
        for b in batches:
            reps, texts_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids, sets, keys, tails = [], [], [], []
            for rep, t in zip(reps, texts_):
                if len(seen) > 1 << 20:
                    seen.clear()
                s = shingle_hashes(words(t), n, seen)
                if len(s):
                    key, tail = signer.labels(s)
                    for column, value in zip((ids, sets, keys, tails), (rep, s.view(np.int64), key, tail)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets), _lists(keys), _lists(tails)], ["rep", "shingles", "keys", "tails"])

    return texts.mapInArrow(sign, "rep long, shingles array<long>, keys array<long>, tails array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


#: By how much the crowd is raised, step by step, for texts that miss the target recall; at last without limit.
RAISED = (1, 16, 256, None)


class Forest:
    """The tries of all labels, and where in each of them a text looks for others.

    ``placed``: a row for each text and tree in which its shortest prefix leads to another text too, with the
    node it looks in (``node``, of ``level`` values behind the shortest prefix, held by ``crowd`` texts).
    ``asks``: the further, shorter prefixes of the texts that need them.
    """

    def __init__(self, signatures: DataFrame, threshold: float, trees: int, shortest: int, depth: int, recall: float, crowd: int):
        self.extra, self.threshold = depth - shortest, threshold
        each = F.explode(F.arrays_zip("keys", "tails"))
        posted = signatures.select("rep", F.size("shingles").alias("size"), each.alias("l")).select("rep", "size", F.col("l.keys").alias("key"), F.col("l.tails").alias("tail"))
        # a key of one text meets nobody at any length; the others are few
        shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        met = materialize(posted.join(shared, "key"), "met")
        placed = met.join(self._levels(met, crowd), ["key", "tail"])
        self.placed = materialize(placed.withColumn("node", self._node(F.col("level0"))), "placed")
        self.texts = materialize(self._texts(trees, shortest, recall), "texts")
        self.asks = materialize(self._asks(), "asks")
        discard(met)

    def _prefix(self, level: Column) -> Column:
        return F.call_function("shiftright", F.col("tail"), (F.lit(self.extra) - level).cast("int") * BITS)

    def _node(self, level: Column) -> Column:
        return F.xxhash64("key", level.cast("int"), self._prefix(level))

    def _levels(self, met: DataFrame, crowd: int) -> DataFrame:
        """``key``, ``tail`` and for each step of RAISED the level of the node that a text of this label looks in.

        The labels are sorted; a node is a stretch of them. Counts are of texts, made over distinct labels.
        """
        labels = met.groupBy("key", "tail").agg(F.count(F.lit(1)).alias("n"))
        names = [f"p{j}" for j in range(1, self.extra + 1)]
        labels = labels.withColumns({p: self._prefix(F.lit(j)) for j, p in enumerate(names, 1)})
        held = labels.withColumns({f"n{j}": F.sum("n").over(Window.partitionBy("key", *names[:j])) for j in range(self.extra + 1)})

        def level(most: int | None) -> Column:
            out = F.lit(self.extra)
            for j in range(self.extra, -1, -1):
                out = F.when(F.col(f"n{j}") <= most, j).otherwise(out) if most is not None else F.lit(0)
            return out

        steps = {f"level{i}": level(crowd * r if r else None) for i, r in enumerate(RAISED)}
        held = held.withColumns(steps)
        in_node = F.lit(0)
        for j in range(self.extra + 1):
            in_node = F.when(F.col("level0") == j, F.col(f"n{j}")).otherwise(in_node)
        return held.select("key", "tail", *steps, in_node.alias("crowd"))

    def _texts(self, trees: int, shortest: int, recall: float) -> DataFrame:
        """``rep``, ``step`` of RAISED at which the text reaches the recall, ``single``: whether one meeting must do for it.

        At level j a text at the threshold is missed in a tree with probability 1 - t ** (shortest + j); a tree
        without a row here is one where even the shortest prefix leads to nobody else.
        """
        met = [self.threshold ** (shortest + j) for j in range(self.extra + 1)]
        missed, odds = [math.log1p(-p) for p in met], [p / (1 - p) for p in met]
        at = lambda values, i: F.sum(F.get(F.array(*map(F.lit, values)), F.col(f"level{i}")) - values[0]) + trees * values[0]
        least = math.log(1 - recall)
        step, one = F.lit(len(RAISED) - 1), F.lit(True)
        for i in range(len(RAISED) - 1, -1, -1):
            reached = at(missed, i) <= least
            step = F.when(reached, i).otherwise(step)
            # missed in all trees, or in all but one
            twice = at(missed, i) + F.log1p(at(odds, i)) <= least
            one = F.when(reached, ~twice).otherwise(one)
        return self.placed.groupBy("rep").agg(step.alias("step"), one.alias("single"))

    def _asks(self) -> DataFrame:
        """``rep``, ``size``, ``node``: prefixes shortened beyond the crowd, of texts whose recall would fall short."""
        asked = F.get(F.array(*[F.col(f"level{i}") for i in range(len(RAISED))]), F.col("step"))
        rows = self.placed.join(self.texts.where("step > 0"), "rep").withColumn("at", asked).where(F.col("at") < F.col("level0"))
        return rows.select("rep", "size", self._node(F.col("at")).alias("node"))

    def near(self, x: str, y: str) -> Column:
        """Whether sizes alone allow the threshold."""
        return F.least(x, y) >= F.lit(self.threshold) * F.greatest(x, y)

    def nodes(self) -> DataFrame:
        """``node``, ``rep``, ``size`` of the nodes that hold several texts."""
        return self.placed.where("crowd > 1").select("node", "rep", "size")

    def asked_pairs(self) -> DataFrame | None:
        """``a`` < ``b``: pairs met at the further prefixes; None where no text needs any."""
        if self.asks.isEmpty():
            return None
        levels = F.explode(F.filter(F.array(*[F.when(F.col("level0") > j, F.lit(j)) for j in range(self.extra)]), lambda j: j.isNotNull()))
        inner = self.placed.join(self.asks.select("rep").distinct().join(self.placed.select("rep", "key"), "rep").select("key").distinct(), "key", "left_semi")
        held = inner.select("*", levels.alias("at")).select(self._node(F.col("at")).alias("node"), F.col("rep").alias("y"), F.col("size").alias("sy"))
        pairs = self.asks.withColumnsRenamed({"rep": "x", "size": "sx"}).join(held, "node").where(F.col("x") != F.col("y")).where(self.near("sx", "sy"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def candidate_pairs(self) -> DataFrame:
        """``a`` < ``b``: each pair of texts that meet, once."""
        a = self.nodes().withColumnsRenamed({"rep": "a", "size": "sa"})
        b = self.nodes().withColumnsRenamed({"rep": "b", "size": "sb"})
        pairs = a.join(b, "node").where("a < b").where(self.near("sa", "sb")).select("a", "b")
        return self.enough(pairs)

    def enough(self, pairs: DataFrame) -> DataFrame:
        """``a`` < ``b``: of these pairs, a row for each meeting, and of those asked for the ones that met often enough.

        A tree may count twice where a text asks in it too, which only adds to what is compared.
        """
        asked = self.asked_pairs()
        counted = (pairs.unionByName(asked) if asked is not None else pairs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        single = self.texts.where("single").select("rep")
        often = counted.where("n > 1")
        once = counted.where("n = 1")
        for side in ("a", "b"):
            once = once.join(single.select(F.col("rep").alias(side), F.lit(True).alias(f"s{side}")), side, "left")
        return often.select("a", "b").unionByName(once.where("sa OR sb").select("a", "b"))


def verified(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """``a`` < ``b``, ``similarity``: the pairs whose exact Jaccard similarity is ``threshold`` or more."""
    sets = signatures.select("rep", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def _forest(rows: DataFrame, key: str, text: str, words: int, threshold: float, least_words: int, trees: int, depth: int, recall: float, crowd: int):
    members, texts = distinct_texts(rows, key, text, max(least_words, words))
    shortest = prefix_length(threshold, trees, depth, recall)
    signatures = materialize(signed(texts, words, trees, shortest, depth), "signatures")
    return members, signatures, Forest(signatures, threshold, trees, shortest, depth, recall, crowd)


def near_duplicates(
    rows: DataFrame,
    key: str = "id",
    text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    least_words: int = 0,
    trees: int = 48,
    depth: int = 7,
    recall: float = 0.9999,
    crowd: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """``members`` (``id``, ``rep``) and ``links`` (``a`` < ``b``, ``similarity``): all links between representatives of copies.

    Words are compared as they stand. Texts of fewer than ``words`` words have no shingle and no link.
    Rows given twice, and copies under other ids, are members of one class. Columns besides are passed over.
    """
    members, signatures, forest = _forest(rows, key, text, words, threshold, least_words, trees, depth, recall, crowd)
    return members, verified(forest.candidate_pairs(), signatures, threshold)


def near_duplicate_groups(
    rows: DataFrame,
    key: str = "id",
    text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    least_words: int = 0,
    trees: int = 48,
    depth: int = 7,
    recall: float = 0.9999,
    crowd: int = 64,
) -> DataFrame:
    """``id``, ``class_id``, ``copies``: one row for each row with a copy or a near copy; the group is its least id.

    The groups are those of all links, found without making all pairs of a family: in each node every text is
    compared with the least one. Two that are like it are in one group already, so only texts that aren't are
    compared with the rest of the node.
    """
    members, signatures, forest = _forest(rows, key, text, words, threshold, least_words, trees, depth, recall, crowd)
    nodes = forest.nodes()
    least = nodes.groupBy("node").agg(F.min(F.struct("rep", "size")).alias("least"))
    spokes = nodes.join(least, "node").where("rep <> least.rep")
    star = spokes.select(F.col("least.rep").alias("a"), F.col("least.size").alias("sa"), F.col("rep").alias("b"), F.col("size").alias("sb"))
    first = materialize(verified(star.where(forest.near("sa", "sb")).select("a", "b").distinct(), signatures, threshold), "spokes")
    loose = spokes.select("node", "rep", "size", F.col("least.rep").alias("a")).join(first.select("a", F.col("b").alias("rep")), ["a", "rep"], "left_anti")
    loose = loose.select("node", F.col("rep").alias("x"), F.col("size").alias("sx"))
    rest = spokes.select("node", F.col("rep").alias("y"), F.col("size").alias("sy"))
    pairs = loose.join(rest, "node").where("x <> y").where(forest.near("sx", "sy")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return grouped(members, first.unionByName(verified(forest.enough(pairs), signatures, threshold)))


def linked_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b``: every two rows whose texts differ and are linked, copies spelled out."""
    a = members.withColumnsRenamed({"id": "x", "rep": "a"})
    b = members.withColumnsRenamed({"id": "y", "rep": "b"})
    pairs = links.join(a, "a").join(b, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``class_id``, ``copies``: one row for each row with a copy or a link, and its group.

    Groups are connected components, by repeated spreading of the least number with pointer jumping: the
    rounds grow with the logarithm of a chain's length, and each is written to the shared folder, where it stays
    until the next round has been written.
    """
    links = materialize(links.select("a", "b").distinct(), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialize(edges.select(F.col("a").alias("rep")).distinct().select("rep", F.col("rep").alias("label")), "labels")
    while True:
        near = edges.join(label.withColumnsRenamed({"rep": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        spread = label.join(near.withColumnRenamed("a", "rep"), "rep", "left").select("rep", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        spread = materialize(spread, "spread")
        jump = spread.select(F.col("rep").alias("label"), F.col("label").alias("further"))
        jumped = materialize(spread.join(jump, "label", "left").select("rep", F.least("label", "further").alias("label"), "was"), "labels")
        done = jumped.where("label <> was").isEmpty()
        discard(spread)
        discard(label)
        label = jumped
        if done:
            break
    discard(links)
    label = label.select("rep", "label")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    of = sizes.join(label, "rep", "left").where("copies > 1 OR label IS NOT NULL")
    return members.join(of, "rep").select("id", F.coalesce("label", "rep").alias("class_id"), "copies")
