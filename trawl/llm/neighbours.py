"""The most similar vectors of every vector, through a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted file of each of
its first ``lists`` pivots. Two vectors meet in a list when they share one of those pivots; there they
are ranked by the footrule distance of their orders (a pivot missing from an order counts as the place
after the last), and only those that rank first are compared by cosine. Where a least cosine is asked for
these are all pairs within a distance that pairs of that cosine keep to, which is measured on a sample
(:func:`least_common`); else they are the first ``rerank`` of each row and all that tie with the last of them.

Among many near copies of each other the order of pivots tells little. Pivots that are near copies form
a group; where it has more pivots than a row has lists, all rows nearest to one of them meet, and all are compared.

Scale: a row is posted ``lists`` times, and with a number of pivots that grows as the root of the
number of vectors the work grows as its power 1.5. A list beyond ``block`` rows (a crowded pivot may
draw a third of all rows) is cut into blocks and every pair of blocks is searched by a task of its
own, so a task's memory is bounded and no pair is lost; a row of it is posted once for each block. So work and,
divided by ``block``, shuffle grow as the square of a crowded list or a group. Vectors that are equal are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, lowest_hashed, materialize

#: Pivots are a sample on the driver and in every worker: at most so many, 34 MB for 128 components.
MAX_PIVOTS = 1 << 16


def usable(chunks: DataFrame, namespaces: DataFrame, key: str = "id") -> DataFrame:
    """``id``, ``ns``, ``unit`` (float32 bytes, length 1) and ``print`` of each usable vector.

    Usable: as long as its namespace's ``dimensions``, all components finite and not null, not all zero.
    Rows of unknown namespaces are not usable. The vectors' lengths are checked in Spark, the rest in NumPy.
    """
    dims = namespaces.select("namespace", "dimensions").where("dimensions > 0").distinct()
    rows = (
        chunks.select(F.col(key).cast("long").alias("id"), "namespace", "vector")
        .where(F.col("vector").isNotNull() & F.col("id").isNotNull())
        .join(dims, "namespace")
        .where(F.size("vector") == F.col("dimensions"))
        .select("id", F.col("namespace").alias("ns"), F.col("vector").cast("array<float>").alias("vector"))
    )

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(2)
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # nulls become nan
            ids, ns, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, n, length in zip(ids, ns, lengths):
                x, at = flat[at : at + length], at + length
                size = float(np.sqrt(np.dot(x.astype(np.float64), x.astype(np.float64))))
                if not math.isfinite(size) or size == 0:
                    continue
                unit = (x.astype(np.float64) / size).astype(np.float32).tobytes()
                for column, value in zip(out, (i, n, unit, xxhash.xxh3_128_digest(unit))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                ["id", "ns", "unit", "print"],
            )

    return rows.mapInArrow(normalise, "id long, ns string, unit binary, print binary")


#: Cosine from which pivots are near copies; lower than what is asked for, as members of a group differ.
NEAR = 0.85


def groups(pivots: np.ndarray, least: int) -> np.ndarray:
    """A number for each pivot: of its group of near copies, linked by one another, or -1 where it has ``least`` pivots or fewer."""
    group = np.full(len(pivots), -1, np.int64)
    for start in range(len(pivots)):
        if group[start] >= 0:
            continue
        group[start], todo = start, np.array([start])
        while len(todo):
            rest = np.nonzero(group < 0)[0]
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(rest), 4096):  # bounded memory
                for of in range(0, len(todo), 1024):
                    reached[at : at + 4096] |= (pivots[rest[at : at + 4096]] @ pivots[todo[of : of + 1024]].T >= NEAR).any(axis=1)
            todo = rest[reached]
            group[todo] = start
    size = np.bincount(group, minlength=len(group))
    return np.where(size[group] > least, group, -1) if len(group) else group


#: Vectors that the footrule bound is measured on, in each namespace, and the share of pairs it may lose.
SAMPLE, LOST = 1024, 0.002


def least_common(pivots: np.ndarray, sample: np.ndarray, cosine: float, lists: int, order: int) -> int:
    """The footrule similarity that all but ``LOST`` of the pairs of this cosine have which meet in a list.

    Each vector of the sample is paired with itself turned by that angle in a random direction. Without a
    sample worth the name every pair that meets is compared.
    """
    n = min(order, len(pivots))
    if len(sample) < 64 or cosine <= 0:
        return 1
    rng = np.random.default_rng(3)
    aside = rng.normal(size=sample.shape).astype(np.float32)
    aside -= np.einsum("ij,ij->i", aside, sample)[:, None] * sample
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    turned = cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside
    a, b = (np.argsort(-(x @ pivots.T), axis=1)[:, :n] for x in (sample, turned))
    same = a[:, :, None] == b[:, None, :]
    weight = np.minimum.outer(n - np.arange(n), n - np.arange(n))
    similarity = (same * weight).sum((1, 2))
    met = same[:, :lists, :lists].any((1, 2))
    return max(1, int(np.floor(np.quantile(similarity[met], LOST)))) if met.any() else 1


def pivot_count(n: int) -> int:
    return max(16, min(MAX_PIVOTS, int(2 * math.sqrt(n))))


class PermutationIndex:
    """Pivots of each namespace, and the postings made with them.

    ``vectors`` as from :func:`usable`, already written once, as it is read several times. The pivots are
    the ``pivots`` vectors (default 2 * sqrt(n), at most MAX_PIVOTS) of lowest hash in their namespace:
    a bounded sample on the driver. Every row is indexed.
    """

    def __init__(self, vectors: DataFrame, lists: int = 5, order: int = 8, block: int = 8192, pivots: int | None = None):
        self.vectors, self.lists, self.order, self.block = vectors, lists, order, block
        counts = {r["ns"]: r["count"] for r in vectors.groupBy("ns").count().collect()}  # a row for each namespace
        self.names = sorted(counts)
        self.pivots: list[np.ndarray] = []
        self.samples: list[np.ndarray] = []
        for ns in self.names:
            m = min(pivots or pivot_count(counts[ns]), MAX_PIVOTS, counts[ns])
            rows = lowest_hashed(vectors.where(F.col("ns") == ns).select("id", "unit"), "id", m + SAMPLE, counts[ns], "unit").select("unit").collect()
            made = np.array([np.frombuffer(r["unit"], np.float32) for r in rows])
            self.pivots.append(made[:m])
            self.samples.append(made[m:])
        # a group's list has its own number, behind those of the pivots
        self.total = sum(map(len, self.pivots))
        base = np.cumsum([0, *map(len, self.pivots)])
        made = [groups(p, lists) for p in self.pivots]
        self.group = np.concatenate([np.where(g < 0, -1, g + b + self.total) for g, b in zip(made, base)] or [np.zeros(0, np.int64)])
        self.handle = vectors.sparkSession.sparkContext.broadcast((self.names, self.pivots))  # at most MAX_PIVOTS rows each

    def _bounds(self, least: float) -> np.ndarray:
        """For each list the least footrule similarity of pairs that are compared; 0 for the lists of groups."""
        each = [np.full(len(p), least_common(p, x, least, self.lists, self.order)) for p, x in zip(self.pivots, self.samples)]
        return np.concatenate([*each, np.zeros(self.total, np.int64)]) if each else np.zeros(0, np.int64)

    def _lists(self, depth: int):
        """A function that gives each row's lists, from its order of pivots; -1 is none."""
        group = self.group
        return lambda top: np.column_stack([top[:, :depth], group[top[:, 0]]])

    def _ordered(self, rows: DataFrame, depth: int) -> Iterator:
        """A function over batches of ``id, ns, unit`` that gives each row's list numbers and order of pivots."""
        handle, order = self.handle, self.order

        def nearest(b: pa.RecordBatch) -> Iterator[tuple]:
            names, pivots = handle.value
            base = np.cumsum([0, *map(len, pivots)])
            ids, ns, units = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2)
            which = np.array([names.index(n) for n in ns])
            for k in np.unique(which):
                rows = np.nonzero(which == k)[0]
                p = pivots[k]
                n = min(max(order, depth), len(p))
                step = max(32, (1 << 21) // len(p))  # bounded memory whatever the number of pivots
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    raw = units.take(pa.array(part))
                    x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(len(part), -1)
                    s = x @ p.T
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                    yield ids[part], raw, (top + base[k]).astype(np.int32)

        return nearest

    def _loads(self, rows: DataFrame, depth: int) -> dict[int, int]:
        """Rows in each list; as many entries as pivots."""
        nearest, lists_of = self._ordered(rows, depth), self._lists(depth)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for b in batches:
                for _, _, top in nearest(b):
                    for lst, n in zip(*np.unique(lists_of(top), return_counts=True)):
                        total[int(lst)] = total.get(int(lst), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["list", "n"])

        made = rows.select("id", "ns", "unit").mapInArrow(count, "list long, n long").where("list >= 0")
        return {r["list"]: r["n"] for r in made.groupBy("list").agg(F.sum("n").alias("n")).collect()}

    def search_all(self, k: int, rerank: int | None, least: float = -2.0) -> DataFrame:
        """``a, b, cosine``: for each vector its nearest found in each list; both directions, with repeats across lists."""
        blocks = {lst: -(-n // self.block) for lst, n in self._loads(self.vectors, self.lists).items()}
        nearest, lists_of, order = self._ordered(self.vectors, self.lists), self._lists(self.lists), self.order
        bounds = self._bounds(least)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, raw, top in nearest(b):
                    out: tuple[list, ...] = ([], [], [], [], [])
                    for column in lists_of(top).T:
                        for row, lst in enumerate(column.tolist()):
                            if lst < 0:
                                continue
                            g = blocks.get(lst, 1)
                            mine = (int(ids[row]) * 0x9E3779B97F4A7C15 >> 20) % g
                            for other in range(g):
                                for to, value in zip(out, (lst, min(mine, other), max(mine, other), mine, row)):
                                    to.append(value)
                    yield _postings(ids, raw, top[:, :order], out)

        def search(t: pa.Table) -> pa.Table:
            ids, part, perm, x = _read(t)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            first = Pick(int(bounds[t.column("list")[0].as_py()]), rerank)
            if i == j:
                return _found(ids, perm, x, ids, perm, x, k, first, least)
            q, d = part == i, part == j  # either may be empty
            one = _found(ids[q], perm[q], x[q], ids[d], perm[d], x[d], k, first, least)
            return pa.concat_tables([one, _found(ids[d], perm[d], x[d], ids[q], perm[q], x[q], k, first, least)])

        posted = self.vectors.select("id", "ns", "unit").mapInArrow(post, _POSTING)
        return posted.groupBy("list", "i", "j").applyInArrow(search, "a long, b long, cosine double")

    def search(self, queries: DataFrame, k: int, rerank: int | None, probes: int, least: float = -2.0) -> DataFrame:
        """``a, b, cosine`` for the ``queries`` (rows of the indexed vectors' form), each probing ``probes`` lists."""
        full, asked = self._loads(self.vectors, self.lists), self._loads(queries, probes)
        gd = {lst: -(-n // self.block) for lst, n in full.items()}
        gq = {lst: -(-n // self.block) for lst, n in asked.items()}
        order, bounds = self.order, self._bounds(least)

        def poster(nearest, depth: int, query: bool):
            mine_of, other_of = (gq, gd) if query else (gd, gq)
            lists_of = self._lists(depth)

            def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for ids, raw, top in nearest(b):
                        out: tuple[list, ...] = ([], [], [], [], [])
                        for column in lists_of(top).T:
                            for row, lst in enumerate(column.tolist()):
                                if lst not in other_of:  # nothing to meet there
                                    continue
                                mine = (int(ids[row]) * 0x9E3779B97F4A7C15 >> 20) % mine_of[lst]
                                for other in range(other_of[lst]):
                                    i, j = (other, mine) if query else (mine, other)
                                    for to, value in zip(out, (lst, i, j, int(query), row)):
                                        to.append(value)
                        yield _postings(ids, raw, top[:, :order], out)

            return post

        def search(t: pa.Table) -> pa.Table:
            ids, role, perm, x = _read(t)
            q, d = role == 1, role == 0
            first = Pick(int(bounds[t.column("list")[0].as_py()]), rerank)
            return _found(ids[q], perm[q], x[q], ids[d], perm[d], x[d], k, first, least)

        narrow = [f.select("id", "ns", "unit") for f in (self.vectors, queries)]
        data = narrow[0].mapInArrow(poster(self._ordered(self.vectors, self.lists), self.lists, False), _POSTING)
        asking = narrow[1].mapInArrow(poster(self._ordered(queries, probes), probes, True), _POSTING)
        return data.unionByName(asking).groupBy("list", "i", "j").applyInArrow(search, "a long, b long, cosine double")


_POSTING = "list int, i int, j int, part int, id long, perm binary, unit binary"


def _postings(ids: np.ndarray, raw: pa.Array, perm: np.ndarray, out: tuple[list, ...]) -> pa.RecordBatch:
    *keys, rows = out
    perms = [p.tobytes() for p in np.ascontiguousarray(perm)]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(k, pa.int32()) for k in keys),
            pa.array(ids[rows] if rows else [], pa.int64()),
            pa.array([perms[r] for r in rows], pa.binary()),
            raw.take(pa.array(rows, pa.int64())),
        ],
        ["list", "i", "j", "part", "id", "perm", "unit"],
    )


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = t.num_rows
    joined = [b"".join(t.column(c).to_pylist()) for c in ("perm", "unit")]
    perm = np.frombuffer(joined[0], np.int32).reshape(n, -1)
    return t.column("id").to_numpy(), t.column("part").to_numpy(), perm, np.frombuffer(joined[1], np.float32).reshape(n, -1)


def _pairs(a, b, c) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})


def footrule_similarity(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Twice this, taken from a constant, is the footrule distance of two orders.

    A pivot at place i of ``n`` weighs n - i, and 0 where it is missing; the distance is the sum of the
    weights' differences, so what two orders have in common is the sum of the lesser weights. Only rows that
    share a pivot are touched, pivot by pivot.
    """
    n = q.shape[1]
    kind = np.uint8 if n * (n + 1) // 2 < 256 else np.uint16
    out = np.zeros((len(q), len(d)), kind)

    def members(x: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        flat = x.ravel()
        at = np.argsort(flat, kind="stable")
        cut = np.nonzero(np.diff(flat[at], prepend=-1))[0]
        return {int(flat[g[0]]): (g // x.shape[1], (n - g % x.shape[1]).astype(kind)) for g in np.split(at, cut[1:]) if len(g)}

    of_d = members(d)
    for pivot, (rows, w) in members(q).items():
        if pivot in of_d:
            columns, v = of_d[pivot]
            common = np.minimum.outer(w, v)
            if len(rows) == len(q) and len(columns) == len(d):
                out += common  # every row has it: the list's own pivot
            else:
                out[rows[:, None], columns] += common
    return out


class Pick:
    """Which pairs of a list are compared: by footrule ``least`` similar or more, or the ``first`` of each row with all that tie."""

    def __init__(self, least: int, first: int | None):
        self.least, self.first = least, first

    def mask(self, q: np.ndarray, d: np.ndarray) -> np.ndarray | None:
        """None where it is all of them."""
        if self.least <= 0 or self.least == 1 and (self.first is None or self.first >= len(d)):
            return None
        close = footrule_similarity(q, d)
        if self.least > 1 or self.first is None:
            return close >= self.least
        last = -np.partition(-close.astype(np.int16), self.first - 1, axis=1)[:, self.first - 1]
        return close >= last[:, None]


#: From this share of picked pairs on one matrix product is less work than as many products of rows.
DENSE = 0.04


def _found(qi, qp, qx, di, dp, dx, k: int, pick: Pick, least: float) -> pa.Table:
    a, b, c = [], [], []
    least = max(least, -2.0)
    if len(qi) and len(di):
        for at in range(0, len(qi), 1024):
            rows = slice(at, at + 1024)
            mask = pick.mask(qp[rows], dp)
            if mask is not None and mask.mean() < DENSE:
                r, s = np.nonzero(mask)
                value = np.concatenate([np.einsum("ij,ij->i", qx[rows][r[i : i + 65536]], dx[s[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0, np.float32)])
            else:
                cos = qx[rows] @ dx.T
                if mask is not None:
                    cos[~mask] = -3
                if least <= -1:  # nearly all of them pass: the first k before they are listed
                    cos[qi[rows][:, None] == di[None, :]] = -3
                    m = min(k, len(di))
                    s = np.argpartition(-cos, m - 1, axis=1)[:, :m]
                    r = np.repeat(np.arange(len(s)), m)
                    s = s.ravel()
                else:
                    r, s = np.nonzero(cos >= least)
                value = cos[r, s]
            good = (value >= least) & (qi[rows][r] != di[s])
            r, s, value = r[good], s[good], value[good]
            order = np.lexsort((di[s], -value, r))
            r, s, value = r[order], s[order], value[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            best = nth < k
            a.append(qi[rows][r[best]])
            b.append(di[s[best]])
            c.append(value[best].astype(np.float64))
    return _pairs(np.concatenate(a), np.concatenate(b), np.concatenate(c)) if a else _pairs([], [], [])


def _top(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def copies(vectors: DataFrame) -> DataFrame:
    """``id``, ``rep`` of each vector that equals another one of its namespace; the rep is the lowest id."""
    narrow = vectors.select("id", "ns", "print")
    classes = narrow.groupBy("ns", "print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return narrow.join(classes, ["ns", "print"]).select("id", "rep")


def neighbours(
    chunks: DataFrame,
    namespaces: DataFrame,
    k: int = 10,
    least: float = -2.0,
    every: int | None = None,
    lists: int = 6,
    order: int = 8,
    probes: int = 6,
    rerank: int | None = None,
    pivots: int | None = None,
    key: str = "id",
) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``, ``rank`` (1 to ``k``): the most similar other rows of the same namespace.

    ``least`` leaves out pairs of lower cosine, before anything is shuffled. With ``every``, only rows whose
    id is divisible by it ask, against all rows. Ties come in the order of ids. Copies of a vector are found
    through the one of lowest id and all get their neighbours, each other included. A row given twice is a
    copy under the same id and is not its own neighbour. Null ids, and vectors that aren't usable, are passed over.
    """
    vectors = materialize(usable(chunks, namespaces, key), "units")
    same = materialize(copies(vectors).distinct(), "copies")
    extra = same.where("id <> rep").select("id")
    reps = vectors.dropDuplicates(["id", "print"]).drop("print") if _repeats(vectors) else vectors.drop("print")
    reps = reps.join(extra, "id", "left_anti")
    reps = materialize(reps, "reps")
    if every is not None:
        asking = vectors.where(F.col("id") % every == 0).select("id")
        asking = asking.join(same.withColumnRenamed("rep", "r"), "id", "left").select(F.coalesce("r", "id").alias("id")).distinct()
        asking = materialize(asking, "asking")
    discard(vectors)
    index = PermutationIndex(reps, lists, order, pivots=pivots)
    if every is None:
        pairs = index.search_all(k, rerank, least)
    else:
        pairs = index.search(index.vectors.join(asking, "id", "left_semi"), k, rerank, probes, least)
    top = _top(pairs, k)
    # of each class of copies only its k + 1 lowest ids can be anyone's neighbours
    first = same.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    others = (
        top.join(first.withColumnsRenamed({"rep": "b", "id": "m"}), "b", "left")
        .select("a", F.coalesce("m", "b").alias("b"), "cosine")
        .unionByName(first.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("b")))), 1, k + 1)
    of_rep = others.groupBy("a").agg(best.alias("best"))  # at most (k + 1) * (k + 1) each
    members = of_rep.join(same.withColumnsRenamed({"rep": "a", "id": "m"}), "a", "left").withColumn("m", F.coalesce("m", "a"))
    if every is not None:
        members = members.where(F.col("m") % every == 0)
    return (
        members.withColumn("best", F.slice(F.filter("best", lambda x: x["b"] != F.col("m")), 1, k))
        .select(F.col("m").alias("id"), F.posexplode("best").alias("rank", "one"))
        .select("id", F.col("one.b").alias("neighbour"), (-F.col("one.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
        .where(F.col("cosine") >= least)
    )


def _repeats(vectors: DataFrame) -> bool:
    return bool(vectors.groupBy("id").count().where("count > 1").limit(1).count())


def similar_pairs(chunks: DataFrame, namespaces: DataFrame, k: int = 10, least: float = 0.9, **options) -> DataFrame:
    """``id_a`` < ``id_b``, one among the other's ``k`` most similar, of cosine ``least`` or more."""
    found = neighbours(chunks, namespaces, k, least, **options)
    pair = F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    return found.select(*pair).distinct()
