"""Exact nearest neighbours of a few query vectors, by namespace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import usable_vector
from ..runtime import lowest_hashed

#: A file asks with at most so many of its vectors.
MAX_QUERIES = 64
#: So many query vectors travel with a plan; more are met in blocks.
MAX_BATCH = 1024
#: Vectors and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 4_096


def _good(rows: DataFrame, key: str, vector: str, namespace: str | None, name: str) -> DataFrame:
    """``name``, ``ns``, ``v`` (array<double>) of the vectors that are finite and not all zero."""
    ns = F.col(namespace) if namespace else F.lit(None).cast("string")
    good = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(usable_vector(F.col(vector), F.size(vector)))
    return good.select(F.col(key).cast("long").alias(name), ns.alias("ns"), F.col(vector).cast("array<double>").alias("v"))


def _kinds(names: list[str | None], column: pa.ListArray) -> Iterator[tuple[str | None, int, np.ndarray, np.ndarray]]:
    """For each namespace and length the rows of a batch and their unit vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    known = {n: i for i, n in enumerate(dict.fromkeys(names))}
    which = np.array([known[n] for n in names], np.int64)
    for ns, i in known.items():
        for length in np.unique(lengths[which == i]):
            rows = np.nonzero((which == i) & (lengths == length))[0]
            x = flat[starts[rows][:, None] + np.arange(length)]
            yield ns, int(length), rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class _Best:
    """The ``k`` best of each query so far."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, number: int, cosine: np.ndarray, ids: np.ndarray) -> None:
        if number in self.of:
            cosine, ids = np.concatenate([self.of[number][0], cosine]), np.concatenate([self.of[number][1], ids])
        top = np.lexsort((ids, -cosine))[: self.k]
        self.of[number] = cosine[top], ids[top]

    def meet(self, numbers: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """All queries of a kind against all vectors of it: one product for each 256 queries."""
        for at in range(0, len(q), 256):
            cosine = np.round(q[at : at + 256] @ x.T, 6)
            k = min(self.k, len(ids))
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
            for row, (n, low) in enumerate(zip(numbers[at : at + 256], least)):
                some = np.nonzero(cosine[row] >= low)[0]  # with all that tie
                self.add(int(n), cosine[row][some], ids[some])

    def columns(self) -> list[pa.Array]:
        out = [(n, i, c) for n, (cs, of) in self.of.items() for i, c in zip(of.tolist(), cs.tolist())]
        columns = list(zip(*out)) if out else [[], [], []]
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]


def nearest(
    vectors: DataFrame,
    queries: list[tuple[int, str, list[float]]],
    k: int,
    key: str = "id",
    vector: str = "vector",
    namespace: str | None = "namespace",
) -> DataFrame:
    """``qseq``, ``key``, ``cosine`` (rounded to 6 places), ``rank`` from 0: the ``k`` nearest of each query.

    ``queries``: number, namespace (null for any), vector; they travel with the plan, so at most MAX_BATCH:
    :func:`nearest_of` takes any number. Only vectors of the query's namespace and length count, and only
    finite ones that aren't all zero. Ties come by key. Each task keeps its own ``k`` best, so what is
    shuffled doesn't grow with a task's rows.
    """
    if len(queries) > MAX_BATCH:
        raise ValueError(f"more than {MAX_BATCH} query vectors: nearest_of() takes them as a DataFrame")
    asked: dict[tuple[str | None, int], tuple[list[int], list[np.ndarray]]] = {}
    for n, ns, v in queries:
        v = np.asarray(v, np.float64)
        if np.isfinite(v).all() and v.any():
            numbers, units = asked.setdefault((ns, len(v)), ([], []))
            numbers.append(int(n))
            units.append(v / np.linalg.norm(v))
    kinds = {x: (np.array(n, np.int64), np.array(u)) for x, (n, u) in asked.items()}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            for ns, length, rows, x in _kinds(b.column(1).to_pylist(), b.column(2)):
                for name in dict.fromkeys((ns, None)):
                    if (name, length) in kinds:
                        best.meet(*kinds[name, length], ids[rows], x)
        yield pa.RecordBatch.from_arrays(best.columns(), ["qseq", key, "cosine"])

    found = _good(vectors, key, vector, namespace, key).mapInArrow(local, f"qseq long, {key} long, cosine double")
    return _ranked(found, k, key)


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("qseq").orderBy(F.desc("cosine"), key)
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def nearest_of(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "id",
    vector: str = "vector",
    namespace: str | None = "namespace",
    asked_by: str = "qseq",
) -> DataFrame:
    """As :func:`nearest`, for any number of queries: a DataFrame with the same columns and their numbers in ``asked_by``.

    Blocks of vectors meet blocks of queries, each in a task of its own: a vector is sent once for each
    BLOCK_QUERIES queries, a query once for each BLOCK_ROWS vectors, and a task's memory is bounded.
    """
    good, asking = _good(vectors, key, vector, namespace, "id"), _good(queries, asked_by, vector, namespace, "qseq")
    n, m = good.count(), asking.count()
    rows, columns = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    all_of = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    good = good.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(rows).cast("long"))).select("id", "ns", "v", "i", all_of(columns).alias("j"))
    asking = asking.withColumn("j", F.pmod(F.xxhash64("qseq"), F.lit(columns).cast("long"))).select("qseq", "ns", "v", all_of(rows).alias("i"), "j")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        best = _Best(k)
        if a.num_rows and b.num_rows:
            of = lambda t: {(ns, length): (rows, x) for ns, length, rows, x in _kinds(t.column("ns").to_pylist(), t.column("v").combine_chunks())}
            ids, numbers, held = a.column("id").to_numpy(), b.column("qseq").to_numpy(), of(a)
            for x, (which, q) in of(b).items():
                if x in held:
                    best.meet(numbers[which], q, ids[held[x][0]], held[x][1])
        return pa.table(best.columns(), ["qseq", key, "cosine"])

    found = good.groupBy("i", "j").cogroup(asking.groupBy("i", "j")).applyInArrow(meet, f"qseq long, {key} long, cosine double")
    return _ranked(found, k, key)


#: Cells of a namespace at most; their pivots are on the driver and in every worker (16 MB for 1,024 components).
MAX_CELLS = 4096


class Cells:
    """Vectors by their nearest pivot, so that a search reads the cells nearest to its queries and not all vectors.

    Pivots are vectors of lowest hash, 2 * sqrt(n) of each namespace and length, at most MAX_CELLS. Every vector has a
    cell; how many cells a query reads is a matter of the recall wanted, all of them being the exact search.
    """

    SCHEMA = "namespace string, cell int, vector array<float>"

    def __init__(self, pivots: DataFrame):
        self.frame = pivots
        kinds: dict[tuple[str | None, int], tuple[list[int], list[np.ndarray]]] = {}
        for r in pivots.collect():  # at most MAX_CELLS for each namespace and length
            numbers, units = kinds.setdefault((r["namespace"], len(r["vector"])), ([], []))
            v = np.asarray(r["vector"], np.float64)
            numbers.append(r["cell"])
            units.append(v / np.linalg.norm(v))
        self.kinds = {k: (np.array(n, np.int32), np.array(u, np.float32)) for k, (n, u) in kinds.items()}

    @classmethod
    def of(cls, vectors: DataFrame, key: str = "id", vector: str = "vector", namespace: str = "namespace") -> Cells:
        good = _good(vectors, key, vector, namespace, "id").withColumn("length", F.size("v"))
        rows, first = [], 0
        for r in good.groupBy("ns", "length").count().orderBy("ns", "length").collect():  # a row for each kind
            n = min(MAX_CELLS, max(1, int(2 * r["count"] ** 0.5)))
            same = good.where(F.col("ns").eqNullSafe(F.lit(r["ns"])) & (F.col("length") == r["length"]))
            made = lowest_hashed(same.select("id", "v"), "id", n, r["count"], "v").collect()
            rows += [(r["ns"], first + i, [float(x) for x in m["v"]]) for i, m in enumerate(made)]
            first += len(made)
        return cls(vectors.sparkSession.createDataFrame(rows, cls.SCHEMA))

    def placed(self, rows: DataFrame, vector: str = "vector", namespace: str = "namespace") -> DataFrame:
        """``rows`` with ``cell``; null where a vector isn't usable or has no pivots of its kind."""
        kinds = rows.sparkSession.sparkContext.broadcast(self.kinds)

        @F.arrow_udf("int")
        def cell(names: pa.Array, vectors: pa.Array) -> pa.Array:
            out = np.full(len(names), -1, np.int32)
            there = np.nonzero(vectors.is_valid().to_numpy(zero_copy_only=False))[0]
            if len(there):
                some = vectors.take(pa.array(there))
                with np.errstate(all="ignore"):
                    for ns, length, at, x in _kinds(names.take(pa.array(there)).to_pylist(), some):
                        if (ns, length) in kinds.value:
                            numbers, pivots = kinds.value[ns, length]
                            good = np.isfinite(x).all(axis=1)
                            for a in range(0, len(at), 4096):
                                best = (x[a : a + 4096].astype(np.float32) @ pivots.T).argmax(axis=1)
                                out[there[at[a : a + 4096]]] = np.where(good[a : a + 4096], numbers[best], -1)
            return pa.array(out, pa.int32(), mask=out < 0)

        return rows.withColumn("cell", cell(F.col(namespace), F.col(vector).cast("array<double>")))

    def near(self, queries: list[tuple[int, str, list[float]]], probes: int) -> list[int]:
        """The ``probes`` cells nearest to each query, all together."""
        found: set[int] = set()
        for _, ns, v in queries:
            v = np.asarray(v, np.float64)
            if (ns, len(v)) in self.kinds and np.isfinite(v).all() and v.any():
                numbers, pivots = self.kinds[ns, len(v)]
                found.update(numbers[np.argsort(-(pivots @ v), kind="stable")[:probes]].tolist())
        return sorted(found)


def file_queries(chunks: DataFrame, file_id: int) -> list[tuple[int, str, list[float]]]:
    """The first MAX_QUERIES vectors of a file in order of ``seq``: what a file asks with."""
    rows = chunks.where((F.col("file_id") == file_id) & F.col("vector").isNotNull()).select("seq", "id", "namespace", "vector")
    return [(i, r["namespace"], r["vector"]) for i, r in enumerate(rows.orderBy("seq", "id").limit(MAX_QUERIES).collect())]
