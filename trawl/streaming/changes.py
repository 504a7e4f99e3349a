"""Change events as a stream: debounced, ordered into small batches, and applied; running costs as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import depth

QUIET, BATCH = "500 milliseconds", 256
#: Events that look below their path.
RECURSIVE = ("create", "rename", "any", "other")


def intake(events: DataFrame, kind: str = "kind", included: Column | None = None) -> DataFrame:
    """Events without mere accesses and excluded paths, with ``recursive``."""
    kept = events.where(F.coalesce(F.col(kind) != "access", F.lit(True)))
    kept = kept.where(included) if included is not None else kept
    return kept.withColumn("recursive", F.coalesce(F.col(kind).isin(*RECURSIVE), F.lit(False)))


def debounced(events: DataFrame, time: str = "ts", path: str = "path", quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """``path``, ``started``, ``last``, ``events``, ``recursive``: one row for each burst of events of a path.

    Every event starts the quiet time anew, which is a session window. The same plan runs over a table and,
    with ``late``, the time that late events are waited for, over a stream.
    """
    rows = events.withWatermark(time, late) if late else events
    return (
        rows.groupBy(F.session_window(time, quiet).alias("w"), path)
        .agg(F.min(time).alias("started"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events"), F.bool_or("recursive").alias("recursive"))
        .drop("w")
    )


def next_batch(ready: DataFrame, path: str = "path", exists: str = "exists", n: int = BATCH) -> DataFrame:
    """The next changes to apply: existing paths before missing ones, parents before children."""
    return ready.orderBy(F.desc(exists), depth(F.col(path)), path).limit(n)


def covered(batch: DataFrame, path: str = "path") -> DataFrame:
    """A batch without paths that lie below a recursive one of it, by an equi-join on ancestors."""
    from ..functions.scalar import ancestors, normal_path

    keyed = batch.withColumn("__n", normal_path(F.col(path)))
    tops = keyed.where("recursive").select(F.col("__n").alias("__a")).distinct()
    above = keyed.select("__n", F.explode(F.filter(ancestors(F.col("__n")), lambda a: a != F.col("__n"))).alias("__a"))
    below = above.join(tops, "__a", "left_semi").select("__n").distinct()
    return keyed.join(below, "__n", "left_anti").drop("__n")


def apply_batch(files: DataFrame, batch: DataFrame, metadata: DataFrame, run: int) -> DataFrame:
    """``files`` after a batch (``path``, ``exists``): missing paths and all below them go, existing files are taken in.

    ``metadata`` has a row for each existing file of the batch; a path that is there and has none, as it can't
    be read, changes nothing. Files are found below a missing folder by an equi-join on their ancestors.
    """
    from ..functions.scalar import ancestors, normal_path
    from ..operators.upkeep import upsert

    missing = batch.where(~F.col("exists")).select(normal_path(F.col("path")).alias("__a")).distinct()
    above = files.select("id", F.explode(ancestors(normal_path(F.col("path")))).alias("__a"))
    gone = above.join(missing, "__a", "left_semi").select("id").distinct()
    return upsert(files.join(gone, "id", "left_anti"), metadata, run)


def overflowed(pending: int, limit: int = 8192) -> bool:
    """Whether so many paths wait that the roots are scanned instead."""
    return pending > limit


#: Samples before the last of a batch that still count: 0.8 to this power is below 1e-38.
RECENT = 400


def running_costs(samples: DataFrame, kind: str = "kind", seconds: str = "seconds", order: str = "id") -> DataFrame:
    """``kind``, ``samples``, ``cost`` after each batch of a stream: first sample, then 0.8 old and 0.2 new.

    A batch's samples come in any order and in several frames; they count in order of ``order``. Only the
    RECENT last of them are held, so a kind with a third of all samples is bounded memory. Null seconds are passed over.
    """

    def update(key, frames: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        n, cost = state.get if state.exists else (0, 0.0)
        here, first, places, values = 0, None, np.empty(0, np.int64), np.empty(0)
        for f in frames:
            f = f.dropna(subset=[seconds])
            if f.empty:
                continue
            here += len(f)
            least = f.nsmallest(1, order)
            if first is None or least[order].iloc[0] < first[0]:
                first = least[order].iloc[0], float(least[seconds].iloc[0])
            places, values = np.concatenate([places, f[order].to_numpy()]), np.concatenate([values, f[seconds].to_numpy(float)])
            last = np.argsort(places, kind="stable")[-RECENT:]
            places, values = places[last], values[last]
        if here:
            if n == 0:  # the very first sample is the average it begins with
                n, cost, here = 1, first[1], here - 1
                values = values[-here:] if here else values[:0]
            back = np.arange(len(values))[::-1]
            cost = cost * 0.8**here + float((0.2 * 0.8**back * values).sum())
            n += here
        state.update((n, cost))
        yield pd.DataFrame({"kind": [key[0]], "samples": [n], "cost": [cost]})

    return samples.groupBy(kind).applyInPandasWithState(
        update, "kind string, samples long, cost double", "samples long, cost double", "update", "NoTimeout"
    )


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each batch and its number to ``apply``; the number makes a repeated batch known."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote, in the shared folder."""
    from ..runtime import new_path

    path = new_path(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", path + "-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
