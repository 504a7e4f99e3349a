"""A mix of several sources in which each has its target share of the tokens.

Poisson replication: a source's documents are repeated a Poisson-distributed number of times whose
mean is the repetition rate that gives the source its share. The count of a document is the inverse
of that distribution at a number hashed from its id, so it needs no state, is the same in every run,
and one pass over the documents makes the mix. A document never comes out more often than
``max_repeats``; the distribution is cut off there and its parameter raised so the mean stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .tokens import token_counts


#: Up to so many sources their rates are broadcast.
MANY_SOURCES = 10_000


def sized(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents with ``n_tokens``, the length of ``text`` in tokens of byte_bpe_50k."""
    return documents.withColumn("n_tokens", token_counts(documents.sparkSession, F.col(text), path))


def _below(lam: float, cap: int) -> Iterator[float]:
    """P(X <= k) for k = 0 to cap - 1 and X Poisson with mean ``lam``; terms are made as logarithms, so none vanishes early."""
    total, log_lam = 0.0, math.log(lam)
    for k in range(cap):
        total += math.exp(k * log_lam - lam - math.lgamma(k + 1))
        yield min(total, 1.0)


def mean_of_cut(lam: float, cap: int) -> float:
    """Mean of min(X, cap) for X Poisson with mean ``lam``: the sum of P(X > k) for k below cap."""
    return sum(1.0 - p for p in _below(lam, cap))


def thresholds(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0, 1, ...: a document comes out once for each of them that its number exceeds.

    ``rate`` at or above ``cap`` gives ``cap`` zeros, that is ``cap`` copies of every document.
    """
    if cap <= 0 or rate <= 0:
        return []
    if rate >= cap * (1 - 1e-9):
        return [0.0] * cap
    lo, hi = rate, rate + 1.0
    while mean_of_cut(hi, cap) < rate and hi < 1e9:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_of_cut(mid, cap) < rate else (lo, mid)
    out = []
    for p in _below(hi, cap):
        if p >= 1 - 1e-16:
            break
        out.append(p)
    return out


def mix_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source of ``targets``: tokens, the rate that gives it its share, and whether the cap allows it.

    ``documents`` needs ``source`` and ``n_tokens``. The size of the mix is that of all documents whose
    source is in ``targets``. A source without documents or tokens has rate 0. Repeated rows of
    ``targets`` count once; of a source with several rows the shares are added and the largest cap holds.
    Documents without a source, or with one that isn't listed, are no part of the mix.
    """
    wanted = (
        targets.select("source", "target_share", "max_repeats")
        .where(F.col("source").isNotNull())
        .distinct()
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .withColumns({"target_share": F.coalesce("target_share", F.lit(0.0)), "max_repeats": F.coalesce("max_repeats", F.lit(0))})
    )
    # combined on the map side: one row for each source and task, however large a source is
    sizes = documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    plan = wanted.join(sizes, "source", "left").na.fill(0, ["tokens", "documents"])
    total = plan.agg(F.sum("tokens").alias("mix_tokens"))  # one row
    plan = plan.crossJoin(F.broadcast(total))
    goal = F.col("target_share") * F.col("mix_tokens")
    rate = F.when(F.col("tokens") > 0, goal / F.col("tokens")).otherwise(F.lit(0.0))
    return plan.select(
        "source",
        "target_share",
        F.col("max_repeats").cast("int").alias("max_repeats"),
        "tokens",
        "documents",
        "mix_tokens",
        F.least(rate, F.col("max_repeats").cast("double")).alias("rate"),
        (F.col("max_repeats") * F.col("tokens") >= goal).alias("reaches"),
    )


def _thresholds(rate: str, cap: str) -> Column:
    @F.pandas_udf("array<double>")
    def at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rates, caps in batches:
            yield pd.Series([thresholds(float(r), int(c)) for r, c in zip(rates, caps)])

    return at(rate, cap)


def replicate(documents: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Every document of a listed source as often as its number says, with ``copy_no`` from 1; not in any order."""
    rates = plan.select("source", _thresholds("rate", "max_repeats").alias("__at"))
    # a row for each listed source; few of them are sent to every task, so a source that holds a third of the
    # documents isn't one task's work. Should there be many, the planner joins and splits what is skewed
    if plan.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES:
        rates = F.broadcast(rates)
    number = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("source")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return (
        documents.join(rates, "source")
        .withColumn("__u", number)
        .withColumn("__n", F.size(F.filter("__at", lambda x: x < F.col("__u"))))
        .where(F.col("__n") > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .drop("__at", "__u", "__n")
    )


def mix(documents: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix in a global random order, and the report of its shares.

    ``documents`` needs ``key``, ``source`` and ``text``; columns besides are carried along unless they
    clash with ``n_tokens`` or ``copy_no``, which are made anew. The tokens are counted once.
    """
    documents = materialize(sized(documents.drop("n_tokens", "copy_no"), text, path), "sized")
    plan = mix_plan(documents, targets)
    copies = replicate(documents, plan, key, seed)
    shuffled = copies.orderBy(F.xxhash64(F.lit(seed + 1), F.col(key).cast("string"), F.col("copy_no")), F.col(key), "copy_no")
    return shuffled, shares(replicate(documents.select(key, "source", "n_tokens"), plan, key, seed), plan)


def report(documents: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, path: str | None = None) -> DataFrame:
    """The shares of the same mix without writing its texts: only their sizes are kept."""
    narrow = materialize(sized(documents.select(key, "source", text), text, path).drop(text), "sizes")
    plan = mix_plan(narrow, targets)
    return shares(replicate(narrow, plan, key, seed), plan)


def shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of each source; null actual shares where the mix is empty."""
    used = copies.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"))
    out = plan.join(used, "source", "left").na.fill(0, ["used_tokens", "used_documents"])
    total = out.agg(F.sum("used_tokens").alias("__all"))
    return (
        out.crossJoin(F.broadcast(total))  # one row
        .withColumn("actual_share", F.when(F.col("__all") > 0, F.col("used_tokens") / F.col("__all")))
        .withColumn("repeats", F.when(F.col("tokens") > 0, F.col("used_tokens") / F.col("tokens")).otherwise(F.lit(0.0)))
        .drop("__all")
    )
