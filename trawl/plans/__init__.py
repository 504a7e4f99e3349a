from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, further, general, maintenance, retrieval  # noqa: F401
from .registry import ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}
