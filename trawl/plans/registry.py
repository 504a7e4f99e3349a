"""Every query of the core by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``covers`` lists the survey's operators."""

    def register(f: Query) -> Query:
        ENTRIES[f.__name__] = Entry(f, sql, covers)
        return f

    return register
