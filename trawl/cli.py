"""python -m trawl.cli INDEX add|index|search|status ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .request import Request


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawl")
    p.add_argument("index", help="folder of the index")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add", help="add a location")
    add.add_argument("path")
    sub.add_parser("index", help="scan all locations and work off the queue")
    sub.add_parser("status")
    s = sub.add_parser("search")
    s.add_argument("query", nargs="*")
    s.add_argument("--folder", help="only below this folder")
    s.add_argument("--similar", type=int, help="id of a file to compare with")
    s.add_argument("--mode", default="smart", choices=("smart", "exact", "semantic"))
    return p


def query_text(words: list[str], folder: str | None) -> str:
    return " ".join([*words, *([f'path:"{folder}"'] if folder else [])])


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), a.index)
    if a.command == "add":
        print(engine.add_root(a.path))
    elif a.command == "index":
        print(engine.start_index())
    elif a.command == "status":
        engine.status().show()
    else:
        engine.search(Request(query_text(a.query, a.folder), a.mode), a.similar).show(truncate=False)


if __name__ == "__main__":
    main()
