"""Exclusion rules, sensitive names, scopes and root lookup as predicates that stay in generated code."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ancestors, normal_path

#: Folders left out by default (fixed values).
DEFAULT_EXCLUSIONS = (
    "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", "$Recycle.Bin", "System Volume Information", "AppData",
    ".git/objects", ".next", ".idea", ".git", ".svn", ".hg", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox",
    ".gradle", ".npm", ".old-node-modules", "node_modules.old", "node_modules.bak", ".pnpm-store", ".yarn/cache", ".yarn/unplugged",
    ".nuget/packages", ".vs", ".turbo", ".parcel-cache", ".vite", ".webpack", ".rollup.cache", ".svelte-kit", ".nuxt", ".angular/cache",
    "CMakeFiles", ".cxx", ".dart_tool", ".ipynb_checkpoints", "__pypackages__", "*.egg-info", "site-packages", "_internal", "obj",
    "bower_components", "coverage", "htmlcov", "Windows/WinSxS", "Windows/SoftwareDistribution", "Windows/Temp", "Windows/Installer",
    "ProgramData/Package Cache", "Recovery", "FileHistory", "WindowsImageBackup",
    "*-backup-20[0-9][0-9][01][0-9][0-3][0-9]-[0-9]*", "backup-20[0-9][0-9][01][0-9][0-3][0-9]-[0-9]*",
)
#: Names and extensions never taken in (fixed values).
SENSITIVE_NAMES = (".env", "id_rsa", "id_ed25519", "credentials", "login data")
SENSITIVE_EXTENSIONS = ("pem", "key", "pfx", "p12")


def sensitive(name: Column) -> Column:
    n = F.lower(name)
    return n.isin(*SENSITIVE_NAMES) | F.startswith(n, F.lit(".env.")) | n.rlike(r"[^.]\.(" + "|".join(SENSITIVE_EXTENSIONS) + ")$")


def _escape(text: str) -> str:
    return re.sub(r"([^\w/\s])", r"\\\1", text)


def glob_regex(pattern: str, crosses: bool) -> str:
    """A glob as a regular expression without anchors; ``*`` and ``?`` pass over ``/`` only if ``crosses``."""
    out, i, one = [], 0, "." if crosses else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i) and i + 2 == len(pattern):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(_escape(c))
        i += 1
    return "".join(out)


def _normal(rule: str) -> str:
    r = rule.strip().replace("\\", "/").lower()
    r = "//" + r[8:] if r.startswith("//?/unc/") else r.removeprefix("//?/")
    return r.rstrip("/")


class Exclusions:
    """Rules compiled to two regular expressions: one for the path below its root, one for the whole path."""

    def __init__(self, rules: Iterable[str]):
        relative: list[str] = []
        absolute: list[str] = []
        for rule in dict.fromkeys(map(_normal, rules)):
            if not rule:
                continue
            if rule[1:2] == ":" or rule.startswith("/"):
                absolute.append(glob_regex(rule, False) if "*" in rule or "?" in rule else _escape(rule))
            elif any(c in rule for c in "*?["):
                relative.append("^(?:" + glob_regex(rule, True) + ")(?:/.*)?$")  # an ancestor
                if "/" not in rule:
                    relative.append("(?:^|/)(?:" + glob_regex(rule, False) + ")(?:/|$)")  # one component
            else:
                relative.append("(?:^|/)" + _escape(rule) + "(?:/|$)")
        self.relative = "|".join(relative)
        self.absolute = "^(?:" + "|".join(absolute) + ")(?:/|$)" if absolute else ""

    def matches(self, path: Column, root: Column | None = None) -> Column:
        """Whether a path, in any spelling, is excluded; a component rule is looked for below ``root`` only."""
        full = normal_path(path)
        out = F.lit(False)
        if self.absolute:
            out = out | full.rlike(self.absolute)
        if self.relative:
            below = full if root is None else relative_path(full, normal_path(root))
            out = out | below.rlike(self.relative)
        return F.coalesce(out, F.lit(False))


def relative_path(full: Column, root: Column) -> Column:
    """A normal path without its root; the whole path where it doesn't lie below."""
    inside = F.startswith(full, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(full, F.length(root) + 2, F.length(full))).otherwise(full)


def excluded_by_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``excluded``, by the rules of each file's own root (a JSON array of its row).

    The rules are compiled where the roots are and joined to the files by root, so any number of roots will do.
    Broken JSON has no rules.
    """

    @F.pandas_udf("relative string, absolute string")
    def compiled(rules):
        import json

        import pandas as pd

        out = []
        for r in rules:
            try:
                made = json.loads(r or "[]")
            except ValueError:
                made = []
            e = Exclusions(x for x in made if isinstance(x, str)) if isinstance(made, list) else Exclusions([])
            out.append((e.relative or None, e.absolute or None))
        return pd.DataFrame(out, columns=["relative", "absolute"])

    made = roots.select(F.col("id").alias("root_id"), F.col("path").alias("__root"), compiled("exclusions").alias("__r"))
    joined = files.join(made.select("root_id", "__root", "__r.*"), "root_id", "left")
    full = normal_path(F.col("path"))
    hit = F.coalesce(F.rlike(relative_path(full, normal_path(F.col("__root"))), F.col("relative")), F.lit(False)) | F.coalesce(F.rlike(full, F.col("absolute")), F.lit(False))
    return joined.select(*[joined[c] for c in files.columns], hit.alias("excluded"))


def in_scope(path: Column, folder: str, recursive: bool = True) -> Column:
    """Whether a path lies in a folder; a range, so that Parquet statistics can skip what can't."""
    sep = "\\" if "\\" in folder else "/"
    base = folder.rstrip("\\/") + sep
    inside = (path >= base) & (path < base[:-1] + chr(ord(sep) + 1))
    return inside if recursive else inside & ~F.contains(F.substring(path, len(base) + 1, 1 << 20), F.lit(sep))


def overlaps(roots: DataFrame, places: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, ``path``: places (``id``, ``path``) that are a root or lie in one of another id, by an equi-join on ancestors."""
    tops = roots.select(F.col("id").alias("id_a"), normal_path(F.col("path")).alias("__above"))
    above = places.select(F.col("id").alias("id_b"), "path", F.explode(ancestors(normal_path(F.col("path")))).alias("__above"))
    return tops.join(above, "__above").where("id_a <> id_b").select("id_a", "id_b", "path")


def owning_root(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with ``owner``, the id of the root of longest path that it lies below; null if there is none.

    An equi-join on ancestors, not a comparison with every root: a path has as many ancestors as components.
    """
    keyed = paths.withColumn("__key", F.monotonically_increasing_id())
    parts = F.split(normal_path(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    exploded = keyed.select("*", F.explode_outer(above).alias("__above"))
    roots = roots.select(F.col("id").alias("__root"), normal_path(F.col("path")).alias("__above"))
    hit = exploded.join(roots, "__above", "left").groupBy("__key", *paths.columns)
    return hit.agg(F.max_by("__root", F.when(F.col("__root").isNotNull(), F.length("__above"))).alias("owner")).drop("__key")
