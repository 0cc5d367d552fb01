"""Pipeline configuration: JSON with comments, and paths."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, functions as F

COMMENT = "__comment__"


def without_comments(tree):
    """Drop, at every depth, keys and values that begin as comments do, with their partners; list entries too."""
    if isinstance(tree, dict):
        return {k: without_comments(v) for k, v in tree.items() if not k.startswith(COMMENT) and not _comment(v)}
    if isinstance(tree, list):
        return [without_comments(v) for v in tree if not _comment(v)]
    return tree


def _comment(value) -> bool:
    return isinstance(value, str) and value.startswith(COMMENT)


def read_parameters(path: str) -> dict:
    """The parameters of a JSON file, in the file's order, comments dropped."""
    with open(path, encoding="utf-8") as file:
        return without_comments(json.load(file))


def split_store_path(path: str, extensions: tuple[str, ...] = ("h5", "hdf5", "he5")) -> tuple[str, str]:
    """(file, path inside) of file.ext/inside; the first extension that occurs decides."""
    for ext in extensions:
        file, mark, inside = path.partition(f".{ext}")
        if mark and (not inside or inside.startswith("/")):
            if not inside.strip("/"):
                raise AssertionError(f"no path inside of {path}")
            return file + mark, "/" + inside.strip("/")
    raise ValueError(f"no known extension in {path}")


def matches_path(path: Column, pattern: str) -> Column:
    """True if each component of a path matches the pattern's component in full."""
    parts = [p for p in pattern.split("/") if p]
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    tests = [F.get(found, F.lit(k)).rlike(f"^(?:{p})$") for k, p in enumerate(parts)]
    result = F.size(found) == len(parts)
    for test in tests:
        result = result & F.coalesce(test, F.lit(False))
    return result


def matching_path_groups(paths: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """(level, name): for each level the distinct components of the paths that match."""
    hit = paths.filter(matches_path(F.col(column), pattern))
    return hit.select(F.posexplode(F.filter(F.split(column, "/"), lambda s: s != "")).alias("level", "name")).distinct()


def grouped_paths_found(paths: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """(path, found): every combination of the levels' components, and whether it exists. The combinations are the result's size."""
    levels = len([p for p in pattern.split("/") if p])
    groups = matching_path_groups(paths, pattern, column)
    combined = None
    for k in range(levels):
        names = groups.filter(F.col("level") == k).select(F.col("name").alias(f"n{k}"))
        combined = names if combined is None else combined.crossJoin(names)
    full = combined.select(F.concat(F.lit("/"), F.concat_ws("/", *[f"n{k}" for k in range(levels)])).alias("path"))
    there = paths.select(F.col(column).alias("path"), F.lit(True).alias("found")).distinct()
    return full.join(there, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


def expand_names(names: list[str], *patterns: str) -> list[str]:
    """For each pattern in turn, the names that match it."""
    return [n for p in patterns for n in sorted(names) if fnmatch(n, p)]
