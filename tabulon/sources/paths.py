"""Paths, globs and shard folders, in natural order (run_2 before run_10)."""

from __future__ import annotations

import glob
import os
import re

EXTENSION = ".parquet"


def natural(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", str(path))]


def has_magic(path: object) -> bool:
    return isinstance(path, str) and any(c in path for c in "*?[")


def expand(path: str) -> list[str]:
    found = sorted(glob.glob(path, recursive=True), key=natural)
    if not found:
        raise FileNotFoundError(f"nothing matches {path}")
    return found


def shards(directory: str) -> list[str]:
    return sorted((os.path.join(directory, f) for f in os.listdir(directory) if f.endswith(EXTENSION) and not f.startswith((".", "_"))), key=natural)


def is_spark_output(path: str) -> bool:
    """A folder that Spark wrote as one table (its part files are one file of ours)."""
    return os.path.isdir(path) and path.rstrip("/").endswith(EXTENSION)


def resolve(source: object) -> list[str]:
    """The files of a path, a glob string or a shard folder, in order; remote paths stay as they are."""
    if has_magic(source):
        return expand(source)
    path = os.fspath(source)
    if "://" in path or is_spark_output(path):
        return [path]
    if os.path.isdir(path):
        return shards(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]
