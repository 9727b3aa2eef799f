"""Path expressions.

Paths are plain ``/``-separated strings. Nothing here touches a file system
except :func:`absolute`, which resolves a root given by the caller.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

_TO_END = 2**31 - 1


def absolute(path: str) -> str:
    """The absolute form of a path given by the caller.

    URIs (``scheme://...``) are already absolute and are only stripped of
    trailing slashes; local ones (``file:/...``) become plain paths.
    """
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return path.rstrip("/")
    return os.path.abspath(path)


def root_prefix(root: str) -> str:
    """The prefix every path below ``root`` starts with (``/`` for ``/``)."""
    return absolute(root).rstrip("/") + "/"


def is_below(path: Column, root: str) -> Column:
    """Exact, case-sensitive descendant test; reaches Parquet as StringStartsWith."""
    return path.startswith(root_prefix(root))


def in_ranges(path: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """True from the first to the last path of any range; reaches Parquet as ranges.

    A balanced tree of tests, whose depth is the logarithm of their number.
    """
    tests = [path.between(first, last) for first, last in ranges] or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def relative(path: Column, root: str) -> Column:
    """The path without its root prefix; only meaningful for rows below ``root``."""
    return F.substring(path, len(root_prefix(root)) + 1, _TO_END)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory; the parent of ``/a`` is ``/`` and that of ``a`` is empty."""
    head = F.left(path, F.length(path) - F.length(basename(path)))
    stripped = F.rtrim(head, F.lit("/"))
    return F.when(stripped == "", head).otherwise(stripped)


def extension(name: Column) -> Column:
    """Last extension of a base name with its dot, or the empty string.

    Leading dots belong to the name: ``.env`` has no extension.
    """
    stem = F.ltrim(name, F.lit("."))
    return F.when(
        F.contains(stem, F.lit(".")),
        F.concat(F.lit("."), F.substring_index(stem, ".", -1)),
    ).otherwise("")


def ancestor(directory: Column, depth: Column) -> Column:
    """The first ``depth`` names of a relative directory."""
    return F.call_function("substring_index", directory, F.lit("/"), depth)


def depths(directory: Column) -> Column:
    """Depths of a relative directory and the directories above it, from 1 on."""
    return F.sequence(F.lit(1), F.size(F.split(directory, "/")))


def lineage(directory: Column) -> Column:
    """A relative directory after all directories above it, outermost first."""
    return F.transform(depths(directory), lambda depth: ancestor(directory, depth))
