"""Row filters on file tables: scope, names, size, links, content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, text as text_fn
from ..sources.schemas import local_table

# Fixed value: files above this size are not indexed unless asked for.
DEFAULT_SIZE_LIMIT = 2 * 1024 * 1024

# Names of the two ignore files, in the order they apply within a directory.
IGNORE_NAMES = (".gitignore", ".quarryignore")

# Ranges of paths that a scan is given for a path list of any length. Where paths are computed,
# each test repeats the expression, so there are few.
MOST_RANGES = 4


def below(files: DataFrame, root: str | None) -> DataFrame:
    """Rows below ``root``; all rows for None."""
    return files if root is None else files.where(paths.is_below(F.col("path"), root))


def among(files: DataFrame, wanted: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows whose path is listed; an empty list or None keeps all rows.

    ``wanted`` may also be a DataFrame with a ``path`` column of absolute
    paths, which is then always applied, even when it has no rows.
    """
    if isinstance(wanted, DataFrame):
        return files.join(wanted.select("path"), "path", "left_semi")
    if not wanted:
        return files
    absolute = sorted({paths.absolute(path) for path in wanted})
    listed = local_table(files.sparkSession, "path string", [(path,) for path in absolute])
    # Ranges with as many listed paths each; short lists are ranges of one path.
    size = -(-len(absolute) // MOST_RANGES)
    runs = [absolute[i : i + size] for i in range(0, len(absolute), size)]
    within = files.where(paths.in_ranges(F.col("path"), [(run[0], run[-1]) for run in runs]))
    return within.join(listed, "path", "left_semi").select(*files.columns)


def without_links(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_link"))


def is_reserved(ignore_names: Sequence[str] = IGNORE_NAMES, reserved: Sequence[str] = ()):
    """Names never indexed at any depth: the ignore files and ``reserved``."""
    return paths.basename(F.col("path")).isin([*ignore_names, *reserved])


def without_reserved(
    files: DataFrame,
    ignore_names: Sequence[str] = IGNORE_NAMES,
    reserved: Sequence[str] = (),
) -> DataFrame:
    return files.where(~is_reserved(ignore_names, reserved))


def is_oversize(size_limit: int = DEFAULT_SIZE_LIMIT):
    return F.col("size") > F.lit(size_limit)


def within_size(files: DataFrame, size_limit: int = DEFAULT_SIZE_LIMIT) -> DataFrame:
    """Files of at most ``size_limit`` bytes; the filter is pushed to the scan."""
    return files.where(F.col("size") <= F.lit(size_limit))


def text_files(files: DataFrame) -> DataFrame:
    """Rows whose content does not look binary, with ``text`` in its place."""
    return files.where(~text_fn.looks_binary(F.col("content"))).withColumn(
        "text", text_fn.decode_text(F.col("content"))
    ).drop("content")
