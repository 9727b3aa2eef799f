"""Difference between an indexed snapshot and the files seen now.

Only metadata takes part: one full outer join on ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: modification times closer than this are equal.
MTIME_TOLERANCE = 1e-6

# What became of a path. A file is skipped when it is ignored, reserved or
# oversize; a skipped file that was indexed loses its row.
NEW = "new"
CHANGED = "changed"
UNCHANGED = "unchanged"
REMOVED = "removed"
SKIPPED = "skipped"
SKIPPED_REMOVED = "skipped_removed"


def same_version(old: str, new: str) -> Column:
    """Equal size and modification time of two aliased rows."""
    return (F.col(f"{old}.size") == F.col(f"{new}.size")) & (
        F.abs(F.col(f"{old}.mtime") - F.col(f"{new}.mtime")) < MTIME_TOLERANCE
    )


def snapshot_diff(old: DataFrame, seen: DataFrame) -> DataFrame:
    """``path, size, mtime, gen, status`` for every path of either side.

    ``old`` has ``path, size, mtime`` and ``gen`` (where the row is stored);
    ``seen`` has ``path, size, mtime`` and ``skipped``. Size and time are those
    seen now, or the old ones of paths no longer there.
    """
    before = F.col("o.path").isNotNull()
    status = (
        F.when(F.col("n.path").isNull(), REMOVED)
        .when(F.col("n.skipped") & before, SKIPPED_REMOVED)
        .when(F.col("n.skipped"), SKIPPED)
        .when(~before, NEW)
        .when(same_version("o", "n"), UNCHANGED)
        .otherwise(CHANGED)
    )
    joined = old.alias("o").join(seen.alias("n"), F.col("o.path") == F.col("n.path"), "full_outer")
    return joined.select(
        F.coalesce("n.path", "o.path").alias("path"),
        F.coalesce("n.size", "o.size").alias("size"),
        F.coalesce("n.mtime", "o.mtime").alias("mtime"),
        F.col("o.gen").alias("gen"),
        status.alias("status"),
    )


def first_diff(seen: DataFrame) -> DataFrame:
    """:func:`snapshot_diff` against an empty snapshot, without a join."""
    return seen.select(
        "path", "size", "mtime", F.lit(None).cast("bigint").alias("gen"),
        F.when(F.col("skipped"), SKIPPED).otherwise(NEW).alias("status"),
    )


def removed_paths(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths of ``old`` that are not in ``seen``."""
    return old.select("path").join(seen.select("path"), "path", "left_anti")


def counters(diff: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of run counters.

    ``stored`` has the ``path, gen`` rows of ``diff`` that were written; the
    other new and changed files are binary and count in ``total`` only.
    """
    written = stored.select(F.when(F.col("gen").isNull(), "added").otherwise("updated").alias("status"))
    status = F.col("status")
    return diff.select("status").unionByName(written).agg(
        F.count_if(status == "added").alias("added"),
        F.count_if(status == "updated").alias("updated"),
        F.count_if(status.isin(REMOVED, SKIPPED_REMOVED)).alias("removed"),
        F.count_if(status.isin(SKIPPED, SKIPPED_REMOVED)).alias("skipped"),
        F.count_if(status.isin(NEW, CHANGED, UNCHANGED)).alias("total"),
    )


def summary_line(counts: DataFrame) -> DataFrame:
    """``Indexed N files (+a, ~u, -r, skipped s)``."""
    return counts.select(
        F.format_string(
            "Indexed %d files (+%d, ~%d, -%d, skipped %d)",
            "total", "added", "updated", "removed", "skipped",
        ).alias("line")
    )
