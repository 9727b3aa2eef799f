"""Bring an index up to date with a file table or a file tree.

All decisions are made on metadata; content is fetched, decoded and written
only for files that are new or changed, and crosses no shuffle but the one a
file table needs when the wanted paths are too many to broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.language import language_of
from ..functions.text import text_hash
from ..operators import diff, ignore, scope
from ..operators.langstats import line_numbers
from ..sources import filetree, schemas
from ..sources.scratch import Staging
from ..sources.store import IndexStore


class TableSource:
    """A file table ``path, size, mtime, content`` and optionally ``is_link``.

    ``ignore_files`` may hold the ignore files' ``path, content`` apart, which
    saves a scan of all content for them.
    """

    def __init__(self, table: DataFrame, ignore_files: DataFrame | None = None):
        if "is_link" not in table.columns:
            table = table.withColumn("is_link", F.lit(False))
        self.table = table
        self._ignore_files = table if ignore_files is None else ignore_files

    def listing(self, root: str, staging: Staging) -> DataFrame:
        return self.table.drop("content")

    def ignore_files(self, listing: DataFrame, names: Sequence[str]) -> DataFrame:
        return self._ignore_files.select("path", "content")

    def fetch(self, wanted: DataFrame, keep) -> DataFrame:
        """``wanted`` plus content; ``keep`` replaces the join where all kept files are wanted."""
        if keep is not None:
            return keep(self.table).withColumn("gen", F.lit(None).cast("bigint"))
        # Tied to a column of ``wanted``, so that tests on content stay above the
        # join and do not run on content nobody wants.
        content = F.when(F.col("status").isNotNull(), F.col("content"))
        return self.table.select("path", "content").join(wanted, "path").withColumn("content", content)


class TreeSource:
    """The file tree below the root, mounted on driver and executors."""

    def listing(self, root: str, staging: Staging) -> DataFrame:
        if not os.path.isdir(root):
            raise NotADirectoryError(root)
        return filetree.list_tree(staging.spark, root, staging)

    def ignore_files(self, listing: DataFrame, names: Sequence[str]) -> DataFrame:
        wanted = listing.where(paths.basename(F.col("path")).isin(*names))
        return filetree.read_content(wanted, spread=False).select("path", "content")

    def fetch(self, wanted: DataFrame, keep) -> DataFrame:
        return filetree.read_content(wanted, text_only=True)


def index_root(
    store: IndexStore,
    root: str,
    source: TableSource | TreeSource | None = None,
    extra_ignores: Sequence[str] = (),
    no_ignore: bool = False,
    size_limit: int = scope.DEFAULT_SIZE_LIMIT,
    ignore_names: Sequence[str] = scope.IGNORE_NAMES,
    reserved: Sequence[str] = (),
) -> dict[str, int]:
    """Index everything below ``root`` and return the run's counters.

    Without a ``source`` the file tree at ``root`` is read. Rows of the index
    outside ``root`` are left alone.
    """
    source = source or TreeSource()
    spark = store.spark
    root = paths.absolute(root)
    now = datetime.now().strftime("%Y-%m-%dT%H:%M:%S")
    before = store.snapshot()
    gen = before.next_generation

    with Staging(spark) as staging:
        # The index itself and what this run stages are no files of the root.
        own = reduce(Column.__or__, (paths.is_below(F.col("path"), local_path(f)) for f in (store.location, staging.folder)))
        listing = scope.below(source.listing(root, staging), root).where(~own)
        rules: list[ignore.RootRule] = []
        deeper = None
        if not no_ignore:
            sets = ignore.rule_sets(source.ignore_files(listing, ignore_names), root, ignore_names)
            sets = staging.write(sets, "rule_sets")
            rules = ignore.root_rules(spark, ignore.root_texts(sets, extra_ignores))
            nested = sets.where(F.col("base") != "")
            if not nested.isEmpty():
                chains = staging.write(ignore.rule_chains(nested), "chains")
                deeper = ignore.directory_rules(listing, root, rules, chains)
                deeper = deeper._replace(directories=staging.write(deeper.directories, "directories"))

        def flagged(files: DataFrame) -> DataFrame:
            """Files the walk would reach, with what it would skip marked."""
            reached = ignore.with_ignore_flags(scope.without_links(files.where(~own)), root, rules, deeper)
            skipped = F.col("ignored") | scope.is_reserved(ignore_names, reserved) | scope.is_oversize(size_limit)
            # Files whose metadata could not be read have no size.
            skipped = skipped | F.col("size").isNull()
            return reached.where(~F.col("pruned")).withColumn("skipped", skipped)

        seen = flagged(listing).select("path", "size", "mtime", "skipped")
        old = scope.below(before.files(), root)
        first = old.isEmpty()
        changes = diff.first_diff(seen) if first else diff.snapshot_diff(old, seen)
        changes = staging.write(changes, "changes", by="status")

        wanted = staging.read_parts(changes, "changes", "status", [diff.NEW, diff.CHANGED])
        keep = (lambda table: flagged(table).where(~F.col("skipped"))) if first else None
        texts = scope.text_files(source.fetch(wanted, keep)).select(
            "path", "size", "mtime", text_hash(F.col("text")).alias("text_hash"),
            line_numbers(F.col("text")).alias("n_lines"), language_of(F.col("path")).alias("language"),
            F.col("gen").alias("replaces"), "text", F.lit(None).cast("bigint").alias("block"),
        )
        written = store.write("content", gen, texts).drop("text", "block")

        store.write("files", gen, written.drop("replaces").withColumn("indexed_at", F.lit(now)))
        gone = staging.read_parts(changes, "changes", "status", [diff.REMOVED, diff.SKIPPED_REMOVED])
        superseded = written.where(F.col("replaces").isNotNull())
        store.write(
            "replaced", gen,
            superseded.select("path", F.col("replaces").alias("replaced_gen"))
            .unionByName(gone.select("path", F.col("gen").alias("replaced_gen"))),
        )
        given = schemas.local_table(spark, schemas.ROOTS, [(root, now)])
        store.write("roots", gen, new_roots(before.roots(), given))

        counts = diff.counters(changes, written.select(F.col("replaces").alias("gen"))).first().asDict()
        store.commit(gen, counts)
    return counts


def local_path(location: str) -> str:
    """The path by which a mounted tree shows a location; other file systems have no such path."""
    return f"/{location[5:].lstrip('/')}" if location.startswith("file:") else location


def new_roots(roots: DataFrame, given: DataFrame) -> DataFrame:
    """The rows of ``given`` whose path is not registered yet, one per path."""
    return given.dropDuplicates(["path"]).join(roots.select("path"), "path", "left_anti")
