"""One object with all queries on one stored index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import diff, langstats
from ..operators import search as search_ops
from ..sources import schemas
from ..sources.store import IndexStore
from . import index as index_plan


class CodeIndex:
    """An index at ``location``: of one project, or of any number of roots.

    ::

        index = CodeIndex(spark, "hdfs:///indexes/code")
        index.index("/mnt/src")
        index.search("def parse", root="/mnt/src").show()
        index.stats().show()
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark = spark
        self.store = IndexStore(spark, location)

    def index(self, root: str, source=None, **options) -> dict[str, int]:
        """Bring ``root`` up to date; see :func:`plans.index.index_root`."""
        return index_plan.index_root(self.store, root, source, **options)

    def summary(self, counts: dict[str, int]) -> DataFrame:
        """The counters of a run as one line of text."""
        schema = ", ".join(f"{name} bigint" for name in counts)
        return diff.summary_line(schemas.local_table(self.spark, schema, [tuple(counts.values())]))

    def search(
        self,
        pattern: str,
        root: str | None = None,
        paths: Sequence[str] | DataFrame | None = None,
        max_results: int | None = search_ops.DEFAULT_MAX_RESULTS,
        case: bool = False,
    ) -> DataFrame:
        texts = self.store.snapshot().content_with(pattern, case)
        return search_ops.search(texts, pattern, root, paths, max_results, case)

    def search_envelope(
        self, pattern: str, root: str | None = None, max_results: int = search_ops.TOOL_MAX_RESULTS
    ) -> DataFrame:
        return search_ops.envelope(self.search(pattern, root, max_results=max_results))

    def stats(self, root: str | None = None, min_lines: int = langstats.DEFAULT_MIN_LINES) -> DataFrame:
        return langstats.language_stats(self.store.snapshot().files(), root, min_lines)

    def totals(self, root: str | None = None, min_lines: int = langstats.DEFAULT_MIN_LINES) -> DataFrame:
        return langstats.totals(self.store.snapshot().files(), root, min_lines)

    def stats_envelope(self, root: str | None = None) -> DataFrame:
        return langstats.stats_envelope(self.store.snapshot().files(), root)

    def files(self) -> DataFrame:
        """``path, size, mtime, text_hash, indexed_at``."""
        return self.store.snapshot().files().drop("gen", "n_lines", "language")

    def roots(self) -> DataFrame:
        return self.store.snapshot().roots().select("path").orderBy("path")

    def clear(self) -> int:
        """Empty the index and return how many files it held."""
        count = self.store.snapshot().files().agg(F.count("*").alias("n")).first().n
        self.store.clear()
        return count

    def compact(self, **layout) -> None:
        """Rewrite the index for reading; see :meth:`sources.store.IndexStore.compact`."""
        self.store.compact(**layout)
