"""The stored index: append-only Parquet generations.

Each run writes one generation of every table and then, as its last step, a
commit. Rows a run replaces or removes are listed in ``replaced`` by path and
generation and left out on reading, so a run writes in proportion to what
changed and never rewrites the corpus. Readers see the generations committed
when they ask, which nothing overwrites later. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.paths import in_ranges
from . import grams, schemas
from .scratch import file_system

TABLES = {
    "files": schemas.FILES,
    "content": schemas.CONTENT,
    "replaced": schemas.REPLACED,
    "roots": schemas.ROOTS,
    "grams": schemas.GRAMS,
    "blocks": schemas.BLOCKS,
}

#: Layout of compacted texts: what a filter on ``path`` can skip.
ROW_GROUP_BYTES = 8 * 1024 * 1024
_PAGE_ROWS = 64


class Snapshot:
    """The tables of an index as of one list of commits."""

    def __init__(self, store: IndexStore, commits: list[Row]):
        self._store = store
        self._gens = [row.gen for row in commits]
        self._compacted = bool(commits) and commits[0].base
        self._replaces = any(row.updated or row.removed for row in commits)

    @property
    def next_generation(self) -> int:
        return self._gens[-1] + 1 if self._gens else 1

    def files(self) -> DataFrame:
        """``path, size, mtime, text_hash, n_lines, language, indexed_at, gen`` of the indexed files."""
        return self._live("files", self._read("files", self._gens))

    def content(self) -> DataFrame:
        """``path, text`` and the metadata of the indexed texts.

        Every stored text belongs to exactly one files row, so reading texts
        needs no join with ``files``.
        """
        return self._live("content", self._read("content", self._gens)).drop("replaces", "gen", "block")

    def content_with(self, pattern: str, case: bool) -> DataFrame:
        """:meth:`content` without most texts that cannot hold ``pattern``.

        The grams of the compacted generation are looked up now, in a job of its
        own; later generations are read whole.
        """
        wanted = grams.pattern_grams(self._store.spark, pattern, case) if self._compacted else []
        if not wanted:
            return self.content()
        base, later = self._gens[:1], self._gens[1:]
        ranges = grams.candidate_ranges(self._read("grams", base), self._read("blocks", base), wanted)
        rows = self._read("content", base).where(in_ranges(F.col("path"), ranges))
        if later:
            rows = rows.unionByName(self._read("content", later))
        return self._live("content", rows).drop("replaces", "gen", "block")

    def roots(self) -> DataFrame:
        """``path, created_at`` of the registered roots."""
        return self._read("roots", self._gens).drop("gen")

    def _live(self, table: str, rows: DataFrame) -> DataFrame:
        if not self._replaces:
            return rows
        # Both sides have a known size on disk, by which Catalyst chooses
        # between broadcasting the replaced keys and a shuffle.
        replaced = self._read("replaced", self._gens).select("path", F.col("replaced_gen").alias("gen"))
        return rows.join(replaced, ["path", "gen"], "left_anti")

    def _read(self, table: str, gens: Sequence[int]) -> DataFrame:
        schema = f"{TABLES[table]}, gen bigint"
        spark = self._store.spark
        if not gens:
            return schemas.local_table(spark, schema)
        reader = spark.read.schema(schema).option("basePath", f"{self._store.location}/{table}")
        return reader.parquet(*(self._store.folder(table, gen) for gen in gens))


class IndexStore:
    def __init__(self, spark: SparkSession, location: str):
        self.spark = spark
        self.location = location.rstrip("/")

    def snapshot(self) -> Snapshot:
        """What is committed now, from the last base on: one small row per run."""
        try:
            rows = self.spark.read.schema(schemas.COMMITS).json(f"{self.location}/commits").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        rows.sort(key=lambda row: row.gen)
        if len({row.gen for row in rows}) < len(rows):
            raise ValueError(f"two runs wrote the same generation of {self.location}")
        base = max((i for i, row in enumerate(rows) if row.base), default=0)
        return Snapshot(self, rows[base:])

    def write(self, table: str, gen: int, rows: DataFrame, **layout) -> DataFrame:
        """Write a table of an uncommitted generation and return it as read back.

        Leftovers of a run that failed before its commit are overwritten.
        """
        rows.write.mode("overwrite").options(**layout).parquet(self.folder(table, gen))
        return self.spark.read.schema(TABLES[table]).parquet(self.folder(table, gen))

    def commit(self, gen: int, counts: dict[str, int], base: bool = False) -> None:
        """Make a generation visible; with ``base``, all earlier ones invisible.

        The commit is a file named by the generation, so of two writers of one
        generation the second is refused and the index stays readable.
        """
        row = {"gen": gen, "base": base, **{name: counts.get(name, 0) for name in _COUNTERS}}
        system, path = file_system(self.spark, f"{self.location}/commits/{gen:012d}.json")
        try:
            stream = system.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise ValueError(f"another run has written generation {gen} of {self.location}") from None
        try:
            stream.write(f"{json.dumps(row)}\n".encode())
        finally:
            stream.close()

    def compact(self, block_bytes: int = grams.BLOCK_BYTES, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
        """Rewrite the live rows as one generation clustered by path, with its grams.

        Scoped reads and searches then skip row groups and pages, and reads lose
        their join with ``replaced``.
        """
        now = self.snapshot()
        gen = now.next_generation
        texts = now.content().withColumn("replaces", F.lit(None).cast("bigint"))
        ordered = texts.repartitionByRange("path").sortWithinPartitions("path")
        content = self.write("content", gen, grams.with_blocks(ordered, block_bytes), **{
            "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(_PAGE_ROWS),
            "parquet.columnindex.truncate.length": "4096",
        })
        self.write("grams", gen, grams.block_grams(content))
        self.write("blocks", gen, grams.block_table(content))
        self.write("files", gen, now.files().drop("gen"))
        self.write("roots", gen, now.roots())
        self.write("replaced", gen, self._empty("replaced"))
        self.commit(gen, {}, base=True)

    def clear(self) -> None:
        """Start over with a base generation that holds nothing."""
        gen = self.snapshot().next_generation
        for table in TABLES:
            self.write(table, gen, self._empty(table))
        self.commit(gen, {}, base=True)

    def folder(self, table: str, gen: int) -> str:
        return f"{self.location}/{table}/gen={gen}"

    def _empty(self, table: str) -> DataFrame:
        return schemas.local_table(self.spark, TABLES[table])


_COUNTERS = ("added", "updated", "removed", "skipped", "total")
