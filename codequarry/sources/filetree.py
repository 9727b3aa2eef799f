"""File trees as tables.

Spark's ``binaryFile`` reader leaves out empty files and names starting with a
dot or an underscore, so :func:`list_tree` walks with tasks of its own, each going
down as far as its budget of directories lasts, and :func:`read_content` opens only
the files asked for. Both need the tree mounted on the executors.
"""

from __future__ import annotations

import io
import os
import sys
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.paths import absolute
from ..functions.text import CONTROL_BYTES, CONTROL_RATIO, SNIFF_BYTES
from . import schemas
from .scratch import Staging

# The task functions below travel with the job, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LIST_ROWS = 10_000
_READ_BYTES = 32 * 1024 * 1024
#: What may happen to single files while a tree is read; a lost mount or a broken disk is not among it.
_PASSED_OVER = (FileNotFoundError, PermissionError, NotADirectoryError, IsADirectoryError)
#: Directories that a task lists of its own accord, besides those it is given.
_TASK_FOLDERS = 256
_TASK_BYTES = 128 * 1024 * 1024

_CONTROL = CONTROL_BYTES.encode()
_SNIFF = SNIFF_BYTES
_RATIO = CONTROL_RATIO

_ENTRY = f"{schemas.LISTING}, is_dir boolean"


def binary_file_table(spark: SparkSession, location: str) -> DataFrame:
    """File table of ``binaryFile``: any Hadoop file system, but no empty files
    and no names starting with ``.`` or ``_``.

    A size filter on the result reaches the reader, and ``content`` is only
    read where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
        F.lit(False).alias("is_link"),
        "content",
    )


def list_tree(spark: SparkSession, root: str, staging: Staging) -> DataFrame:
    """All files and links below ``root``; links are not followed.

    Directories below the root that are gone or closed are passed over, files
    that are gone or closed have a null size and mtime; any other error ends the
    run. A task goes down from the directories it is given until its budget is
    spent and hands back those it has not opened, which the next round deals out
    anew; so the number of rounds follows the size of the tree and the tasks at
    work, not its depth. Each round is staged, so the loop holds the plan of one.
    """
    level = schemas.local_table(spark, "path string", [(absolute(root),)])
    listing = None
    depth, folders = 0, 1
    while True:
        # A number of tasks of its own, which adaptive execution does not pack into one.
        tasks = min(folders, max(spark.sparkContext.defaultParallelism, folders // _TASK_FOLDERS))
        listed = partial(_list_directories, required=depth == 0)
        entries = level.repartition(tasks, "path").mapInArrow(listed, _ENTRY)
        entries = staging.write(entries, f"tree/round={depth}")
        files = entries.where(~F.col("is_dir")).drop("is_dir")
        listing = files if listing is None else listing.unionByName(files)
        level = entries.where(F.col("is_dir")).select("path")
        folders = level.count()
        if not folders:
            return listing
        depth += 1


def read_content(files: DataFrame, spread: bool = True, text_only: bool = False) -> DataFrame:
    """``files`` plus their ``content``; files that are gone or closed are left out, other errors raised.

    With ``text_only`` files whose first bytes look binary are left out too, and no
    more of them is read than these bytes. With ``spread``, rows are dealt to tasks of bounded size by path range, so
    whatever is written from the result without a shuffle is clustered by path.
    """
    if spread:
        size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        tasks = max(size.bytes // _TASK_BYTES + 1, files.sparkSession.sparkContext.defaultParallelism)
        files = files.repartitionByRange(tasks, "path").sortWithinPartitions("path")
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.mapInArrow(partial(_read_files, text_only=text_only), schema)


def _list_directories(
    batches: Iterator[pa.RecordBatch], required: bool = False, budget: int = _TASK_FOLDERS
) -> Iterator[pa.RecordBatch]:
    """Entries of the directories given and of up to ``budget`` below them; those not opened are the ones with ``is_dir``."""
    rows: list[tuple] = []
    found: deque[tuple] = deque()

    def full() -> bool:
        return len(rows) >= _LIST_ROWS

    def listed(folder: str, required: bool = False) -> Iterator[pa.RecordBatch]:
        for row in _entries(folder, required):
            (found if row[-1] else rows).append(row)
            if full():
                yield _entry_batch(rows)
                rows.clear()

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            yield from listed(folder, required)
    for _ in range(budget):
        if not found:
            break
        yield from listed(found.popleft()[0])
    while found:
        rows.append(found.popleft())
        if full():
            yield _entry_batch(rows)
            rows.clear()
    if rows:
        yield _entry_batch(rows)


def _entries(folder: str, required: bool = False) -> Iterator[tuple]:
    """Entries of a directory, which may be gone or closed unless ``required``."""
    try:
        entries = os.scandir(folder)
    except _PASSED_OVER:
        if required:
            raise
        return
    with entries:
        for entry in entries:
            link = directory = False
            try:
                link = entry.is_symlink()
                directory = not link and entry.is_dir()
                if link or directory or entry.is_file():
                    stat = entry.stat(follow_symlinks=False)
                    yield entry.path, stat.st_size, stat.st_mtime, link, directory
            except _PASSED_OVER:
                if not directory:
                    yield entry.path, None, None, link, False


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
    names = ["path", "size", "mtime", "is_link", "is_dir"]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names)


def _is_binary(sample: bytes) -> bool:
    """The test of :func:`functions.text.looks_binary` on the first bytes of a file."""
    odd = len(sample) - len(sample.translate(None, _CONTROL))
    return b"\0" in sample or odd > 0 and odd / len(sample) > _RATIO


def _first_bytes(file: io.FileIO) -> bytes:
    """The sample of the binary test; one read may return less."""
    sample = b""
    while len(sample) < _SNIFF and (more := file.read(_SNIFF - len(sample))):
        sample += more
    return sample


def _read_files(batches: Iterator[pa.RecordBatch], text_only: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list[int] = []
        content: list[bytes] = []
        held = 0
        for i, path in enumerate(batch.column("path").to_pylist()):
            try:
                with open(path, "rb", buffering=0) as file:
                    sample = _first_bytes(file) if text_only else b""
                    if text_only and _is_binary(sample):
                        continue
                    content.append(sample + file.readall())
            except _PASSED_OVER:
                continue
            kept.append(i)
            held += len(content[-1])
            if held >= _READ_BYTES:
                yield _with_content(batch, kept, content)
                kept, content, held = [], [], 0
        if kept:
            yield _with_content(batch, kept, content)


def _with_content(batch: pa.RecordBatch, kept: list[int], content: list[bytes]) -> pa.RecordBatch:
    rows = batch.take(pa.array(kept, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(content, pa.binary())], [*rows.schema.names, "content"]
    )
