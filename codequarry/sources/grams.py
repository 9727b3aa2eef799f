"""Which parts of a compacted index can hold a pattern, by grams of three bytes.

A block is a run of rows, in path order, with about ``BLOCK_BYTES`` of text. Per
block the numbers of all three-byte windows of its lower-cased texts are kept,
one row per gram and block in gram order, so that looking up the grams of a
pattern reads a few row groups. A block without one of them cannot hold the
pattern. Blocks are grouped into at most ``ZONES`` zones in path order; each zone
with candidates gives one range of paths, which the scan of texts gets as a
filter on ``path``: row groups and pages outside of all ranges are not read.

Grams only ever rule blocks out, so results are those of a search of everything.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import schemas

# The task functions below travel with the job, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 256 * 1024
ZONES = 64

_GRAM_BITS = 20
_SLICE_BYTES = 4 * 1024 * 1024
# A pattern is looked up by its first grams; more would rule out little else.
_MOST_GRAMS = 64


def numbers(data: np.ndarray) -> np.ndarray:
    """Numbers, below 2^20, of all three-byte windows of an array of bytes."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    wide = data.astype(np.uint32)
    window = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    return (window * np.uint32(0x9E3779B1)) >> np.uint32(32 - _GRAM_BITS)


def pattern_grams(spark: SparkSession, pattern: str, case: bool) -> list[int]:
    """Numbers of grams that the lower-cased form of every text with ``pattern`` holds.

    With ``case`` only windows of ASCII count: what other letters become in
    lower case can depend on the letters around them.
    """
    if case:
        data = np.frombuffer(pattern.encode().lower(), np.uint8)
        plain = data < 128
        sure = plain[:-2] & plain[1:-1] & plain[2:] if len(data) > 2 else np.zeros(0, bool)
        found = numbers(data)[sure]
    else:
        # Lowered by Spark, as the texts are; the row is local, so no job runs.
        row = schemas.local_table(spark, "pattern string", [(pattern,)]).select(F.lower("pattern").alias("low")).first()
        found = numbers(np.frombuffer(row.low.encode(), np.uint8))
    return list(dict.fromkeys(found.tolist()))[:_MOST_GRAMS]


def with_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` plus ``block``; every task numbers its own rows in their order."""
    texts = rows.columns.index("text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
            # The bytes before a row tell its block, so a long text ends one and begins none.
            before = held + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            held = int(before[-1])
            block = pa.array(first + before[:-1] // block_bytes, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, block], names=[*batch.schema.names, "block"])

    schema = StructType([*rows.schema.fields, StructField("block", LongType())])
    return rows.mapInArrow(number, schema)


def block_grams(content: DataFrame) -> DataFrame:
    """``gram, block`` of texts with a block; a few rows may occur twice."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << _GRAM_BITS, bool)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if start == end:
                    continue
                text = batch.column(1).slice(start, end - start).cast(pa.large_string())
                _, offsets, data = text.buffers()
                bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
                held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
                for at in range(0, len(held), _SLICE_BYTES):
                    seen[numbers(held[at : at + _SLICE_BYTES + 2])] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int32()), pa.array(np.full(len(found), blocks[start], np.int64))], names=["gram", "block"])

    texts = content.where(F.col("block").isNotNull()).select("block", F.lower("text").alias("text"))
    found = texts.where(F.col("text") != "").mapInArrow(grams, schemas.GRAMS)
    # By both columns, as a frequent gram is in every block.
    return found.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")


def block_table(content: DataFrame) -> DataFrame:
    """``block, zone, first, last``: zone and first and last path of every block."""
    ends = content.where(F.col("block").isNotNull()).groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    part = F.shiftright("block", 32)
    # A task of the writing job has as many blocks as its share of the texts.
    within = Window.partitionBy("part")
    placed = ends.withColumn("part", part).withColumns({
        "place": F.row_number().over(within.orderBy("block")) - 1, "places": F.count("*").over(within)
    })
    parts = content.agg(F.coalesce(F.max(part), F.lit(0)).alias("last")).first().last + 1
    zone = F.floor((F.col("part") + F.col("place") / F.col("places")) / parts * ZONES).cast("int")
    return placed.select("block", zone.alias("zone"), "first", "last")


def candidate_ranges(grams: DataFrame, blocks: DataFrame, wanted: Sequence[int]) -> list[tuple[str, str]]:
    """First and last path of each zone's blocks that hold all ``wanted`` grams: ``ZONES`` rows at most."""
    held = grams.where(F.col("gram").isin(list(wanted))).distinct().groupBy("block").agg(F.count("*").alias("n"))
    found = blocks.join(held.where(F.col("n") == len(wanted)).select("block"), "block", "left_semi")
    rows = found.groupBy("zone").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()
    return sorted((row.first, row.last) for row in rows)
