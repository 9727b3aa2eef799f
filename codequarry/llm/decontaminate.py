"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of ``window`` words of the test items. For each pattern
length there are a shift table on blocks of up to three words, which lets the
search skip the places where no pattern can end; buckets of patterns by their
last block, looked up where the shift is zero; and a direct comparison.

Patterns reach the tasks as broadcasts of at most ``slice_entries`` windows each.
A larger benchmark is searched for in several passes over the documents, with
the hits so far carried along, so a task never holds more than one slice.

Defined results: null and word-less texts have no words, no hits, no items; an
item without words is never found; an item shorter than the window is one
window; windows that items share count for each of them; items without an id
count as hits and are no items found; rows of equal id are
separate documents; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from codequarry.llm import kernels
from codequarry.llm.shared import free_name, schema_with, with_column, written

WORD = rb"[0-9a-z\x80-\xff]+"
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 3

FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(IntegerType())),
    StructField("items", ArrayType(StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


class Patterns:
    """Shift tables and suffix buckets of patterns (words joined by one space) with their items."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        items: dict[bytes, list[str]] = defaultdict(list)
        for window, item in entries:
            items[window.encode()].append(item)
        self.by_length = {}
        for window, of in items.items():
            words = window.split(b" ")
            size, block = len(words), min(_BLOCK, len(words))
            shifts, buckets = self.by_length.setdefault(size, ({}, defaultdict(list)))
            for end in range(block, size + 1):
                key = b" ".join(words[end - block : end])
                shifts[key] = min(shifts.get(key, size), size - end)
            buckets[key].append((words, of))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Start and end of every occurrence, and the items found."""
        spans, found, n, join = [], set(), len(words), b" ".join
        for size, (shifts, buckets) in self.by_length.items():
            block = min(_BLOCK, size)
            skip, shift, end = size - block + 1, shifts.get, size
            while end <= n:
                step = shift(join(words[end - block : end]), skip)
                if step:
                    end += step
                    continue
                for pattern, of in buckets[join(words[end - block : end])]:
                    if words[end - size : end] == pattern:
                        spans.append((end - size, end))
                        found.update(item for item in of if item is not None)
                end += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat starts and ends of the unions of overlapping or touching spans."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def benchmark_windows(items: DataFrame, window: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): each run of ``window`` words of each item, or the item if it is shorter."""
    words = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(_SQL_WORD), 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        items.select(F.col(item).cast("string").alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("window"))
        .distinct()
    )


def with_contamination(
    docs: DataFrame, items: DataFrame, name: str = "contamination", text: str = "text", window: int = 10,
    item: str = "item_id", slice_entries: int = 200_000,
) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, hits (flat starts and ends of hit words), items found."""
    spark = docs.sparkSession
    windows = written(benchmark_windows(items, window, item, text="text"))
    n_slices = max(1, -(-windows.count() // slice_entries))
    shard = F.pmod(F.xxhash64("window"), F.lit(n_slices))
    text_at, out = docs.columns.index(text), docs
    for k in range(n_slices):
        entries = [(row.window, row.item) for row in windows.where(shard == k).toLocalIterator()]
        shared = spark.sparkContext.broadcast(entries)
        last = name if k == n_slices - 1 else free_name(docs.columns, f"found_{k}")

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, k=k, last=last) -> Iterator[pa.RecordBatch]:
            patterns, word = Patterns(shared.value), re.compile(WORD)
            for batch in kernels.slices(batches, text_at):
                data, bounds = kernels.buffer(batch.column(text_at))
                earlier = batch.column(batch.num_columns - 1).to_pylist() if k else [None] * len(batch)
                rows = []
                for i, before in enumerate(earlier):
                    words = word.findall(data[bounds[i] : bounds[i + 1]].tobytes().lower())
                    spans, found = patterns.search(words)
                    if before:
                        spans += zip(before["hits"][::2], before["hits"][1::2], strict=True)
                        found.update(before["items"])
                    rows.append({"n_words": len(words), "hits": merged(spans), "items": sorted(found)})
                kept = batch.select(range(batch.num_columns - 1)) if k else batch
                yield with_column(kept, last, pa.array(rows, _ARROW))

        out = out.mapInArrow(scan, schema_with(docs, last, FOUND))
    return out


def n_hit(found: Column) -> Column:
    """Number of hit words from the flat starts and ends."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(found["hits"])), F.lit(0).cast("bigint"),
        lambda total, i: total + F.coalesce(
            F.when(i % 2 == 0, -F.get(found["hits"], i)).otherwise(F.get(found["hits"], i)), F.lit(0)
        ),
    )


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", window: int = 10) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = with_contamination(rows, items, "found", window=window)
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of any item."""
    name = free_name(docs.columns, "contamination")
    return with_contamination(docs, items, name, text, window).where(F.size(F.col(name)["hits"]) == 0).drop(name)
