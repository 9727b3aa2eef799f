"""Runs of symbols that occurred earlier: which windows of a fixed size start again later.

A window counts as repeated if the same symbols also start earlier, in a
document that comes before or at an earlier place of the same one. Sending every
window through a shuffle would cost many times the corpus. Instead:

1. Every window has an anchor, the run of ``gram`` symbols inside it with the
   smallest hash (the leftmost of equal ones). Equal windows have equal anchors
   at equal offsets. Neighbouring windows mostly share theirs, so one row stands
   for a group: a maximal run of windows with one anchor.
2. Groups meet by the hash of their anchor. Those of equal contents are settled:
   all but the first are repeated as a whole. Only if one anchor has groups of
   different contents, the first of each content is open, as parts of them may
   be equal.
3. The windows of open groups are compared one by one by the operator.

Equal contents are reduced in every task before the shuffle, so an anchor in a
third of all documents sends one row per task; rows of one anchor are streamed
in sorted order and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm import kernels
from codequarry.llm.shared import shared_folder, written

_U = np.uint64
_LOW = (1 << 24) - 1
_COUNT_BITS = 12
_FLUSH = 1_000_000

#: Splits the bytes of some texts into symbols: row of each symbol, 64-bit code of each.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """Size of a window, size of an anchor, and the symbols."""

    window: int
    gram: int
    symbols: Symbols

    def groups(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Groups of windows: first start, number of windows, hash of the anchor, hash of the contents."""
        n = len(codes) - self.window + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2
        grams = kernels.windows(codes, self.gram)
        keys = (grams & ~_U(_LOW)) | (np.arange(len(grams)) & _LOW).astype(_U)
        least = kernels.sliding_min(keys, self.window - self.gram + 1)
        starts = np.flatnonzero(rows[:n] == rows[self.window - 1 :])
        anchor = (starts & ~_LOW) + (least[starts] & _U(_LOW)).astype(np.int64)
        anchor += np.where(anchor < starts, _LOW + 1, 0)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        first, count = starts[heads], np.diff(np.append(heads, len(starts)))
        contents = kernels.span_hashes(codes, first, first + count + self.window - 1)
        return first, count, grams[anchor[heads]], kernels.mix(contents + (anchor[heads] - first).astype(_U))


def identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, tie, text): ``tie`` tells apart rows of equal id, by their texts; null ids come last.

    Rows of equal id and text are one document.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.col(text).alias("text"))
    repeated = rows.groupBy("id").count().where("count > 1").limit(1).count()
    return rows.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("bigint")).alias("tie"), "text")


def packed(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << _COUNT_BITS) | count.astype(np.int64)


_NAMES = ["k", "c", "id", "tie", "pos", "settled"]
_SCHEMA = "k bigint, c bigint, id bigint, tie bigint, pos bigint, settled boolean"


def _reduced(k: np.ndarray, c: np.ndarray, id: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """All rows; of equal (k, c) all but the first are settled and get a key of their own."""
    order = np.lexsort((pos, tie, id, c, k))
    k, c, id, tie, pos = (x[order] for x in (k, c, id, tie, pos))
    settled = np.zeros(len(k), bool)
    settled[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    spread = kernels.mix((id * 31 + pos).view(_U)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.where(settled, spread, k), np.where(settled, 0, c), id, tie, pos, settled)], names=_NAMES)


def reduced(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, reduced in portions of about a million."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= _FLUSH:
            yield _reduced(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield _reduced(*map(np.concatenate, zip(*held, strict=True)))


def first_of_equals(rows: DataFrame, keep_open: bool) -> DataFrame:
    """Settle rows (k, c, id, tie, pos, settled) by their order within equal (k, c).

    Returns the repeated ones, ``open`` false; with ``keep_open`` also, ``open`` true,
    the first of each c where a k has several.
    """
    ordered = rows.repartition("k").sortWithinPartitions("k", "c", "id", "tie", "pos")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None  # first and last row of the group that may go on; was the first one open?
        first_open = False
        for batch in batches:
            if not len(batch):
                continue
            k, c, id, tie, pos = (batch.column(x).to_numpy() for x in range(5))
            given = batch.column(5).to_numpy(zero_copy_only=False)
            ahead = 0 if carry is None else 2
            if carry is not None:
                k, c, id, tie, pos = (np.concatenate((a, b)) for a, b in zip(carry, (k, c, id, tie, pos), strict=True))
                given = np.concatenate(([False, False], given))
            new_k = np.ones(len(k), bool)
            new_k[1:] = k[1:] != k[:-1]
            new_c = new_k.copy()
            new_c[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new_k) - 1
            several = np.zeros(group[-1] + 1, bool)
            several[group[new_c & ~new_k]] = True
            repeated = ~new_c | given
            is_open = new_c & ~given & several[group]
            out = repeated | is_open if keep_open else repeated
            if ahead:
                out[0] = keep_open and several[0] and not first_open
                repeated[0], out[1] = False, False
            start = int(np.flatnonzero(new_k)[-1])
            first_open = bool(several[-1]) or (start == 0 and first_open)
            carry = [x[[start, -1]] for x in (k, c, id, tie, pos)]
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[some]) for x in (k, id, tie, pos, ~repeated)], names=["k", "id", "tie", "pos", "open"])

    return ordered.mapInArrow(settle, "k bigint, id bigint, tie bigint, pos bigint, open boolean")


def anchored(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Groups of windows of (id, tie, text), reduced per task."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in kernels.slices(batches, 2):
            rows, codes = scheme.symbols(*kernels.buffer(batch.column(2)))
            first, count, anchors, contents = scheme.groups(rows, codes)
            base = np.searchsorted(rows, np.arange(len(batch)))
            row = rows[first]
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield anchors.view(np.int64), contents.view(np.int64), ids[row], ties[row], packed(first - base[row], count)

    return docs.mapInArrow(lambda batches: reduced(parts(batches)), _SCHEMA)


def spans_of(rows: DataFrame, *more: str) -> DataFrame:
    """Per document the positions of its rows. A document has fewer than it has symbols."""
    return rows.groupBy("id", "tie").agg(F.collect_list(F.struct("pos", *more) if more else F.col("pos")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents with their spans, met by a shuffle of both."""
    return docs.join(spans.hint("merge"), ["id", "tie"], how).select("id", "tie", "text", "spans")


def covered(spans: list[int] | None, window: int, n: int) -> np.ndarray:
    """Flags of the symbols of a document that windows of the spans cover."""
    pos = np.array(spans or [], np.int64)
    first, count = pos >> _COUNT_BITS, pos & ((1 << _COUNT_BITS) - 1)
    edges = np.bincount(first, minlength=n + 1) - np.bincount(first + count + window - 1, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def repeated_spans(
    docs: DataFrame, scheme: Scheme, compare: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Documents (id, tie, text) with the packed positions of all their repeated windows (null if none).

    ``compare`` gets the documents and the open groups (k, id, tie, pos) and returns the
    repeated spans (id, tie, pos) among these.
    """
    folder = shared_folder(docs.sparkSession)
    settled = written(first_of_equals(anchored(docs, scheme), keep_open=True), folder, "groups")
    dealt = docs.repartition("id", "tie")
    more = compare(dealt, settled.where("open").select("k", "id", "tie", "pos"))
    spans = spans_of(settled.where("not open").select("id", "tie", "pos").unionByName(more))
    return with_spans(dealt, spans, "left")


def compare_windows(dealt: DataFrame, groups: DataFrame, scheme: Scheme) -> DataFrame:
    """Repeated windows of open groups, by the Rabin-Karp hash of each window."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in kernels.slices(batches, 2):
            rows, codes = scheme.symbols(*kernels.buffer(batch.column(2)))
            base = np.searchsorted(rows, np.arange(len(batch)))
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            pos = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            first, count = pos >> _COUNT_BITS, pos & ((1 << _COUNT_BITS) - 1)
            which = np.repeat(np.arange(len(pos)), count)
            start = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
            row = row[which]
            at = base[row] + start
            hashes = kernels.span_hashes(codes, at, at + scheme.window) if len(at) else np.zeros(0, _U)
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield hashes.view(np.int64), np.zeros(len(at), np.int64), ids[row], ties[row], packed(start, np.ones(len(at)))

    rows = with_spans(dealt, spans_of(groups), "inner").mapInArrow(lambda batches: reduced(parts(batches)), _SCHEMA)
    return first_of_equals(rows, keep_open=False).select("id", "tie", "pos")


def original_id(id: Column) -> Column:
    return F.when(id < (1 << 63) - 1, id)
