"""Suffix-array dedup over bytes by bucket-pointer refinement: repeated strings of 100 bytes are removed.

``repeats`` leaves the groups of 100-byte strings that share an anchor but not
all of their surroundings. Their suffixes are sorted by bucket-pointer
refinement: buckets of the first seven bytes come first, and each suffix points
to its bucket. A bucket of several members, equal for some depth, is sorted by
the pointers of the suffixes at that depth and falls into smaller ones, whose
depth is the sum of both; its members' pointers change at once and serve the
buckets refined after it. Buckets of one member, or as deep as 100 bytes, are
left alone. Neighbours that were told apart beyond 100 bytes are compared
directly. Of equal strings, all but the earliest are removed. Strings with
different anchors differ, so blocks of whole anchors are refined one by one in
bounded memory. Anchors with more than ``BLOCK`` open groups, which no block
could hold, go string by string through a shuffle on their hashes instead.

Defined results: null and empty texts have no bytes; texts of fewer bytes than
the length keep all; rows of equal id and text are one document; rows of equal
id and different texts are ordered by the hash of the text; null ids come last.
A cut inside a character leaves its remaining bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import kernels, repeats
from codequarry.llm.shared import written

#: Nine bits a byte, so that seven fit a number.
LENGTH, GRAM, FIRST = 100, 32, 7
BLOCK = 8_000
#: Members of buckets that are refined at a time, one bucket at least.
PORTION = 1 << 14
_ALONE = 1 << 40
_COUNT = (1 << 12) - 1


def byte_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), kernels.BYTE_CODES[data]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from every place on in one number; the end sorts before all bytes and is none."""
    packed = np.zeros(len(data) + 1, np.uint64)
    for k in range(size):
        packed <<= np.uint64(9)
        packed[: max(0, len(data) - k)] |= data[k:].astype(np.uint64) + np.uint64(1)
    return packed


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``begins``, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)


def suffix_order(data: np.ndarray, length: int, first: int = FIRST, portion: int = PORTION) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by ``length`` bytes at least, and the bucket pointer of each: the place of its bucket's first suffix.

    Suffixes of one bucket are equal for ``length`` bytes; some buckets are
    refined further, so that suffixes equal for ``length`` bytes may be in
    neighbouring ones.
    """
    packed = _grams(data, first)
    order = np.argsort(packed, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], packed[order[1:]] != packed[order[:-1]])))
    sizes = np.diff(np.append(begins, len(order)))
    pointer, depth = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    pointer[order], depth[order] = np.repeat(begins, sizes), np.repeat(np.where(sizes > 1, first, _ALONE), sizes)
    is_open = sizes > 1 if first < length else np.zeros(len(sizes), bool)
    begins, sizes = begins[is_open], sizes[is_open]
    while len(begins):
        left = []
        ends = np.cumsum(sizes)
        at = 0
        while at < len(begins):
            # Whole buckets; the pointers they get serve the portions after them.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + portion, "right")))
            here = _places(begins[at:to], sizes[at:to])
            bucket = np.repeat(np.arange(to - at), sizes[at:to])
            member = order[here]
            # Members of a bucket are equal for its depth, so that the bucket of what follows tells them apart.
            key = pointer[member + depth[member]]
            by = np.lexsort((key, bucket))
            member, key = member[by], key[by]
            order[here] = member
            new = np.ones(len(here), bool)
            new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(here)))
            lead = member[heads]
            deeper = np.where(counts > 1, depth[lead] + depth[lead + depth[lead]], _ALONE)
            pointer[member], depth[member] = np.repeat(here[heads], counts), np.repeat(deeper, counts)
            more = deeper < length
            left.append((here[heads][more], counts[more]))
            at = to
        begins, sizes = map(np.concatenate, zip(*left, strict=True))
    return order, pointer


def buckets(data: np.ndarray, length: int, first: int = FIRST, places: np.ndarray | None = None, portion: int = PORTION) -> np.ndarray:
    """Bucket of the string of ``length`` bytes at every start, or at ``places``: equal numbers for equal strings, in sorted order."""
    places = np.arange(len(data) - length + 1) if places is None else places
    size = min(first, length)
    order, pointer = suffix_order(data, length, size, portion)
    row = np.full(len(order), -1)
    row[places] = np.arange(len(places))
    asked = order[row[order] >= 0]
    before, after = asked[:-1], asked[1:]
    same = pointer[before] == pointer[after]
    # Buckets refined further than asked are joined again where the bytes are equal.
    packed, alive = _grams(data, size), np.flatnonzero(~same)
    for k in range(0, length, size):
        k = min(k, length - size)
        alive = alive[packed[before[alive] + k] == packed[after[alive] + k]]
    same[alive] = True
    out = np.empty(len(places), np.int64)
    out[row[asked]] = np.concatenate((np.zeros(min(1, len(asked)), np.int64), np.cumsum(~same)))
    return out


def _refined(block: pa.Table, length: int) -> pa.RecordBatch:
    """Starts in the groups of a block whose string is in an earlier group or place of its bucket."""
    data, bounds = kernels.buffer(block.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    id, tie, pos = (block.column(name).to_numpy() for name in ("id", "tie", "pos"))
    first, count = pos >> 12, pos & _COUNT
    which = np.repeat(np.arange(len(pos)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    bucket = buckets(data, length, places=bounds[which] + inside)
    start = first[which] + inside
    order = np.lexsort((start, tie[which], id[which], bucket))
    bucket, which, start = bucket[order], which[order], start[order]
    again = np.flatnonzero(np.concatenate(([False], bucket[1:] == bucket[:-1])))
    return pa.RecordBatch.from_arrays(
        [pa.array(id[which[again]]), pa.array(tie[which[again]]), pa.array((start[again] << 12) | 1)], names=["id", "tie", "pos"])


def refine(dealt: DataFrame, groups: DataFrame, scheme: repeats.Scheme, block_rows: int = BLOCK) -> DataFrame:
    """Repeated strings of open groups."""
    length = scheme.window
    crowded = written(groups.groupBy("k").count().where(F.col("count") > block_rows).select("k"))
    rest = groups.join(crowded, "k", "left_anti")
    among = repeats.compare_windows(dealt, groups.join(crowded, "k", "left_semi"), scheme)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 2):
            rows = []
            for id, tie, body, spans in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                data = body.encode()
                for span in spans:
                    first = span["pos"] >> 12
                    rows.append((span["k"], id, tie, span["pos"], data[first : first + (span["pos"] & _COUNT) + length - 1]))
            k, ids, ties, pos, pieces = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((k, ids, ties, pos, pieces), kinds, strict=True)], names=["k", "id", "tie", "pos", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if len(held) < block_rows:
                continue
            k = held.column("k").to_numpy()
            whole = int(np.searchsorted(k, k[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield _refined(held.slice(0, whole), length)
                held = held.slice(whole)
        if held is not None and len(held):
            yield _refined(held, length)

    fetched = repeats.with_spans(dealt, repeats.spans_of(rest, "k"), "inner").mapInArrow(
        fetch, "k bigint, id bigint, tie bigint, pos bigint, bytes binary")
    refined = fetched.repartition("k").sortWithinPartitions("k").mapInArrow(sort, "id bigint, tie bigint, pos bigint")
    return refined.unionByName(among)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""
    scheme = repeats.Scheme(length, gram, byte_codes)
    rows = repeats.identified(docs, id, text)
    spans = repeats.repeated_spans(rows, scheme, lambda dealt, groups: refine(dealt, groups, scheme))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 2):
            data, bounds = kernels.buffer(batch.column(2))
            out = []
            for k, places in enumerate(batch.column(3).to_pylist()):
                body = data[bounds[k] : bounds[k + 1]]
                gone = repeats.covered(places, length, len(body))
                kept = body[~gone].tobytes()
                out.append((len(body), len(body) - len(kept), len(kernels.runs(gone)[0]), sha256(kept).hexdigest(), kept))
            n, removed, runs, digest, kept = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(x, t) for x, t in zip((n, removed, runs, digest, kept), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    done = spans.mapInArrow(
        cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")
    return done.withColumn("id", repeats.original_id(F.col("id")))


def digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
