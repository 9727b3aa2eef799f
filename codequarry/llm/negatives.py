"""Hard negatives of anchor vectors by Kronecker-packed exact inner products.

Components become the integers floor(256 x). Several candidates are packed into
one wide integer per component: each is biased to be non-negative and put into a
field of its own, wide enough for any sum. One multiplication by an anchor's
component then multiplies all fields, the sum over components holds one whole inner product
per field, and shifting, masking and taking off the bias unpacks exact scores. The
wide integers stay below 2^53 and are carried as doubles, which hold such integers
exactly, so that a matrix product does the sums; where one field alone needs more
bits they are Python's unbounded integers in the same code.

The anchors are a stated query set, compared with all rows in blocks: rows are
dealt into slices by a hash, anchors too, and each pair of slices is one group of
bounded size, whatever ids, labels or copies there are. A first pass keeps the best
rows of an anchor's own label, a second, knowing their scores, the best rows of other
labels between the bounds. Only the few best of each slice leave a task; ranks
among them are given by windows.

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part; a shorter vector ends in zeros; rows of equal id are separate rows;
ties of score go by id, then as they come; an anchor without another row of its label
or a positive without negatives has no rows; an empty table gives no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry.llm.shared import written

# Fixed value: how a component becomes an integer.
SCALE = 256.0

#: Bytes of components that a slice of rows or of anchors holds, and the least number of slices of rows.
SLICE_BYTES = 16 * 1024 * 1024
LEAST_SLICES = 48
#: Scores that are held at once.
_TILE = 1 << 21


class Packing(NamedTuple):
    """How components of magnitude up to ``bias`` in ``dims`` dimensions are packed."""

    dims: int
    bias: int

    @property
    def offset(self) -> int:
        """No sum of a field is below minus this."""
        return self.dims * self.bias * 2 * self.bias

    @property
    def width(self) -> int:
        return (2 * self.offset + 1).bit_length()

    @property
    def fields(self) -> int:
        return max(1, 52 // self.width)

    @property
    def kind(self):
        return np.float64 if self.width <= 52 else object

    def matrix(self, vectors: list[list[int]]) -> np.ndarray:
        """Rows of integers, ended by zeros where they are short."""
        out = np.zeros((len(vectors), self.dims), self.kind)
        for row, vector in zip(out, vectors, strict=True):
            row[: len(vector)] = vector
        return out

    def packed(self, candidates: np.ndarray) -> np.ndarray:
        """Wide integers of ``fields`` candidates each: (words, dims). The last is filled up with zeros."""
        words = -(-len(candidates) // self.fields)
        biased = np.zeros((words * self.fields, self.dims), self.kind)
        biased[: len(candidates)] = candidates + self.bias
        wide = biased[:words]
        for field in range(1, self.fields):
            wide = wide + biased[field * words : (field + 1) * words] * (1 << (field * self.width))
        return wide

    def scores(self, anchors: np.ndarray, wide: np.ndarray, count: int) -> np.ndarray:
        """Inner products of anchors with the ``count`` candidates packed in ``wide``: (anchors, count)."""
        if not len(anchors) or not count:
            return np.zeros((len(anchors), count), np.int64 if self.kind is np.float64 else object)
        rest = anchors @ wide.T + self.offset * sum(1 << (field * self.width) for field in range(self.fields))
        taken = self.offset + anchors.sum(axis=1) * self.bias
        out = []
        for field in reversed(range(self.fields)):
            one = rest // (1 << (field * self.width))
            rest = rest - one * (1 << (field * self.width))
            out.append(one - taken[:, None])
        whole = np.concatenate(out[::-1], axis=1)[:, :count]
        return whole.astype(np.int64) if self.kind is np.float64 else whole


def usable(id: Column, label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return id.isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def prepared(docs: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """Usable rows as a written table: row (a number of its own), id, label, parts (integer components)."""
    parts = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("bigint"))
    rows = docs.where(usable(F.col(id), F.col(label), F.col(vector))).select(F.col(id).alias("id"), F.col(label).alias("label"), parts.alias("parts"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _slices(rows: DataFrame, dims: int, least: int) -> int:
    return max(least, -(-rows.count() * 8 * max(dims, 1) // SLICE_BYTES))


class _Grid(NamedTuple):
    """Slices of rows and of anchors; every pair of them is one cell."""

    rows: int
    anchors: int

    def of_rows(self, rows: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("row"), F.lit(self.rows))
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(self.anchors - 1)))).withColumn(
            "cell", own * self.anchors + F.col("other")).drop("other")

    def of_anchors(self, anchors: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("row"), F.lit(self.anchors))
        return anchors.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(self.rows - 1)))).withColumn(
            "cell", F.col("other") * self.anchors + own).drop("other")


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


class _Side(NamedTuple):
    """Rows of one side of a cell, by id."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    parts: np.ndarray
    more: list


def _side(table: pa.Table, packing: Packing, labels: dict, more: str | None = None) -> _Side:
    table = table.sort_by([("id", "ascending"), ("row", "ascending")])
    codes = [labels.setdefault(label, len(labels)) for label in _column(table, "label")]
    return _Side(
        np.array(_column(table, "row"), np.int64), np.array(_column(table, "id"), object), np.array(codes, np.int64),
        packing.matrix(_column(table, "parts")), _column(table, more) if more else [])


def _best(scores: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each line of scores the first ``most`` columns by score, then column."""
    for k, line in enumerate(scores):
        if len(line) > 4 * most:
            least = np.partition(line, len(line) - most)[len(line) - most]
            columns = np.flatnonzero(line >= least)
        else:
            columns = np.arange(len(line))
        yield k, columns[np.argsort(-line[columns], kind="stable")][:most]


def _positives(packing: Packing, most: int, kind: pa.DataType):
    def of_cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        labels: dict = {}
        left, right = _side(anchors, packing, labels), _side(rows, packing, labels)
        found: list[tuple] = []
        for label in np.unique(left.label):
            mine, others = np.flatnonzero(left.label == label), np.flatnonzero(right.label == label)
            wide, step = packing.packed(right.parts[others]), max(1, _TILE // max(1, len(others)))
            for some in (mine[i : i + step] for i in range(0, len(mine), step)):
                scores = packing.scores(left.parts[some], wide, len(others))
                # One more than asked for, as the anchor itself may be among them.
                for k, columns in _best(scores, most + 1):
                    own = left.row[some[k]]
                    kept = [c for c in columns if right.row[others[c]] != own][:most]
                    found += [(own, right.row[others[c]], right.id[others[c]], scores[k, c]) for c in kept]
        columns = list(zip(*found)) or [()] * 4
        return pa.table({
            "anchor": pa.array(map(int, columns[0]), pa.int64()), "row": pa.array(map(int, columns[1]), pa.int64()),
            "id": pa.array(columns[2], kind), "score": pa.array(map(int, columns[3]), pa.int64())})

    return of_cell


def _negatives(packing: Packing, most: int, low: int, high: int, kind: pa.DataType):
    def of_cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        labels: dict = {}
        left, right = _side(anchors, packing, labels, "positives"), _side(rows, packing, labels)
        wide, step = packing.packed(right.parts), max(1, _TILE // max(1, len(right.row)))
        bounds = [[(-(-low * s // 100), high * s // 100) for s in scores] for scores in left.more]
        found: list[tuple] = []
        for i in range(0, len(left.row), step):
            some = range(i, min(i + step, len(left.row)))
            scores = packing.scores(left.parts[i : i + step], wide, len(right.row))
            floor = np.array([min(lo for lo, _ in bounds[k]) for k in some], scores.dtype)
            ceiling = np.array([max(hi for _, hi in bounds[k]) for k in some], scores.dtype)
            near = (scores >= floor[:, None]) & (scores <= ceiling[:, None]) & (right.label[None] != left.label[i : i + step, None])
            lines, columns = np.nonzero(near)
            values = scores[lines, columns]
            # By line, then falling score; equal scores stay in the order of ids.
            order = np.argsort(-values, kind="stable")
            order = order[np.argsort(lines[order], kind="stable")]
            lines, columns, values = lines[order], columns[order], values[order]
            starts = np.searchsorted(lines, np.arange(len(some) + 1))
            for k in range(len(some)):
                begin, end = starts[k], starts[k + 1]
                if begin == end:
                    continue
                falling = -values[begin:end]
                for place, (lo, hi) in enumerate(bounds[i + k]):
                    first = begin + int(np.searchsorted(falling, -hi, "left"))
                    for at in range(first, min(first + most, end)):
                        if values[at] < lo:
                            break
                        c = columns[at]
                        found.append((left.row[i + k], place, right.row[c], right.id[c], values[at]))
        columns = list(zip(*found)) or [()] * 5
        return pa.table({
            "anchor": pa.array(map(int, columns[0]), pa.int64()), "place": pa.array(map(int, columns[1]), pa.int32()),
            "row": pa.array(map(int, columns[2]), pa.int64()), "id": pa.array(columns[3], kind), "score": pa.array(map(int, columns[4]), pa.int64())})

    return of_cell


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def hard_negatives(
    docs: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``id`` that picks the anchors. A negative is a row of another label whose
    score is from ``low`` to ``high`` percent of the positive's.
    """
    rows = prepared(docs, id, label, vector)
    kind = rows.schema["id"].dataType.simpleString()
    result = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint"
    size = rows.agg(F.max(F.size("parts")).alias("dims"), F.max(F.array_max(F.transform("parts", F.abs))).alias("bias")).first()
    if size.dims is None:
        return docs.sparkSession.createDataFrame([], result)
    packing = Packing(max(size.dims, 1), max(size.bias or 0, 1))
    chosen = written(rows.where(anchor))
    grid = _Grid(_slices(rows, size.dims, LEAST_SLICES), _slices(chosen, size.dims, 1))
    arrow = pa.schema([("id", _arrow(kind))]).field("id").type

    def cells(anchors: DataFrame, work, schema: str) -> DataFrame:
        own = grid.of_rows(rows).groupBy("cell")
        return own.cogroup(grid.of_anchors(anchors).groupBy("cell")).applyInArrow(work, schema)

    best = cells(chosen, _positives(packing, positives, arrow), f"anchor bigint, row bigint, id {kind}, score bigint")
    best = _ranked(best, ["anchor"], positives).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = written(best)
    lists = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("all"))
    lists = lists.select(F.col("anchor").alias("row"), F.col("all.positive_score").alias("positives"))
    asking = written(chosen.join(lists, "row"))
    found = cells(asking, _negatives(packing, negatives, low, high, arrow), f"anchor bigint, place int, row bigint, id {kind}, score bigint")
    found = _ranked(found, ["anchor", "place"], negatives)
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.withColumn("place", F.col("rank") - 1).drop("rank").join(names, "anchor")
    return found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))


def mined(docs: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 50, labels moved on by one of ten where it is divisible by 7."""
    own = F.col(label).cast("bigint")
    moved = F.when(F.col(id) % 7 == 0, (own + 1) % 10).otherwise(own)
    rows = docs.select(F.col(id).alias("id"), moved.alias("label"), F.col(vector).alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
