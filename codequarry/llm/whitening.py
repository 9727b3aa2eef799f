"""Whitened embeddings by Spark MLlib's BlockMatrix.

Entries become the integers floor(1024 c) + 100000. Counts and sums per
dimension are exact. Centred rows are numbered and dealt into distributed blocks;
the transposed block matrix times itself is the scatter matrix, added up over
splits of the rows; its eigenvectors are found on the driver (it has one row per
dimension, whatever the table); and the block matrix times the whitening matrix
projects all rows. Vectors stay in the JVM throughout.

Scale: every task holds a bounded number of blocks of at most ``BLOCK_BYTES``. MLlib
keeps the coordinates of all blocks, two integers each, on the driver. Rows are
numbered by a written table of the rows each task wrote, so no row passes through
one task.

Defined results: rows whose vector is null or holds null or non-finite entries are
left out; a shorter vector ends in zeros, so an empty one is all zeros; null and
repeated ids are rows like others; rows are whitened along directions of positive
variance only (above 1e-10 of the largest), so equal vectors have no component and
no rows; ``deviation`` is null where it exceeds a long; an empty table gives no rows.
Integers that, times the number of rows, exceed a long raise Spark's overflow error.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm.shared import written

# How an entry becomes an integer.
SCALE, SHIFT = 1024.0, 100000

#: Size of a block of doubles, and blocks that one task multiplies.
BLOCK_BYTES = 4 * 1024 * 1024
_TASK_BLOCKS = 8
#: Directions with a smaller share of the largest eigenvalue are rounding errors.
_RANK = 1e-10


class Whitening(NamedTuple):
    """Fit of a table: its rows, and the whitening matrix (dimensions by components)."""

    rows: DataFrame  # id, x, at
    count: int
    sums: list[int]
    blocks: BlockMatrix
    matrix: np.ndarray
    explained: list[float]


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` as a written table with ``at``, numbers from 0 without gaps."""
    kept = written(rows.withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # One row for each task that wrote the table.
    before = sizes.selectExpr("_part", "sum(n) over (order by _part) - n as _before")
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + within).drop("_id", "_part", "_before")


def block_matrix(rows: DataFrame, vector: Column, count: int, dims: int, height: int, width: int) -> BlockMatrix:
    """Distributed blocks of the rows ``at``, an array of doubles each."""
    indexed = rows.select("at", array_to_vector(vector).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, count, dims).toBlockMatrix(height, width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right`` with the inner dimension dealt to ``splits`` tasks, which the Python class has no argument for."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def fit(docs: DataFrame, id: str, vector: str, components: int) -> Whitening | None:
    """The whitening of all usable rows; None without such rows, dimensions or variance."""
    x = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    rows = numbered(docs.where(usable(F.col(vector))).select(F.col(id).alias("id"), x.alias("x")))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    count, dims = size.n, size.dims
    if not count or not dims:
        return None
    # One row per dimension.
    sums = [SHIFT * count] * dims
    for row in rows.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x") - SHIFT).alias("s")).collect():
        sums[row.k] += row.s

    centred = F.transform(deviations(F.col("x"), count, sums), lambda d: d / F.lit(float(count)))
    width = min(dims, 1024)
    height = max(1, BLOCK_BYTES // (8 * width))
    blocks = block_matrix(rows, centred, count, dims, height, width)
    splits = max(1, -(-count // (height * _TASK_BLOCKS)))
    covariance = product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray() / count
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = [k for k in range(min(components, dims)) if values[k] > max(values[0], 0) * _RANK]
    if not used:
        return None
    matrix = vectors[:, used] / np.sqrt(values[used])
    explained = [float(v) for v in values[used] / np.trace(covariance)]
    return Whitening(rows, count, sums, blocks, matrix, explained)


def deviations(x: Column, count: int, sums: list[int]) -> Column:
    """count * x - sum of every dimension, exact."""
    all_sums = F.array(*(F.lit(s).cast("bigint") for s in sums))
    padded = F.concat(x, F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(len(sums)) - F.size(x)))
    return F.zip_with(padded, all_sums, lambda a, s: a * F.lit(count).cast("bigint") - s)


def projected(model: Whitening) -> DataFrame:
    """at, whitened (one double per component) of all rows."""
    spark = model.rows.sparkSession
    dims, parts = model.matrix.shape
    rows = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(model.matrix)], "at bigint, row array<double>")
    by = block_matrix(rows, F.col("row"), dims, parts, model.blocks.colsPerBlock, parts)
    result = model.blocks.multiply(by).toIndexedRowMatrix()
    indexed = callMLlibFunc("getIndexedRows", result._java_matrix_wrapper._java_model)
    return indexed.select(F.col("index").alias("at"), vector_to_array("vector").alias("whitened"))


def identity_error(rows: DataFrame, parts: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    pairs = [(i, j) for i in range(parts) for j in range(i + 1)]
    entries = rows.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(entries[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(docs: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(docs, id, vector, components)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    rows = written(projected(model))
    error = identity_error(rows, len(model.explained))
    square = F.aggregate(
        deviations(F.col("x"), model.count, model.sums), F.lit(0).cast("bigint"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    own = model.rows.select("at", F.col("id").alias("vec_id"), square.alias("deviation"))
    shares = F.array(*(F.lit(share) for share in model.explained))
    return own.join(rows, "at").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.count).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
