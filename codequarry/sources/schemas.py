"""Schemas of the tables that cross module boundaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# What is indexed: one row per file or link, whatever reader it came from.
FILE_TABLE = "path string, size bigint, mtime double, is_link boolean, content binary"
LISTING = "path string, size bigint, mtime double, is_link boolean"

# What an index holds.
ROOTS = "path string, created_at string"
# ``n_lines`` and ``language`` follow from text and path; an empty text has 0 lines.
FILES = (
    "path string, size bigint, mtime double, text_hash string, n_lines bigint, language string, indexed_at string"
)
CONTENT = (
    "path string, size bigint, mtime double, text_hash string, n_lines bigint, language string, "
    "replaces bigint, text string, block bigint"
)
GRAMS = "gram int, block bigint"
BLOCKS = "block bigint, zone int, first string, last string"
REPLACED = "path string, replaced_gen bigint"
COMMITS = (
    "gen bigint, base boolean, added bigint, updated bigint, removed bigint, skipped bigint, total bigint"
)


def local_table(spark: SparkSession, schema: str, rows: list[tuple] = ()) -> DataFrame:
    """A few rows known to the driver, as a relation Catalyst can fold and size."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)
