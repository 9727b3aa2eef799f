"""Tables laid out alike, so that joins on their key need no exchange.

Each table is written once in the same number of buckets of its key, sorted
within; a bucket of one table then meets just the same bucket of the others, by a
sort-merge join that neither shuffles nor broadcasts. Worth it for tables that
are joined again and again. The catalog of the session knows the tables by the
names that :func:`write` gives them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Bytes of a bucket aimed at; a task of a join holds one bucket of each table.
BUCKET_BYTES = 128 * 1024 * 1024


def buckets_for(size: int, least: int) -> int:
    """Number of buckets of tables of which the largest has about ``size`` bytes."""
    return max(least, -(-size // BUCKET_BYTES))


def write(table: DataFrame, location: str, buckets: int, key: str = "path") -> DataFrame:
    """Write ``table`` below ``location`` in buckets of ``key`` and return it as read back."""
    name = f"colocated_{uuid.uuid4().hex}"
    # One task writes each bucket, so there is one sorted file of it.
    writer = table.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{location}/{name}").format("parquet").saveAsTable(name)
    return table.sparkSession.table(name)


def joined(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Inner join of two tables of :func:`write` with as many buckets, bucket by bucket."""
    return left.join(right.hint("merge"), key)
