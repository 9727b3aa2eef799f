"""Written intermediate tables.

A staged table cuts lineage, survives lost executors, and has a known size, by
which Catalyst chooses between a broadcast and a shuffle for its joins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir()


def file_system(spark: SparkSession, location: str):
    """Hadoop file system of a location, and the location as its path object."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class Staging:
    """A folder of staged tables, deleted on leaving the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_dir(spark).rstrip('/')}/codequarry-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_exc) -> None:
        system, path = file_system(self.spark, self.folder)
        system.delete(path, True)

    def write(self, table: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``table`` and return it as read back."""
        location = f"{self.folder}/{name}"
        writer = table.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(location)
        return self.spark.read.schema(table.schema).parquet(location)

    def read_parts(self, table: DataFrame, name: str, by: str, values: list[str]) -> DataFrame:
        """The parts of a staged table with these values of its partition column.

        Naming the folders, unlike a filter, gives Catalyst the size of just
        these parts.
        """
        location = f"{self.folder}/{name}"
        folders = [f"{location}/{by}={value}" for value in values]
        present = [
            folder for folder in folders
            if (lambda system, path: system.exists(path))(*file_system(self.spark, folder))
        ]
        if not present:
            return table.limit(0)
        reader = self.spark.read.schema(table.schema).option("basePath", location)
        return reader.parquet(*present)
