"""Helpers of several operators: tables by name, free column names, tables written below the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType

from codequarry.sources.scratch import file_system, scratch_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column is named so."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver's JVM ends."""
    folder = f"{scratch_dir(spark).rstrip('/')}/codequarry-{uuid.uuid4().hex}"
    system, path = file_system(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def written(frame: DataFrame, folder: str | None = None, name: str = "table") -> DataFrame:
    """``frame`` as Parquet in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    location = f"{folder or shared_folder(spark)}/{name}"
    frame.write.parquet(location)
    return spark.read.schema(frame.schema).parquet(location)


def counted(frame: DataFrame, folder: str, name: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, which the write itself counts."""
    seen = Observation()
    found = written(frame.observe(seen, F.count(F.lit(1)).alias("n")), folder, name)
    return found, seen.get["n"]


def written_alone(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """``written``, and the files of the shuffles on the way are deleted at its end, not when the driver next collects garbage."""
    conf = frame.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(frame, folder, name)
    finally:
        conf.set(_CLEANUP, before)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder of written tables that nothing reads any more."""
    system, path = file_system(spark, folder)
    system.delete(path, True)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def schema_with(frame: DataFrame, name: str, kind: DataType | str) -> StructType:
    kind = DataType.fromDDL(kind) if isinstance(kind, str) else kind
    return StructType(list(frame.schema.fields)).add(name, kind)
