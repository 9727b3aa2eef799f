"""A file corpus made of the ``documents`` table: every document is a file.

The same expressions build it in Spark and in SQL. Names, sizes and line ends
vary with the rows, so that each kind of file and line occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = "/corpus"

PATH = """concat('/corpus/', source, '/',
    case doc_id % 5 when 0 then 'src' when 1 then 'build' when 2 then 'docs'
                    when 3 then 'vendor/lib' else 'test/data' end,
    '/d', cast(doc_id as string),
    case doc_id % 16 when 0 then '.py' when 1 then '.JS' when 2 then '.md' when 3 then '.txt'
                     when 4 then '.log' when 5 then '.min.js' when 6 then '.xyz' when 7 then '/Makefile'
                     when 8 then '.c' when 9 then '/.env' when 10 then '.tar.gz' when 11 then '.TSX'
                     when 12 then '/CMakeLists.txt' when 13 then '/.gitignore' when 14 then '' else '.rs' end)"""

TEXT = """case when n_chars % 29 = 0 then ''
              when n_chars % 4 = 0 then replace(text, '. ', concat('.', chr(10)))
              when n_chars % 4 = 1 then concat(replace(text, '. ', concat('.', chr(13), chr(10))), chr(10))
              when n_chars % 4 = 2 then concat(text, chr(10))
              else text end"""

MTIME = "1700000000.25 + 61.0 * doc_id"
IS_LINK = "n_chars % 23 = 0"

# A binary file starts with a NUL byte, which its size counts.
IS_BINARY = "doc_id % 16 = 6"

SQL = f"""
corpus as (
    select path, text, strlen(text) + case when is_binary then 1 else 0 end as size,
           cast(mtime as double) as mtime, is_link, is_binary, doc_id, n_chars, source
    from (select {PATH} as path, {TEXT} as text, {MTIME} as mtime, {IS_LINK} as is_link,
                 {IS_BINARY} as is_binary, doc_id, n_chars, source
          from documents)
)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, size, mtime, is_link, is_binary, doc_id, n_chars, source``."""
    extra = F.when(F.col("is_binary"), 1).otherwise(0)
    return (
        table(spark, folder, "documents")
        .selectExpr(
            f"{PATH} as path", f"{TEXT} as text", f"cast({MTIME} as double) as mtime",
            f"{IS_LINK} as is_link", f"{IS_BINARY} as is_binary", "doc_id", "n_chars", "source",
        )
        .withColumn("size", (F.octet_length("text") + extra).cast("bigint"))
    )


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus in the form an index run takes."""
    raw = F.col("text").cast("binary")
    content = F.when(F.col("is_binary"), F.concat(F.lit(b"\0"), raw)).otherwise(raw)
    return corpus(spark, folder).select("path", "size", "mtime", "is_link", content.alias("content"))


def dirname_sql(path: str) -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


def quoted(text: str) -> str:
    """A SQL string literal; control characters go in by number."""
    pieces = [f"'{piece}'" for piece in text.replace("'", "''").split("\n")]
    return pieces[0] if len(pieces) == 1 else "concat(" + ", chr(10), ".join(pieces) + ")"
