"""Files and lines per language, and their renderings.

A corpus has ``path, text``, or ``path, language, n_lines`` as an index stores
them, and then no text is read. The grouping key has fewer than a hundred values, so partial aggregation
leaves almost nothing to shuffle and the collected lists below are tiny
whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.language import language_of
from ..functions.text import line_count
from . import scope

# Fixed value: files with fewer lines count as files but add no lines.
DEFAULT_MIN_LINES = 3

# Fixed value: what the report says for an index without files.
EMPTY_REPORT = "No indexed files."


def language_stats(
    corpus: DataFrame, root: str | None = None, min_lines: int = DEFAULT_MIN_LINES
) -> DataFrame:
    """``language, files, lines`` by lines, then files, then name."""
    return _per_language(corpus, root, min_lines).orderBy(
        F.desc("lines"), F.desc("files"), "language"
    )


def totals(
    corpus: DataFrame, root: str | None = None, min_lines: int = DEFAULT_MIN_LINES
) -> DataFrame:
    """One row ``files, lines`` over all languages; zeros for no files."""
    return _counted(corpus, root, min_lines).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")
    )


def stats_envelope(
    corpus: DataFrame, root: str | None = None, min_lines: int = DEFAULT_MIN_LINES
) -> DataFrame:
    """One row ``root, languages, totals``; ``root`` is ``all`` when none is given."""
    name = "all" if root is None else paths.absolute(root)
    return _summary(_per_language(corpus, root, min_lines)).select(
        F.lit(name).alias("root"), "languages", "totals"
    )


def to_json(stats: DataFrame, indent: int | None = 2) -> DataFrame:
    """One row ``json`` of a :func:`language_stats` result, laid out with ``indent``."""
    summary = _summary(stats)
    if indent is None:
        return summary.select(F.to_json(F.struct("languages", "totals")).alias("json"))
    pad = [F.lit("\n" + " " * (indent * depth)) for depth in range(4)]

    def number(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": '), value.cast("string"))

    def language(row: Column) -> Column:
        quoted = F.regexp_extract(
            F.to_json(F.struct(row["language"].alias("n"))), r"(?s)^\{\"n\":(.*)\}$", 1
        )
        fields = F.concat_ws(
            ",",
            F.concat(pad[3], F.lit('"language": '), quoted),
            F.concat(pad[3], number("files", row["files"])),
            F.concat(pad[3], number("lines", row["lines"])),
        )
        return F.concat(pad[2], F.lit("{"), fields, pad[2], F.lit("}"))

    rows = F.concat_ws(",", F.transform("languages", language))
    listed = F.when(F.size("languages") == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), rows, pad[1], F.lit("]"))
    )
    total = F.concat_ws(
        ",",
        F.concat(pad[2], number("files", F.col("totals.files"))),
        F.concat(pad[2], number("lines", F.col("totals.lines"))),
    )
    return summary.select(
        F.concat(
            F.lit("{"), pad[1], F.lit('"languages": '), listed, F.lit(","),
            pad[1], F.lit('"totals": {'), total, pad[1], F.lit("}"), pad[0], F.lit("}"),
        ).alias("json")
    )


def report(stats: DataFrame) -> DataFrame:
    """Text report of a :func:`language_stats` result: ``line_no, line``."""
    width = F.array_max(F.transform("languages", lambda row: F.length(row["language"])))

    def line(label: Column, files: Column, lines: Column) -> Column:
        gap = F.repeat(F.lit(" "), F.greatest(F.col("width") - F.length(label), F.lit(0)))
        return F.concat(label, gap, F.format_string("  %8d files  %10d lines", files, lines))

    body = F.concat(
        F.transform("languages", lambda row: line(row["language"], row["files"], row["lines"])),
        F.array(F.repeat(F.lit("-"), F.col("width") + 34)),
        F.array(line(F.lit("TOTAL"), F.col("totals.files"), F.col("totals.lines"))),
    )
    lines = F.when(F.size("languages") == 0, F.array(F.lit(EMPTY_REPORT))).otherwise(body)
    return (
        _summary(stats)
        .withColumn("width", width)
        .select(F.posexplode(lines).alias("line_no", "line"))
        .select((F.col("line_no") + 1).cast("bigint").alias("line_no"), "line")
    )


def totals_line(total: DataFrame) -> DataFrame:
    """``Totals: F files, L lines`` of a :func:`totals` result."""
    return total.select(F.format_string("Totals: %d files, %d lines", "files", "lines").alias("line"))


def line_numbers(text: Column) -> Column:
    """Lines of a text, 0 for an empty one."""
    return F.when(text == "", 0).otherwise(line_count(text))


def _counted(corpus: DataFrame, root: str | None, min_lines: int) -> DataFrame:
    """``language, lines`` of files with text, from stored columns where there are such."""
    counted = scope.below(corpus, root)
    if "n_lines" not in corpus.columns or "language" not in corpus.columns:
        counted = counted.select(language_of(F.col("path")).alias("language"), line_numbers(F.col("text")).alias("n_lines"))
    lines = F.when(F.col("n_lines") >= min_lines, F.col("n_lines")).otherwise(0)
    return counted.where(F.col("n_lines") > 0).select("language", lines.alias("lines"))


def _per_language(corpus: DataFrame, root: str | None, min_lines: int) -> DataFrame:
    return _counted(corpus, root, min_lines).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines")
    )


def _summary(stats: DataFrame) -> DataFrame:
    """One row ``languages, totals``; the list is ordered as the stats are."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("lines")).alias("by_lines"), (-F.col("files")).alias("by_files"), "language"))
    )
    languages = F.transform(
        ordered,
        lambda row: F.struct(
            row["language"].alias("language"),
            (-row["by_files"]).alias("files"),
            (-row["by_lines"]).alias("lines"),
        ),
    )
    return stats.agg(
        languages.alias("languages"),
        F.struct(
            F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        ).alias("totals"),
    )
