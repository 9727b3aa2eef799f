"""Literal substring search: one row per occurrence, overlapping ones included.

All steps up to the final top-N are narrow: a whole-text ``contains`` drops
most files, the survivors are split into lines, a second ``contains`` drops
most lines, and only then are occurrences counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import dirname
from . import scope

# Default numbers of hits returned by each way of asking.
DEFAULT_MAX_RESULTS = 200
TOOL_MAX_RESULTS = 100
INTERACTIVE_MAX_RESULTS = 500

HIT_COLUMNS = ("path", "lineno", "text", "root")


def search(
    corpus: DataFrame,
    pattern: str,
    root: str | None = None,
    paths: Sequence[str] | DataFrame | None = None,
    max_results: int | None = DEFAULT_MAX_RESULTS,
    case: bool = False,
) -> DataFrame:
    """The first ``max_results`` hits by path and line; all hits for None.

    ``corpus`` has ``path`` and ``text``. The result has ``path``, ``lineno``
    (from 1), ``text`` (the raw line) and ``root`` (the file's directory).
    """
    if max_results is not None:
        max_results = max(max_results, 0)
    scoped = scope.among(scope.below(corpus, root), paths)
    if max_results is not None and pattern:
        scoped = _first_files(scoped, pattern, max_results, case)
    counted = matching_lines(scoped, pattern, case)
    # Hits of one line are equal rows, so a line never needs more copies than
    # rows are asked for.
    copies = F.col("hits") if max_results is None else F.least("hits", F.lit(max_results))
    hits = counted.select(
        "path", "lineno", "text", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")
    )
    if max_results is not None:
        hits = hits.orderBy("path", "lineno").limit(max_results)
    return hits.select("path", "lineno", "text", dirname(F.col("path")).alias("root"))


def _first_files(corpus: DataFrame, pattern: str, most: int, case: bool) -> DataFrame:
    """The files up to the ``most``-th that has a hit, by path.

    As each such file, or matching line, has a hit at least, the first ``most`` hits lie in them.
    Only paths meet here; of the texts of later files no line is split or moved.
    """
    if case or pattern.isascii() and "\n" not in pattern:
        # The text has a hit just if a line has one.
        found = _candidates(corpus, pattern, _fold(case))
    else:
        found = matching_lines(corpus, pattern, case)
    last = found.select("path").orderBy("path").limit(most).agg(F.max("path"))
    return corpus.where(F.col("path") <= last.scalar())


def _candidates(corpus: DataFrame, pattern: str, fold) -> DataFrame:
    return corpus.where(F.contains(fold(F.col("text")), fold(F.lit(pattern))))


def matching_lines(corpus: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """Lines with a hit: ``path, lineno, text, hits``, ``hits`` being their number.

    A hit of a pattern with newlines counts for the line it starts on.
    """
    if not pattern:
        return corpus.limit(0).select(
            "path", F.lit(0).cast("bigint").alias("lineno"), "text", F.lit(0).alias("hits")
        )
    fold = _fold(case)
    candidates = _candidates(corpus, pattern, fold)
    if "\n" in pattern:
        return _multi_line(candidates, pattern, fold)
    return _single_line(candidates, pattern, fold)


def count_hits(corpus: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """Number of all hits as one row, without making a row per hit."""
    return matching_lines(corpus, pattern, case).agg(
        F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("count")
    )


def grep_lines(hits: DataFrame) -> DataFrame:
    """``path:lineno: text`` per hit."""
    return hits.select(
        F.concat("path", F.lit(":"), F.col("lineno").cast("string"), F.lit(": "), "text").alias("line")
    )


def envelope(hits: DataFrame) -> DataFrame:
    """One row ``results, count`` of a limited search result."""
    ordered = F.array_sort(F.collect_list(F.struct(*HIT_COLUMNS)))
    return hits.agg(ordered.alias("results"), F.count("*").alias("count"))


def _fold(case: bool):
    return (lambda column: column) if case else F.lower


def _single_line(candidates: DataFrame, pattern: str, fold) -> DataFrame:
    needle = fold(F.lit(pattern))
    lines = candidates.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    line = fold(F.col("text"))
    return lines.where(F.contains(line, needle)).select(
        "path",
        (F.col("pos") + 1).cast("bigint").alias("lineno"),
        "text",
        _occurrences(line, pattern, needle).alias("hits"),
    )


def _occurrences(line: Column, pattern: str, needle: Column) -> Column:
    if _may_overlap(pattern):
        quoted = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        ahead = F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)"))
        return F.regexp_count(line, ahead)
    removed = F.octet_length(line) - F.octet_length(F.replace(line, needle, F.lit("")))
    return (removed / F.octet_length(needle)).cast("int")


def _may_overlap(pattern: str) -> bool:
    """True unless no occurrence can overlap the next one.

    Only decided for ASCII, where lower case is the same everywhere.
    """
    if not pattern.isascii():
        return True
    low = pattern.lower()
    return any(low.endswith(low[:n]) for n in range(1, len(low)))


def _multi_line(candidates: DataFrame, pattern: str, fold) -> DataFrame:
    """A hit starts on line i when i ends with the pattern's first part, the
    lines after it equal the middle parts and the next starts with the last."""
    first, *middle, last = pattern.split("\n")
    split = candidates.select(
        "path",
        F.split("text", "\n", -1).alias("lines"),
        F.split(fold(F.col("text")), "\n", -1).alias("folded"),
    )

    def starts_hit(i: Column) -> Column:
        def ahead(offset: int) -> Column:
            return F.get("folded", i + offset)

        # Too close to the end the line ahead is null, and so is the test.
        result = F.endswith(ahead(0), fold(F.lit(first)))
        for offset, part in enumerate(middle, 1):
            result = result & (ahead(offset) == fold(F.lit(part)))
        return result & F.startswith(ahead(len(middle) + 1), fold(F.lit(last)))

    numbered = F.transform("lines", lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    starts = F.filter(numbered, lambda line: starts_hit(line["i"]))
    return split.select("path", F.explode(starts).alias("start")).select(
        "path",
        (F.col("start.i") + 1).cast("bigint").alias("lineno"),
        F.col("start.text").alias("text"),
        F.lit(1).alias("hits"),
    )
