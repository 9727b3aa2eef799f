"""Ignore rules applied to a file table.

A rule set is the rules of one ignore file, scoped to the file's directory, or
one extra pattern, scoped to the root. For a path ``p`` the first of these
decides:

1. the shallowest set with a rule matching ``p``, by its last such rule;
2. for a directory, the shallowest set with a rule matching ``p/``, likewise.

Root-level sets apply to every path, so they are compiled on the driver (two
ignore files and the caller's patterns) into literal regexes. Sets of deeper
directories stay in tables, see :class:`DirectoryRules`: directories are settled
once each, however many files they have, and rules are only ever joined by the
directory they come from, never copied into every directory below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions import globs, paths
from ..functions.text import decode_text
from ..sources.schemas import local_table
from .scope import IGNORE_NAMES, below


class RootRule(NamedTuple):
    """Neighbouring root-level rules of the same kind, any of which decides.

    The expression is equally deep for any number of rules: plain names are
    literals of one array, globs are alternatives of one regex.
    """

    negate: bool
    needles: list[str]
    directory_needles: list[str]
    other: str
    regex: str

    def matches(self, form: Column) -> Column:
        tests = [
            _contains_any(form[text], needles)
            for text, needles in (("closed", self.needles), ("open", self.directory_needles)) if needles
        ]
        if tests:
            tests.append(form["odd"] & form["path"].rlike(self.regex))
        if self.other:
            tests.append(form["path"].rlike(self.other))
        return _any(tests)


def _contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, needles)), lambda needle: F.contains(text, needle))


def _any(tests: Sequence[Column]) -> Column:
    """Disjunction as a balanced tree, whose depth is the logarithm of their number."""
    tests = list(tests)
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


class DirectoryRules(NamedTuple):
    """Effect of the ignore files below the root.

    ``directories`` has ``dir, base, pruned`` for directories that hold files
    and are pruned or in the scope of such a file, ``base`` being the deepest
    directory with one. ``chains`` has ``base, rules, any``: the rules of ``base``
    and the directories above it, the deciding ones first, and their tests.
    """

    directories: DataFrame
    chains: DataFrame


def parse_rules(ignore_files: DataFrame) -> DataFrame:
    """One row per rule of ``base, rank, text`` rows, with its regex.

    The regex is null for unsupported rules. ``rank`` tells the sets of one
    directory apart and is kept, as are all other columns but ``text``.
    """
    kept = [name for name in ignore_files.columns if name != "text"]
    rule = F.col("rule")
    return ignore_files.select(
        *kept, F.posexplode(globs.parse_rules(F.col("text"))).alias("rule_idx", "rule")
    ).select(
        *kept,
        F.col("rule_idx").cast("bigint").alias("rule_idx"),
        "rule.*",
        F.when(
            globs.is_supported(rule["source"]),
            globs.glob_regex(rule["source"], rule["dir_only"], rule["anchored"], F.col("base")),
        ).alias("regex"),
    )


def rule_sets(
    files: DataFrame, root: str, ignore_names: Sequence[str] = IGNORE_NAMES
) -> DataFrame:
    """``base, rank, text`` of the ignore files among ``files``.

    ``files`` has ``path, content``. ``rank`` is 0 for the first ignore name,
    1 for the second. Linked ignore files count, as their content does.
    """
    name = paths.basename(F.col("path"))
    base = paths.relative(paths.dirname(F.col("path")), root)
    return (
        below(files, root)
        .where(name.isin(*ignore_names))
        .select(
            base.alias("base"),
            F.array_position(F.array(*map(F.lit, ignore_names)), name).cast("int").alias("rank"),
            decode_text(F.col("content")).alias("text"),
        )
        .withColumn("rank", F.col("rank") - 1)
    )


def root_rules(spark: SparkSession, texts: Sequence[str]) -> list[RootRule]:
    """Compiled root-level rules, the deciding ones first.

    ``texts`` are rule sets from the most important on: the root's first ignore
    file, extra patterns in order, the root's second ignore file. Neighbours of
    the same kind are merged into one regex. No job runs: the rows are local
    and Catalyst folds the expressions.
    """
    if not texts:
        return []
    table = local_table(spark, "n int, text string", list(enumerate(texts)))
    compiled = table.select("n", globs.compiled_rules(F.col("text"), F.lit("")).alias("rules"))
    in_order = [
        rule for row in sorted(compiled.collect(), key=lambda row: row.n) for rule in reversed(row.rules)
    ]
    return [_merged(negate, list(rules)) for negate, rules in groupby(in_order, lambda rule: rule.negate)]


def _merged(negate: bool, rules: list[Row]) -> RootRule:
    def union(regexes) -> str:
        return "|".join(f"(?:{regex})" for regex in dict.fromkeys(regexes))

    return RootRule(
        negate,
        sorted({rule.needle for rule in rules if rule.needle and not rule.dir_only}),
        sorted({rule.needle for rule in rules if rule.needle and rule.dir_only}),
        union(rule.regex for rule in rules if not rule.needle),
        union(rule.regex for rule in rules),
    )


def root_texts(sets: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Root-level rule texts in order of importance, for :func:`root_rules`.

    Collects the root's own ignore files: two rows at most.
    """
    own = {row.rank: row.text for row in sets.where(F.col("base") == "").collect()}
    first = [own.pop(0)] if 0 in own else []
    return first + list(extra) + [own[rank] for rank in sorted(own)]


def with_ignore_flags(
    files: DataFrame,
    root: str,
    rules: Sequence[RootRule],
    deeper: DirectoryRules | None = None,
) -> DataFrame:
    """Files below ``root`` plus ``pruned`` (in an ignored directory) and ``ignored``.

    Without ``deeper`` rules nothing is joined.
    """
    relative = paths.relative(F.col("path"), root)
    placed = below(files, root).withColumns({"rel": relative, "dir": paths.dirname(relative)})
    verdict = _root_verdict(globs.path_form(F.col("rel")), rules)
    if deeper is None:
        flagged = placed.withColumn("pruned", _pruned(F.col("dir"), rules))
    else:
        flagged = _with_chain(placed.join(deeper.directories, "dir", "left"), deeper.chains).withColumn(
            "pruned", F.coalesce("pruned", F.lit(False))
        )
        form = globs.path_form(F.col("rel"))
        decided = F.get(F.transform(F.array(form), lambda made: _nested_verdict(made, F.col("rules"))), 0)
        nested = F.when(_may_match(form, F.col("any")), decided)
        verdict = F.coalesce(verdict, nested)
    flagged = flagged.withColumn("ignored", _is_ignored(verdict))
    return flagged.select(*files.columns, "pruned", "ignored")


def without_ignored(
    files: DataFrame,
    root: str,
    rules: Sequence[RootRule],
    nested: DataFrame | None = None,
) -> DataFrame:
    """Files below ``root`` that no rule hides; ``nested`` as in :func:`rule_chains`."""
    deeper = None if nested is None else directory_rules(files, root, rules, rule_chains(nested))
    flagged = with_ignore_flags(files, root, rules, deeper)
    return flagged.where(~F.col("pruned") & ~F.col("ignored")).drop("pruned", "ignored")


def directory_rules(
    files: DataFrame, root: str, rules: Sequence[RootRule], chains: DataFrame
) -> DirectoryRules:
    """Settle every directory holding files of ``files``, given :func:`rule_chains`."""
    relative = paths.relative(F.col("path"), root)
    directories = (
        below(files, root).select(paths.dirname(relative).alias("dir")).distinct().where(F.col("dir") != "")
    )
    deepest = (
        directories.select("dir", F.explode(paths.lineage(F.col("dir"))).alias("base"))
        .join(chains.select("base"), "base", "left_semi")
        .groupBy("dir")
        .agg(F.max_by("base", F.length("base")).alias("base"))
    )
    # Adaptive execution would pack these short rows into few partitions, but the
    # work on them is all in the tests. By "dir" itself nothing would be spread,
    # as the rows are partitioned that way already.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = directories.join(deepest, "dir", "left").repartition(tasks, F.xxhash64("dir"))
    settled = _with_chain(placed, chains, keep_base=True).select(
        "dir", "base", _pruned(F.col("dir"), rules, F.col("rules"), F.col("any")).alias("pruned")
    )
    return DirectoryRules(settled.where(F.col("pruned") | F.col("base").isNotNull()), chains)


def rule_chains(nested: DataFrame) -> DataFrame:
    """``base, rules, any`` of the ``base, rank, text`` rows of ignore files.

    ``any`` has the tests of all rules, to tell at once that none matches. Rows of the root itself are left out: they belong to the root rules. A
    chain has at most two sets for each level of its base.
    """
    depth = F.size(F.split("base", "/"))
    sets = (
        nested.where(F.col("base") != "")
        .select(
            "base",
            "rank",
            F.transform(
                F.reverse(globs.compiled_rules(F.col("text"), F.col("base"))),
                lambda rule: F.struct(depth.alias("depth"), rule.alias("rule")),
            ).alias("rules"),
        )
    )
    above = sets.select(F.col("base").alias("top")).distinct().select(
        "top", F.explode(paths.lineage(F.col("top"))).alias("base")
    )
    return (
        above.join(sets, "base")
        .groupBy("top")
        .agg(F.array_sort(F.collect_list(F.struct(depth.alias("depth"), "rank", "rules"))).alias("sets"))
        .select(F.col("top").alias("base"), F.flatten(F.col("sets.rules")).alias("rules"))
        .withColumn("any", _merged_tests(F.col("rules")))
    )


def _merged_tests(rules: Column) -> Column:
    """The tests of all rules of a chain, each once and laid out for :func:`_may_match`."""

    def of(kept) -> Column:
        return F.transform(F.filter(rules, kept), lambda entry: entry["rule"])

    def needles(dir_only: bool) -> Column:
        kept = of(lambda entry: entry["rule"]["needle"].isNotNull() & (entry["rule"]["dir_only"] == dir_only))
        return F.array_distinct(F.transform(kept, lambda rule: rule["needle"]))

    others = of(lambda entry: entry["rule"]["needle"].isNull())
    return F.struct(
        needles(False).alias("needles"),
        needles(True).alias("directory_needles"),
        F.array_distinct(
            F.transform(others, lambda rule: F.struct(rule["piece"].alias("piece"), rule["regex"].alias("regex")))
        ).alias("others"),
    )


def _may_match(form: Column, tests: Column) -> Column:
    """False if no rule of a chain matches a path's form. The search stops at the first that does.

    Most paths match none and are settled here, without looking at which rule decides.
    """

    def any_of(form: Column) -> Column:
        return (
            form["odd"]
            | F.exists(tests["needles"], lambda needle: F.contains(form["closed"], needle))
            | F.exists(tests["directory_needles"], lambda needle: F.contains(form["open"], needle))
            | F.exists(
                tests["others"],
                lambda test: F.contains(form["path"], test["piece"]) & F.rlike(form["path"], test["regex"]),
            )
        )

    # As the variable of a lambda the form is made once, not for each test.
    return F.exists(F.array(form), any_of)


def _with_chain(rows: DataFrame, chains: DataFrame, keep_base: bool = False) -> DataFrame:
    """``rows`` plus the ``rules`` of their ``base``, null where it is null."""
    # Rows without a base are spread by their directory, not by one null key;
    # no directory name holds a NUL, so they match nothing.
    key = F.coalesce("base", F.concat(F.lit("\0"), "dir"))
    keyed = rows.withColumn("chain", key)
    rules = chains.select(F.col("base").alias("chain"), "rules", "any")
    joined = keyed.join(rules, "chain", "left").drop("chain")
    return joined if keep_base else joined.drop("base")


def _is_ignored(negate: Column) -> Column:
    return F.coalesce(~negate, F.lit(False))


def _root_verdict(form: Column, rules: Sequence[RootRule]) -> Column:
    """``negate`` of the deciding root-level rule; null without a match."""
    verdict = None
    for rule in rules:
        hit = rule.matches(form)
        verdict = F.when(hit, rule.negate) if verdict is None else verdict.when(hit, rule.negate)
    return F.lit(None).cast("boolean") if verdict is None else verdict


def _nested_verdict(form: Column, rules: Column, above: Column | None = None) -> Column:
    """``negate`` of the first of ``rules`` matching.

    ``above`` limits them to those of directories at most that deep.
    """

    def applies(entry: Column) -> Column:
        hit = globs.rule_matches(form, entry["rule"])
        return hit if above is None else (entry["depth"] <= above) & hit

    return F.get(F.filter(rules, applies), 0)["rule"]["negate"]


def _pruned(
    directory: Column, rules: Sequence[RootRule], nested: Column | None = None, tests: Column | None = None
) -> Column:
    """True when a relative directory or one above it is ignored."""

    def level(path: Column, above: Column) -> Column:
        return F.struct(
            above.alias("above"),
            globs.path_form(path).alias("plain"),
            globs.path_form(F.concat(path, F.lit("/"))).alias("slashed"),
        )

    def ignored(at: Column) -> Column:
        verdicts = []
        for form in (at["plain"], at["slashed"]):
            verdicts.append(_root_verdict(form, rules))
            if nested is not None:
                verdicts.append(_nested_verdict(form, nested, at["above"]))
        return _is_ignored(F.coalesce(*verdicts))

    # What matches a directory also matches in every longer path, so one look
    # settles most. Wildcards stop at newlines: with one, no shortcut.
    whole = globs.path_form(F.concat(directory, F.lit("/")))
    possible = _any([whole["odd"], *(rule.matches(whole) for rule in rules if not rule.negate)])
    if nested is not None:
        possible = possible | (nested.isNotNull() & _may_match(whole, tests))
    levels = F.transform(paths.lineage(directory), level)
    return F.when((directory != "") & possible, F.exists(levels, ignored)).otherwise(False)
