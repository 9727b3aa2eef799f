"""Ignore-file lines and their translation to regular expressions.

Everything is a Column expression, so the same code parses a few rules given
by the caller (Catalyst folds them while planning) and millions of ignore
files stored in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Line breaks (as a regex) and white space of Unicode text.
_LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x85\u2028\u2029]"
_SPACE = (
    "\t\n\x0B\x0C\r\x1C\x1D\x1E\x1F \x85\xA0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
)

_TOKEN = r"\*\*/?|\*|\?|\\.|."
_WILDCARD = r"\*\*/?|\*|\?|\\."
_SPECIAL = r"([\\.^$|?*+(){}\[\]])"
_END_OR_SLASH = r"(?:\n?\z|/)"


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def parse_rules(text: Column) -> Column:
    """Array of ``(negate, dir_only, anchored, source)`` of an ignore file's text.

    In file order; blank lines, comments and lines without a pattern are left
    out. Each step is a pass of its own, as lambdas share no subexpressions.
    """
    lines = F.filter(
        F.transform(F.split(text, _LINE_BREAK), _strip),
        lambda line: (line != "") & ~line.startswith("#"),
    )
    bodies = F.transform(
        lines,
        lambda line: F.when(
            line.startswith("!"), F.struct(F.lit(True).alias("negate"), _strip(F.substring(line, 2, 2**31 - 1)).alias("body"))
        ).otherwise(F.struct(F.lit(False).alias("negate"), line.alias("body"))),
    )
    rules = F.transform(
        bodies,
        lambda rule: F.struct(
            rule["negate"].alias("negate"),
            rule["body"].endswith("/").alias("dir_only"),
            F.rtrim(rule["body"], F.lit("/")).startswith("/").alias("anchored"),
            F.trim(rule["body"], F.lit("/")).alias("source"),
        ),
    )
    return F.filter(rules, lambda rule: rule["source"] != "")


def is_supported(source: Column) -> Column:
    """False for patterns with character classes: such rules never match."""
    return ~F.rlike(source, F.lit(r"[\[\]]"))


def glob_regex(source: Column, dir_only: Column, anchored: Column, base: Column) -> Column:
    """Java regex equal in effect to a glob rule of the directory ``base``.

    To be searched in a path relative to the root, directories being tried
    with and without a trailing slash. ``.`` and ``$`` are spelled out, as Java
    gives them more line terminators than a newline.
    """

    def one(token: Column) -> Column:
        return (
            F.when(token.startswith("**"), r"[^\n]*")
            .when(token == "*", "[^/]*")
            .when(token == "?", "[^/]")
            .when(
                token.startswith("\\") & (F.length(token) == 2),
                _literal(F.substring(token, 2, 1)),
            )
            .otherwise(_literal(token))
        )

    body = F.array_join(
        F.transform(F.regexp_extract_all(source, F.lit(_TOKEN), 0), one), ""
    )
    below_base = F.when(base == "", "^").otherwise(F.concat(F.lit("^"), _literal(base), F.lit("/")))
    head = F.when(anchored | F.contains(source, F.lit("/")), below_base).otherwise("(?:^|/)")
    tail = F.when(dir_only, "/").otherwise(_END_OR_SLASH)
    return F.concat(head, body, tail)


def path_form(path: Column) -> Column:
    """What rules look at in a path: the path, padded forms of it, and whether
    it is odd, that is, has a newline."""
    start = F.lit("\0/")
    return F.struct(
        path.alias("path"),
        F.concat(start, path).alias("open"),
        F.concat(start, path, F.lit("/")).alias("closed"),
        F.contains(path, F.lit("\n")).alias("odd"),
    )


def glob_needle(source: Column, dir_only: Column, anchored: Column, base: Column) -> Column:
    """Text whose presence in a path's form means a match; null for other globs.

    Most rules are plain names, suffixes (``*.log``) or prefixes (``tmp*``). For
    paths without a newline a substring test then equals the regex and costs a
    fraction of it. It is done on the open form for rules for directories only,
    else on the closed one; a NUL marks the start of the path in both.
    """
    at_base = anchored | F.contains(source, F.lit("/"))
    head = (
        F.when(~at_base, "/")
        .when(base == "", "\0/")
        .otherwise(F.concat(F.lit("\0/"), base, F.lit("/")))
    )
    return (
        F.when(F.rlike(source, F.lit(r"^[^*?\\\[\]]+$")), F.concat(head, source, F.lit("/")))
        .when(
            F.rlike(source, F.lit(r"^\*[^*?\\\[\]/]+$")) & ~at_base,
            F.concat(F.substring(source, 2, 2**31 - 1), F.lit("/")),
        )
        .when(
            F.rlike(source, F.lit(r"^[^*?\\\[\]]+\*$")) & ~dir_only,
            F.concat(head, F.left(source, F.length(source) - 1)),
        )
    )


def glob_piece(source: Column) -> Column:
    """The longest run of plain text in a glob, which every match contains."""
    pieces = F.split(source, _WILDCARD)
    return F.array_max(
        F.transform(pieces, lambda piece: F.struct(F.length(piece).alias("length"), piece.alias("piece")))
    )["piece"]


def compiled_rules(text: Column, base: Column) -> Column:
    """Array of ``(negate, dir_only, needle, piece, regex)`` of an ignore file's
    usable rules, in file order."""
    usable = F.filter(parse_rules(text), lambda rule: is_supported(rule["source"]))

    def compiled(rule: Column) -> Column:
        parts = rule["source"], rule["dir_only"], rule["anchored"], base
        return F.struct(
            rule["negate"].alias("negate"),
            rule["dir_only"].alias("dir_only"),
            glob_needle(*parts).alias("needle"),
            glob_piece(rule["source"]).alias("piece"),
            glob_regex(*parts).alias("regex"),
        )

    return F.transform(usable, compiled)


def rule_matches(form: Column, rule: Column) -> Column:
    """Whether a rule of :func:`compiled_rules` matches a path's form.

    The regex, which has to be compiled for each test, comes last.
    """
    text = F.when(rule["dir_only"], form["open"]).otherwise(form["closed"])
    return F.when(rule["needle"].isNotNull() & ~form["odd"], F.contains(text, rule["needle"])).otherwise(
        F.contains(form["path"], rule["piece"]) & F.rlike(form["path"], rule["regex"])
    )
