"""Ignore rules: parsing, matching, precedence and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import globs, paths
from codequarry.operators import ignore

from .corpus import ROOT, SQL, corpus, table

ROOT_IGNORE = """# generated
build/
*.log
!src3/build/
/src7
void[0-9]/
"""
EXTRA = ["*.md", "!d1*.md\ndocs/**/d?.txt", "src1?/**/Makefile"]
ROOT_SECOND = "vendor/\n*.TSX\n!*.log\n!*1.md\n"

# The same rules in the order (set, rule), negations marked, as SQL regexes.
_ROOT_RULES = [
    (0, 0, False, r"(^|/)build/"),
    (0, 1, False, r"(^|/)[^/]*\.log($|/)"),
    (0, 2, True, r"^src3/build/"),
    (0, 3, False, r"^src7($|/)"),
]
_EXTRA_RULES = [
    (1, 0, False, r"(^|/)[^/]*\.md($|/)"),
    (2, 0, True, r"(^|/)d1[^/]*\.md($|/)"),
    (2, 1, False, r"^docs/.*d[^/]\.txt($|/)"),
    (3, 0, False, r"^src1[^/]/.*Makefile($|/)"),
]
_SECOND_RULES = [
    (4, 0, False, r"(^|/)vendor/"),
    (4, 1, False, r"(^|/)[^/]*\.TSX($|/)"),
    (4, 2, True, r"(^|/)[^/]*\.log($|/)"),
    (4, 3, True, r"(^|/)[^/]*1\.md($|/)"),
]

# One ignore file per source, and a second kind further down; what they say
# depends on the source.
NESTED_TEXT = """case when source in ('src1', 'src11') then concat('test/', chr(10), '!*.md', chr(10))
                      when source = 'src2' then concat('!build', chr(10), 'd*5.rs', chr(10))
                      when source like '%8' then concat('*', chr(10), '!/src/', chr(10), '!d*', chr(10))
                      else concat('/docs/*.JS', chr(10), source, '.txt', chr(10)) end"""
DEEP_TEXT = "concat('*.c', chr(10), '!d1*.c', chr(10), 'src', chr(10))"

_NESTED_RULES = r"""
    select source as base, 10 as si, ri, neg, rx from sources, lateral (values
        ('one', 0, false, '(^|/)test/'), ('one', 1, true, '(^|/)[^/]*\.md($|/)'),
        ('two', 0, true, '(^|/)build($|/)'), ('two', 1, false, '(^|/)d[^/]*5\.rs($|/)'),
        ('eight', 0, false, '(^|/)[^/]*($|/)'), ('eight', 1, true, concat('^', source, '/src/')),
        ('eight', 2, true, '(^|/)d[^/]*($|/)'),
        ('other', 0, false, concat('^', source, '/docs/[^/]*\.JS($|/)')),
        ('other', 1, false, concat('(^|/)', source, '\.txt($|/)'))) as rule(kind, ri, neg, rx)
    where kind = case when source in ('src1', 'src11') then 'one' when source = 'src2' then 'two'
                      when source like '%8' then 'eight' else 'other' end
    union all
    select concat(source, '/src') as base, 21 as si, ri, neg, rx from sources, (values
        (0, false, '(^|/)[^/]*\.c($|/)'), (1, true, '(^|/)d1[^/]*\.c($|/)'),
        (2, false, '(^|/)src($|/)')) as rule(ri, neg, rx)"""


def flags_sql(rules: list[tuple], nested: str | None = None) -> str:
    """Flags by ranking every matching rule for every prefix of every path."""
    values = ", ".join(f"('', {si}, {ri}, {neg}, '{rx}')" for si, ri, neg, rx in rules)
    more = f"union all {nested}" if nested else ""
    return f"""
sources as (select distinct source from documents),
rules as (select * from (values {values}) as r(base, si, ri, neg, rx) {more}),
parts as (select path, string_split(substr(path, length('{ROOT}') + 2), '/') as parts from corpus),
prefixes as (
    select path, i, len(parts) as n, array_to_string(parts[1:i], '/') as p
    from (select path, parts, unnest(range(1, len(parts) + 1)) as i from parts)),
ranked as (
    select path, i, n, neg, row_number() over (
        partition by path, i order by regexp_matches(p, rx) desc, si, ri desc) as place
    from prefixes join rules on (base = '' or starts_with(p, concat(base, '/')))
        and (regexp_matches(p, rx) or (i < n and regexp_matches(concat(p, '/'), rx)))),
winners as (select path, i, n from ranked where place = 1 and not neg),
flags as (
    select path, path in (select path from winners where i < n) as pruned,
           path in (select path from winners where i = n) as ignored
    from corpus)"""


ROOT_ONLY = _ROOT_RULES
ALL_ROOT = _ROOT_RULES + _EXTRA_RULES + _SECOND_RULES


def ignore_files(spark, folder):
    """``path, content`` of the ignore files of all sources and of the root."""
    sources = table(spark, folder, "documents").select("source").distinct()
    first = sources.selectExpr(
        f"concat('{ROOT}/', source, '/.gitignore') as path", f"{NESTED_TEXT} as text"
    )
    deep = sources.selectExpr(
        f"concat('{ROOT}/', source, '/src/.quarryignore') as path", f"{DEEP_TEXT} as text"
    )
    own = spark.createDataFrame(
        [(f"{ROOT}/.gitignore", ROOT_IGNORE), (f"{ROOT}/.quarryignore", ROOT_SECOND)],
        "path string, text string",
    )
    texts = first.unionByName(deep).unionByName(own)
    return texts.select("path", F.col("text").cast("binary").alias("content"))


def ignore_filter(spark, folder):
    rules = ignore.root_rules(spark, [ROOT_IGNORE])
    return ignore.without_ignored(corpus(spark, folder), ROOT, rules).select("path", "size")


def ignore_negation(spark, folder):
    rules = ignore.root_rules(spark, [ROOT_IGNORE, *EXTRA, ROOT_SECOND])
    flagged = ignore.with_ignore_flags(corpus(spark, folder).select("path"), ROOT, rules)
    return flagged.select("path", "pruned", "ignored")


def ignore_sources(spark, folder):
    files = corpus(spark, folder).select("path")
    sets = ignore.rule_sets(ignore_files(spark, folder), ROOT)
    rules = ignore.root_rules(spark, ignore.root_texts(sets, EXTRA))
    deeper = ignore.directory_rules(files, ROOT, rules, ignore.rule_chains(sets))
    return ignore.with_ignore_flags(files, ROOT, rules, deeper).select("path", "pruned", "ignored")


# Every document read as an ignore file, its sentences made into kinds of rules.
_AS_RULES = """case when n_chars % 6 = 0 then replace(text, '. ', concat(chr(10), '! '))
                    when n_chars % 6 = 1 then replace(text, '. ', concat('//', chr(13), chr(10)))
                    when n_chars % 6 = 2 then replace(text, '. ', concat(chr(13), '!//'))
                    when n_chars % 6 = 3 then replace(text, '. ', concat(chr(11), ' #'))
                    when n_chars % 6 = 4 then replace(text, ' ', concat(' ', chr(10), chr(9)))
                    else text end"""


def ignore_parse(spark, folder):
    texts = table(spark, folder, "documents").selectExpr("doc_id", "'' as base", f"{_AS_RULES} as text")
    rules = ignore.parse_rules(texts)
    return rules.select("doc_id", "rule_idx", "negate", "dir_only", "anchored", "source")


_PARSE_SQL = f"""
with lines as (
    select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) as n
    from (select doc_id, regexp_split_to_array({_AS_RULES}, '\\r\\n|[\\n\\r\\x0B]') as parts from documents)),
clean as (select doc_id, n, trim(raw, concat(' ', chr(9))) as line from lines),
bodies as (
    select doc_id, n, starts_with(line, '!') as negate,
           case when starts_with(line, '!') then ltrim(substr(line, 2), concat(' ', chr(9))) else line end as body
    from clean where not starts_with(line, '#')),
rules as (
    select doc_id, n, negate, ends_with(body, '/') as dir_only,
           starts_with(rtrim(body, '/'), '/') as anchored, ltrim(rtrim(body, '/'), '/') as source
    from bodies)
select doc_id, row_number() over (partition by doc_id order by n) - 1 as rule_idx,
       negate, dir_only, anchored, source
from rules where source <> ''"""


# Globs tried on every path, and the regexes they stand for.
GLOBS = [
    ("*.py", r"(^|/)[^/]*\.py($|/)"),
    ("build/", r"(^|/)build/"),
    ("/src1", r"^src1($|/)"),
    ("src1/build", r"^src1/build($|/)"),
    ("**/test/**", r"^.*test/.*($|/)"),
    ("src?/**/d*1.rs", r"^src[^/]/.*d[^/]*1\.rs($|/)"),
    ("d?.txt", r"(^|/)d[^/]\.txt($|/)"),
    (r"d1\*", r"(^|/)d1\*($|/)"),
    (r"\src2/**", r"^src2/.*($|/)"),
    ("*.min.js", r"(^|/)[^/]*\.min\.js($|/)"),
    ("lib***", r"(^|/)lib.*[^/]*($|/)"),
    ("data/d*/", r"^data/d[^/]*/"),
    ("d[12]*", None),
]


def ignore_translate(spark, folder):
    rules = F.array(
        *(
            F.struct(F.lit(glob).alias("pattern"), F.get(globs.compiled_rules(F.lit(glob), F.lit("")), 0).alias("rule"))
            for glob, _ in GLOBS
        )
    )
    relative = paths.relative(F.col("path"), ROOT)
    tried = corpus(spark, folder).select("path", globs.path_form(relative).alias("form"), F.inline(rules))
    matched = globs.rule_matches(F.col("form"), F.col("rule"))
    return tried.select("path", "pattern", F.coalesce(matched, F.lit(False)).alias("matched"))


_TRANSLATE_SQL = f"""
with {SQL}, globs as (select * from (values {", ".join(
    f"('{glob}', " + (f"'{regex}'" if regex else "null") + ")" for glob, regex in GLOBS
)}) as g(pattern, regex))
select path, pattern, coalesce(regexp_matches(substr(path, length('{ROOT}') + 2), regex), false) as matched
from corpus, globs"""


QUERIES = {
    "ignore_parse": ignore_parse,
    "ignore_translate": ignore_translate,
    "ignore_filter": ignore_filter,
    "ignore_negation": ignore_negation,
    "ignore_sources": ignore_sources,
}

ORACLES = {
    "ignore_parse": _PARSE_SQL,
    "ignore_translate": _TRANSLATE_SQL,
    "ignore_filter": f"""with {SQL}, {flags_sql(ROOT_ONLY)}
        select path, size from corpus
        where path in (select path from flags where not pruned and not ignored)""",
    "ignore_negation": f"with {SQL}, {flags_sql(ALL_ROOT)} select * from flags",
    "ignore_sources": f"with {SQL}, {flags_sql(ALL_ROOT, _NESTED_RULES)} select * from flags",
}

NESTED_RULES_SQL = _NESTED_RULES
