"""Literal substring search."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import search

from .corpus import SQL, corpus, dirname_sql, quoted, table

MULTI_LINE = ".\nTH"


def hits_sql(pattern: str, case: bool = False, source: str = "corpus", where: str = "true") -> str:
    """Hits by trying every position of every line holding the pattern."""
    fold = (lambda sql: sql) if case else (lambda sql: f"lower({sql})")
    return f"""
lines as (
    select path, unnest(string_split(text, chr(10))) as line,
           generate_subscripts(string_split(text, chr(10)), 1) as lineno
    from {source} where text <> '' and {where}),
positions as (
    select path, lineno, line, unnest(range(0, length(line))) as o from lines
    where contains({fold('line')}, {fold(quoted(pattern))})),
hits as (
    select path, cast(lineno as bigint) as lineno, line as text, {dirname_sql('path')} as root from positions
    where substr({fold('line')}, cast(o + 1 as bigint), {len(pattern)}) = {fold(quoted(pattern))})"""


def multi_line_sql(pattern: str) -> str:
    """The same by trying every position of every text holding the pattern."""
    return f"""
positions as (
    select path, text, unnest(range(0, length(text))) as o from corpus
    where contains(lower(text), lower({quoted(pattern)}))),
starts as (
    select path, text, substr(text, 1, cast(o as bigint)) as ahead, substr(text, cast(o + 1 as bigint)) as rest
    from positions where substr(lower(text), cast(o + 1 as bigint), {len(pattern)}) = lower({quoted(pattern)})),
hits as (
    select path, cast(1 + length(ahead) - length(replace(ahead, chr(10), '')) as bigint) as lineno,
           concat(string_split(ahead, chr(10))[-1], string_split(rest, chr(10))[1]) as text,
           {dirname_sql('path')} as root
    from starts)"""


def _search(pattern, **options):
    return lambda spark, folder: search.search(corpus(spark, folder), pattern, **options)


def search_in_paths(spark, folder):
    files = corpus(spark, folder)
    build = files.where(F.contains("path", F.lit("/build/"))).select("path")
    return search.search(files, "ouou", root="/corpus", paths=build, max_results=None)


def search_pages(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return search.search(pages, "<h1>", max_results=None, case=True)


def search_conversations(spark, folder):
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("/talk/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
                 F.lit("."), "role").alias("path"),
        "text",
    )
    return search.search(turns, "ÉOU", max_results=None)


def search_grep_lines(spark, folder):
    return search.grep_lines(search.search(corpus(spark, folder), "License", max_results=None, case=True))


def search_envelope(spark, folder):
    found = search.envelope(
        search.search(corpus(spark, folder), "ouou", root="/corpus/src1", max_results=search.TOOL_MAX_RESULTS)
    )
    return found.select(
        "count",
        F.array_join(
            F.transform("results", lambda hit: F.concat(hit["path"], F.lit(":"), hit["lineno"].cast("string"))),
            "\n",
        ).alias("results"),
    )


def search_count(spark, folder):
    return search.count_hits(corpus(spark, folder), "tion")


_TURNS_SQL = """
turns as (
    select concat('/talk/', cast(conv_id as string), '/', cast(turn as string), '.', role) as path, text
    from conversations)"""

QUERIES = {
    "search_ci": _search("THE REN", max_results=None),
    "search_cs": _search("Ouou", max_results=None, case=True),
    "search_root": _search("ouou", root="/corpus/src1", max_results=None),
    "search_in_paths": search_in_paths,
    "search_overlap": _search("!!", max_results=None),
    "search_overlap_text": _search("ouo", max_results=None),
    "search_non_ascii": _search("ÓNCI", max_results=None),
    "search_special": _search(".*", max_results=None),
    "search_multiline": _search(MULTI_LINE, max_results=None),
    "search_topn": _search("tion"),
    "search_topn_interactive": _search("the", max_results=search.INTERACTIVE_MAX_RESULTS, case=True),
    "search_topn_zero": _search("the", max_results=0),
    "search_empty": _search("", max_results=None),
    "search_pages": search_pages,
    "search_conversations": search_conversations,
    "search_grep_lines": search_grep_lines,
    "search_envelope": search_envelope,
    "search_count": search_count,
}

_HITS = "select path, lineno, text, root from hits"

ORACLES = {
    "search_ci": f"with {SQL}, {hits_sql('THE REN')} {_HITS}",
    "search_cs": f"with {SQL}, {hits_sql('Ouou', case=True)} {_HITS}",
    "search_root": f"""with {SQL}, {hits_sql('ouou', where="starts_with(path, '/corpus/src1/')")} {_HITS}""",
    "search_in_paths": f"""with {SQL}, {hits_sql('ouou', where="contains(path, '/build/')")} {_HITS}""",
    "search_overlap": f"with {SQL}, {hits_sql('!!')} {_HITS}",
    "search_overlap_text": f"with {SQL}, {hits_sql('ouo')} {_HITS}",
    "search_non_ascii": f"with {SQL}, {hits_sql('ÓNCI')} {_HITS}",
    "search_special": f"with {SQL}, {hits_sql('.*')} {_HITS}",
    "search_multiline": f"with {SQL}, {multi_line_sql(MULTI_LINE)} {_HITS}",
    "search_topn": f"with {SQL}, {hits_sql('tion')} {_HITS} order by path, lineno limit 200",
    "search_topn_interactive": f"with {SQL}, {hits_sql('the', case=True)} {_HITS} order by path, lineno limit 500",
    "search_topn_zero": f"with {SQL}, {hits_sql('the')} {_HITS} limit 0",
    "search_empty": f"with {SQL} select path, cast(0 as bigint) as lineno, text, path as root from corpus limit 0",
    "search_pages": f"""with pages_corpus as (select url as path, html as text from pages),
        {hits_sql('<h1>', case=True, source='pages_corpus')} {_HITS}""",
    "search_conversations": f"with {_TURNS_SQL}, {hits_sql('ÉOU', source='turns')} {_HITS}",
    "search_grep_lines": f"""with {SQL}, {hits_sql('License', case=True)}
        select concat(path, ':', cast(lineno as string), ': ', text) as line from hits""",
    "search_envelope": f"""with {SQL}, {hits_sql('ouou', where="starts_with(path, '/corpus/src1/')")},
        top as (select path, lineno from hits order by path, lineno limit 100)
        select count(*) as count,
               string_agg(concat(path, ':', cast(lineno as string)), chr(10) order by path, lineno) as results
        from top""",
    "search_count": f"with {SQL}, {hits_sql('tion')} select count(*) as count from hits",
}
