"""Files and lines per language."""

from __future__ import annotations

from codequarry.operators import langstats

from .corpus import SQL, corpus
from .files import LANGUAGE_SQL


def _on_corpus(operator, *arguments, then=None):
    def query(spark, folder):
        result = operator(corpus(spark, folder), *arguments)
        return then(result) if then else result

    return query


def stats_envelope(spark, folder):
    return langstats.stats_envelope(corpus(spark, folder), "/corpus/src1").selectExpr(
        "root", "to_json(languages) as languages", "totals.files as files", "totals.lines as lines"
    )


QUERIES = {
    "lang_stats": _on_corpus(langstats.language_stats),
    "lang_stats_root": _on_corpus(langstats.language_stats, "/corpus/src1"),
    "lang_stats_min_lines": _on_corpus(langstats.language_stats, None, 20),
    "lang_totals": _on_corpus(langstats.totals),
    "lang_totals_empty": _on_corpus(langstats.totals, "/nowhere"),
    "stats_json": _on_corpus(langstats.language_stats, then=langstats.to_json),
    "stats_json_compact": _on_corpus(
        langstats.language_stats, then=lambda stats: langstats.to_json(stats, indent=None)
    ),
    "stats_report": _on_corpus(langstats.language_stats, then=langstats.report),
    "stats_report_empty": _on_corpus(langstats.language_stats, "/nowhere", then=langstats.report),
    "stats_envelope": stats_envelope,
    "stats_totals_line": _on_corpus(langstats.totals, then=langstats.totals_line),
}


def stats_sql(where: str = "true", min_lines: int = 3) -> str:
    return f"""
counted as (
    select path, regexp_extract(path, '[^/]*$') as name,
           length(text) - length(replace(text, chr(10), ''))
           + case when ends_with(text, chr(10)) then 0 else 1 end as n
    from corpus where text <> '' and {where}),
stats as (
    select {LANGUAGE_SQL} as language, count(*) as files,
           cast(sum(case when n >= {min_lines} then n else 0 end) as bigint) as lines
    from counted group by 1),
totals as (
    select cast(coalesce(sum(files), 0) as bigint) as files, cast(coalesce(sum(lines), 0) as bigint) as lines
    from stats)"""


_BELOW_NOWHERE = "starts_with(path, '/nowhere/')"
_BELOW_SRC1 = "starts_with(path, '/corpus/src1/')"
_ORDER = "order by lines desc, files desc, language"
_OBJECT = """concat('{"language":"', language, '","files":', files, ',"lines":', lines, '}')"""
_PRETTY = """concat('    {', chr(10), '      "language": "', language, '",', chr(10),
    '      "files": ', files, ',', chr(10), '      "lines": ', lines, chr(10), '    }')"""
_LINE = "concat(rpad({0}, cast(greatest(w, length({0})) as int), ' '), format('  {{:8d}} files  {{:10d}} lines', files, lines))"

ORACLES = {
    "lang_stats": f"with {SQL}, {stats_sql()} select * from stats",
    "lang_stats_root": f"with {SQL}, {stats_sql(_BELOW_SRC1)} select * from stats",
    "lang_stats_min_lines": f"with {SQL}, {stats_sql(min_lines=20)} select * from stats",
    "lang_totals": f"with {SQL}, {stats_sql()} select * from totals",
    "lang_totals_empty": f"with {SQL}, {stats_sql(_BELOW_NOWHERE)} select * from totals",
    "stats_json": f"""with {SQL}, {stats_sql()},
        body as (select string_agg({_PRETTY}, concat(',', chr(10)) {_ORDER}) as rows from stats)
        select concat('{{', chr(10), '  "languages": [', chr(10), rows, chr(10), '  ],', chr(10),
            '  "totals": {{', chr(10), '    "files": ', files, ',', chr(10), '    "lines": ', lines, chr(10),
            '  }}', chr(10), '}}') as json
        from body, totals""",
    "stats_json_compact": f"""with {SQL}, {stats_sql()},
        body as (select string_agg({_OBJECT}, ',' {_ORDER}) as rows from stats)
        select concat('{{"languages":[', rows, '],"totals":{{"files":', files, ',"lines":', lines, '}}}}') as json
        from body, totals""",
    "stats_report": f"""with {SQL}, {stats_sql()},
        width as (select max(length(language)) as w, count(*) as n from stats)
        select row_number() over ({_ORDER}) as line_no, {_LINE.format('language')} as line from stats, width
        union all select n + 1, repeat('-', w + 34) from width
        union all select n + 2, {_LINE.format("'TOTAL'")} from totals, width""",
    "stats_report_empty": f"""with {SQL}, {stats_sql(_BELOW_NOWHERE)}
        select cast(1 as bigint) as line_no, 'No indexed files.' as line from totals where files = 0""",
    "stats_envelope": f"""with {SQL}, {stats_sql(_BELOW_SRC1)},
        body as (select string_agg({_OBJECT}, ',' {_ORDER}) as rows from stats)
        select '/corpus/src1' as root, concat('[', rows, ']') as languages, files, lines from body, totals""",
    "stats_totals_line": f"""with {SQL}, {stats_sql()}
        select concat('Totals: ', files, ' files, ', lines, ' lines') as line from totals""",
}
