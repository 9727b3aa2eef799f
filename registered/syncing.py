"""Bringing an index up to date: diff, counters, stored result, roots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry import CodeIndex, TableSource
from codequarry.operators import diff, ignore, scope
from codequarry.plans.index import new_roots
from codequarry.sources.schemas import local_table
from codequarry.sources.scratch import scratch_dir

from .corpus import ROOT, SQL, corpus, file_table, table
from .ignoring import ALL_ROOT, EXTRA, NESTED_RULES_SQL, flags_sql, ignore_files

SIZE_LIMIT = 20_000

# How the corpus looked before: some files had another name, size or time, and
# one source was not there yet.
_OLD_PATH = "case when n_chars % 13 = 0 then concat(path, '.old') else path end"
_OLD_SIZE = "case when n_chars % 11 = 0 then size + 1 else size end"
_OLD_MTIME = """mtime + case when n_chars % 7 = 0 then 0.5 when n_chars % 5 = 0 then cast(5e-7 as double)
                             else cast(0 as double) end"""

_OLD_SQL = f"""
old as (
    select {_OLD_PATH} as path, {_OLD_SIZE} as size, cast({_OLD_MTIME} as double) as mtime,
           cast(1 as bigint) as gen, text, is_binary
    from corpus where source <> 'src4')"""


def _old_corpus(spark, folder):
    return (
        corpus(spark, folder)
        .where(F.col("source") != "src4")
        .selectExpr(
            f"{_OLD_PATH} as path", f"{_OLD_SIZE} as size", f"cast({_OLD_MTIME} as double) as mtime",
            "cast(1 as bigint) as gen", "text",
        )
    )


def _seen(spark, folder):
    """The corpus after the walk, root rules only."""
    rules = ignore.root_rules(spark, ["build/\n*.log\n"])
    files = scope.without_links(corpus(spark, folder))
    skipped = F.col("ignored") | scope.is_reserved() | scope.is_oversize(SIZE_LIMIT)
    return (
        ignore.with_ignore_flags(files, ROOT, rules)
        .where(~F.col("pruned"))
        .select("path", "size", "mtime", "is_binary", skipped.alias("skipped"))
    )


_WALK_RULES = [(0, 0, False, "(^|/)build/"), (0, 1, False, r"(^|/)[^/]*\.log($|/)")]


def seen_sql(rules, nested=None):
    return f"""
{flags_sql(rules, nested)},
seen as (
    select corpus.path, size, mtime, is_binary, text,
           ignored or size > {SIZE_LIMIT}
           or regexp_extract(corpus.path, '[^/]*$') in ('.gitignore', '.quarryignore') as skipped
    from corpus join flags on corpus.path = flags.path where not is_link and not pruned),
changes as (
    select coalesce(n.path, o.path) as path, coalesce(n.size, o.size) as size,
           coalesce(n.mtime, o.mtime) as mtime, o.gen, n.is_binary, n.text,
           case when n.path is null then 'removed'
                when n.skipped and o.path is not null then 'skipped_removed'
                when n.skipped then 'skipped'
                when o.path is null then 'new'
                when o.size = n.size and abs(o.mtime - n.mtime) < 1e-6 then 'unchanged'
                else 'changed' end as status
    from old o full outer join seen n on o.path = n.path)"""


def sync_diff(spark, folder):
    return diff.snapshot_diff(_old_corpus(spark, folder), _seen(spark, folder))


def sync_first(spark, folder):
    return diff.first_diff(_seen(spark, folder)).drop("gen")


def sync_removed(spark, folder):
    return diff.removed_paths(
        scope.below(_old_corpus(spark, folder), "/corpus/src1"), _seen(spark, folder).where(~F.col("skipped"))
    )


def _counters(spark, folder):
    seen = _seen(spark, folder)
    changes = diff.snapshot_diff(_old_corpus(spark, folder), seen)
    stored = changes.where(F.col("status").isin(diff.NEW, diff.CHANGED)).join(
        seen.where(~F.col("is_binary")).select("path"), "path", "left_semi"
    )
    return diff.counters(changes, stored)


def sync_counters(spark, folder):
    return _counters(spark, folder)


def sync_summary(spark, folder):
    return diff.summary_line(_counters(spark, folder))


_COUNTERS_SQL = """
select cast(count_if(status = 'new' and not is_binary) as bigint) as added,
       cast(count_if(status = 'changed' and not is_binary) as bigint) as updated,
       cast(count_if(status in ('removed', 'skipped_removed')) as bigint) as removed,
       cast(count_if(status in ('skipped', 'skipped_removed')) as bigint) as skipped,
       cast(count_if(status in ('new', 'changed', 'unchanged')) as bigint) as total
from changes"""


def _new_index(spark):
    return CodeIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")


def _synced_index(spark, folder):
    """An index of the old corpus, brought up to date with the present one."""
    index = _new_index(spark)
    old = _old_corpus(spark, folder).withColumn("content", F.col("text").cast("binary"))
    index.index(ROOT, TableSource(old.drop("gen", "text")), no_ignore=True, size_limit=2**40)
    counts = index.index(
        ROOT,
        TableSource(file_table(spark, folder), ignore_files(spark, folder)),
        extra_ignores=EXTRA,
        size_limit=SIZE_LIMIT,
    )
    return index, counts


# The first run keeps everything but the reserved names.
_INDEXED_OLD_SQL = _OLD_SQL.replace("old as (", "old_all as (") + """,
old as (select * from old_all where regexp_extract(path, '[^/]*$') not in ('.gitignore', '.quarryignore'))"""

_SYNC_SQL = f"with {SQL}, {_INDEXED_OLD_SQL}, {seen_sql(ALL_ROOT, NESTED_RULES_SQL)}"


def index_sync(spark, folder):
    _, counts = _synced_index(spark, folder)
    return local_table(spark, ", ".join(f"{name} bigint" for name in counts), [tuple(counts.values())])


def sync_apply(spark, folder):
    """Files and texts after both runs."""
    index, _ = _synced_index(spark, folder)
    files = index.files().drop("indexed_at")
    texts = index.store.snapshot().content().select("path", "text")
    return files.join(texts, "path")


def index_search(spark, folder):
    index, _ = _synced_index(spark, folder)
    return index.search("ouou", root=ROOT, max_results=None)


def index_compact(spark, folder):
    index, _ = _synced_index(spark, folder)
    index.compact()
    return index.stats(ROOT)


def index_stats(spark, folder):
    """Statistics from stored columns, part of the rows being replaced."""
    index, _ = _synced_index(spark, folder)
    return index.stats(ROOT)


def index_search_compacted(spark, folder):
    """A search by grams, and one after a later run that removes a source and adds files."""
    index, _ = _synced_index(spark, folder)
    index.compact()
    first = index.search("ouou", root=ROOT, max_results=None).withColumn("run", F.lit(1))
    left = file_table(spark, folder).where(~F.col("path").startswith("/corpus/src3/"))
    more = left.where(F.col("path").endswith(".py")).withColumn("path", F.concat("path", F.lit("x")))
    index.index(ROOT, TableSource(left.unionByName(more), ignore_files(spark, folder)), extra_ignores=EXTRA, size_limit=SIZE_LIMIT)
    return first.unionByName(index.search("OUOU", root=ROOT, max_results=None).withColumn("run", F.lit(2)))


def clear_count(spark, folder):
    index = _new_index(spark)
    index.index(ROOT, TableSource(file_table(spark, folder), ignore_files(spark, folder)), no_ignore=True)
    cleared = index.clear()
    left = index.files().agg(F.count("*").alias("left"))
    return left.select(F.lit(cleared).cast("bigint").alias("cleared"), "left")


def _roots(spark, folder):
    by_source = table(spark, folder, "documents").select(
        F.concat(F.lit("/corpus/"), "source").alias("path"), "lang"
    )
    known = by_source.where(F.col("lang") == "de").select("path", F.lit("before").alias("created_at")).distinct()
    return known, by_source.select("path", F.lit("now").alias("created_at"))


def roots_register(spark, folder):
    known, given = _roots(spark, folder)
    return known.unionByName(new_roots(known, given))


def roots_list(spark, folder):
    return roots_register(spark, folder).select("path").orderBy("path")


QUERIES = {
    "sync_diff": sync_diff,
    "sync_first": sync_first,
    "sync_removed": sync_removed,
    "sync_counters": sync_counters,
    "sync_summary": sync_summary,
    "index_sync": index_sync,
    "sync_apply": sync_apply,
    "index_search": index_search,
    "index_compact": index_compact,
    "index_stats": index_stats,
    "index_search_compacted": index_search_compacted,
    "clear_count": clear_count,
    "roots_register": roots_register,
    "roots_list": roots_list,
}

from .searching import hits_sql  # noqa: E402
from .statistics import stats_sql  # noqa: E402

# What the index holds afterwards: new and changed text, unchanged files, and
# the old text of files that have become binary.
_AFTER_SQL = f"""{_SYNC_SQL},
after as (
    select path, size, mtime, text from changes where status in ('new', 'changed') and not is_binary
    union all
    select old.path, old.size, old.mtime, old.text from old join changes on old.path = changes.path
    where status = 'unchanged' or (status = 'changed' and changes.is_binary))"""

ORACLES = {
    "sync_diff": f"""with {SQL}, {_OLD_SQL}, {seen_sql(_WALK_RULES)}
        select path, size, mtime, gen, status from changes""",
    "sync_first": f"""with {SQL}, {_OLD_SQL}, {seen_sql(_WALK_RULES)}
        select path, size, mtime, case when skipped then 'skipped' else 'new' end as status from seen""",
    "sync_removed": f"""with {SQL}, {_OLD_SQL}, {seen_sql(_WALK_RULES)}
        select path from old where starts_with(path, '/corpus/src1/')
        and path not in (select path from seen where not skipped)""",
    "sync_counters": f"with {SQL}, {_OLD_SQL}, {seen_sql(_WALK_RULES)} {_COUNTERS_SQL}",
    "sync_summary": f"""with {SQL}, {_OLD_SQL}, {seen_sql(_WALK_RULES)}, counts as ({_COUNTERS_SQL})
        select concat('Indexed ', total, ' files (+', added, ', ~', updated, ', -', removed,
                      ', skipped ', skipped, ')') as line from counts""",
    "index_sync": f"{_SYNC_SQL} {_COUNTERS_SQL}",
    "sync_apply": f"{_AFTER_SQL} select path, size, mtime, sha256(text) as text_hash, text from after",
    "index_search": f"""{_AFTER_SQL}, {hits_sql('ouou', source='after')}
        select path, lineno, text, root from hits""",
    "index_compact": f"""{_AFTER_SQL}, {stats_sql().replace('from corpus', 'from after')}
        select * from stats""",
    "index_stats": f"""{_AFTER_SQL}, {stats_sql().replace('from corpus', 'from after')}
        select * from stats""",
    # A stale binary keeps its old row as long as its file is there.
    "index_search_compacted": f"""{_AFTER_SQL}, {hits_sql('ouou', source='after')},
        second as (
            select path, text from after where not starts_with(path, '/corpus/src3/')
            union all
            select concat(corpus.path, 'x'), corpus.text from corpus join seen on corpus.path = seen.path
            where ends_with(corpus.path, '.py') and not skipped and not corpus.is_binary
            and not starts_with(corpus.path, '/corpus/src3/')),
        {hits_sql('ouou', source='second').replace('lines as', 'lines2 as').replace('from lines', 'from lines2')
          .replace('positions as', 'positions2 as').replace('from positions', 'from positions2').replace('hits as', 'hits2 as')}
        select path, lineno, text, root, 1 as run from hits union all select path, lineno, text, root, 2 from hits2""",
    "clear_count": f"""with {SQL} select count(*) as cleared, cast(0 as bigint) as left from corpus
        where not is_link and not is_binary and size <= 2097152
        and regexp_extract(path, '[^/]*$') not in ('.gitignore', '.quarryignore')""",
    "roots_register": """
        with given as (select concat('/corpus/', source) as path, lang from documents),
        known as (select distinct path from given where lang = 'de')
        select path, 'before' as created_at from known
        union all select distinct path, 'now' from given where path not in (select path from known)""",
    "roots_list": "select distinct concat('/corpus/', source) as path from documents",
}
