"""Sources, text decoding, row filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry.functions import language, paths, text as text_fn
from codequarry.operators import scope
from codequarry.sources import colocated, filetree
from codequarry.sources.scratch import Staging, scratch_dir

from .corpus import ROOT, SQL, corpus, dirname_sql, table

# Endings with broken UTF-8, and what they decode to.
BROKEN_ENDINGS = [
    (b"\xff", "�"),
    (b"\xc3(", "�("),
    (b"\xf0\x9f\x98", "�"),
    (b"\xed\xa0\x80", "���"),
    (b"caf\xc3\xa9", "café"),
    (b"\xe2\x82", "�"),
    (b"\xf4\x90\x80\x80z", "����z"),
]

# Characters turned into a control byte to reach each side of the binary test.
MASKS = {"none": "", "spaces": " ", "many": " eaoi", "most": " eaointrsh"}

SIZE_LIMIT = 2000


def _write_tree(spark, folder):
    """The documents as a tree of text files, one directory per source."""
    location = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, folder, "documents").select("source", "text").write.partitionBy("source").text(location)
    return location


def _by_directory(files):
    content = F.col("content")
    text = text_fn.decode_text(content)
    return files.groupBy(paths.basename(paths.dirname(F.col("path"))).alias("dir")).agg(
        F.sum("size").cast("bigint").alias("bytes"),
        F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))))
        .cast("bigint").alias("newlines"),
    )


def file_source(spark, folder):
    return _by_directory(filetree.binary_file_table(spark, _write_tree(spark, folder)))


def file_tree(spark, folder):
    listing = filetree.list_tree(spark, _write_tree(spark, folder), Staging(spark))
    data = listing.where(paths.basename(F.col("path")).startswith("part-"))
    return _by_directory(filetree.read_content(data))


_TREE_SQL = """
select concat('source=', source) as dir, cast(sum(strlen(text) + 1) as bigint) as bytes,
       cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as newlines
from documents group by source"""


def decode_text(spark, folder):
    endings = F.array(*(F.lit(ending) for ending, _ in BROKEN_ENDINGS))
    broken = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(endings).alias("ending", "bytes"), F.col("text").cast("binary").alias("raw")
    )
    return broken.select(
        "doc_id",
        F.col("ending").cast("bigint").alias("ending"),
        text_fn.decode_text(F.concat("raw", "bytes")).alias("text"),
    )


_DECODE_SQL = """
select doc_id, ending, concat(text, tail) as text
from documents, (values {}) as endings(ending, tail)""".format(
    ", ".join(f"(cast({i} as bigint), '{tail}')" for i, (_, tail) in enumerate(BROKEN_ENDINGS))
)


def binary_sniff(spark, folder):
    def masked(chars):
        return F.regexp_replace("text", f"[{chars}]", "\x01") if chars else F.col("text")

    all_masks = F.array(
        *(
            F.struct(F.lit(name).alias("mask"), masked(chars).alias("masked"))
            for name, chars in MASKS.items()
        ),
        F.struct(F.lit("nul_at_end").alias("mask"), F.concat("text", F.lit("\0")).alias("masked")),
    )
    variants = table(spark, folder, "documents").select("doc_id", F.inline(all_masks))
    return variants.select(
        "doc_id", "mask", text_fn.looks_binary(F.col("masked").cast("binary")).alias("is_binary")
    )


# Control bytes never are part of a longer character, so the sample's share of
# them can be counted in the hex digits of the bytes.
_SNIFF_SQL = """
with variants as (
    select doc_id, mask, hex(encode(masked)) as digits from (
        select doc_id, 'none' as mask, text as masked from documents
        union all select doc_id, 'spaces', translate(text, ' ', chr(1)) from documents
        union all select doc_id, 'many', translate(text, ' eaoi', repeat(chr(1), 5)) from documents
        union all select doc_id, 'most', translate(text, ' eaointrsh', repeat(chr(1), 10)) from documents)
    union all select doc_id, 'nul_at_end', concat(hex(encode(text)), '00') from documents),
samples as (
    select doc_id, mask, regexp_extract_all(substr(digits, 1, 16384), '..') as bytes from variants)
select doc_id, mask,
       len(bytes) > 0 and (list_contains(bytes, '00')
           or len(list_filter(bytes, lambda b: b < '20' and b not in ('09', '0A', '0D'))) / len(bytes) > 0.30)
       as is_binary
from samples"""


def text_hash(spark, folder):
    return corpus(spark, folder).select("path", text_fn.text_hash(F.col("text")).alias("text_hash"))


def line_count(spark, folder):
    return corpus(spark, folder).select("path", text_fn.line_count(F.col("text")).alias("n_lines"))


def path_parts(spark, folder):
    path = F.col("path")
    return corpus(spark, folder).select(
        "path",
        paths.basename(path).alias("name"),
        paths.dirname(path).alias("parent"),
        paths.relative(path, ROOT).alias("relative"),
    )


def file_extension(spark, folder):
    urls = table(spark, folder, "pages").select(F.col("url").alias("path"))
    names = corpus(spark, folder).select("path").unionByName(urls)
    return names.select("path", paths.extension(F.lower(paths.basename(F.col("path")))).alias("extension"))


def detect_language(spark, folder):
    urls = table(spark, folder, "pages").select(F.col("url").alias("path"))
    names = corpus(spark, folder).select("path").unionByName(urls)
    return names.select("path", language.language_of(F.col("path")).alias("language"))


# Names of the corpus and of the pages, whose only known extension is .html.
LANGUAGE_SQL = """case
    when lower(name) = 'makefile' then 'Makefile' when lower(name) = 'cmakelists.txt' then 'CMake'
    when lower(name) like '%.py' then 'Python' when lower(name) like '%.js' then 'JavaScript'
    when lower(name) like '%.md' then 'Markdown' when lower(name) like '%.txt' then 'Text'
    when lower(name) like '%.log' then 'Log' when lower(name) like '%.c' then 'C'
    when lower(name) like '%.tsx' then 'TypeScript' when lower(name) like '%.rs' then 'Rust'
    when lower(name) like '%.html' then 'HTML' when lower(name) = '.gitignore' then 'GitIgnore'
    else 'Unknown' end"""

_NAMES_SQL = f"""
with {SQL},
names as (
    select path, regexp_extract(path, '[^/]*$') as name
    from (select path from corpus union all select url from pages))"""


def filter_descendants(spark, folder):
    # Neither /corpus/src10 nor a pattern character may match.
    root = scope.below(corpus(spark, folder), "/corpus/src1/")
    none = scope.below(corpus(spark, folder), "/corpus/src_")
    upper = scope.below(corpus(spark, folder), "/corpus/SRC1")
    return root.unionByName(none).unionByName(upper).select("path")


def filter_paths(spark, folder):
    wanted = corpus(spark, folder).where(F.col("source") == "src2").select("path")
    files = corpus(spark, folder).select("path", "size")
    # Few enough paths for an In filter, and enough for a join instead.
    short = [f"/corpus/src{i}/x/../docs/d{j}.md" for i in range(20) for j in range(2, 100, 16)]
    long = [f"/corpus/src{i}/src/d{j}.py" for i in range(20) for j in range(0, 10_000, 80)]
    listed = scope.among(files, short).unionByName(scope.among(files, long))
    return scope.among(files, wanted).unionByName(listed)


def filter_reserved(spark, folder):
    return scope.without_reserved(corpus(spark, folder), reserved=("Makefile",)).select("path")


def filter_size(spark, folder):
    return scope.within_size(corpus(spark, folder), SIZE_LIMIT).select("path", "size")


def filter_links(spark, folder):
    return scope.without_links(corpus(spark, folder)).select("path")


def join_files_content(spark, folder):
    files = corpus(spark, folder).select("path", "size", "mtime")
    content = corpus(spark, folder).select("path", "text")
    location = f"{scratch_dir(spark)}/colocated-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return colocated.joined(*(colocated.write(rows, location, buckets) for rows in (files, content)))


QUERIES = {
    "file_source": file_source,
    "file_tree": file_tree,
    "decode_text": decode_text,
    "binary_sniff": binary_sniff,
    "text_hash": text_hash,
    "line_count": line_count,
    "path_parts": path_parts,
    "file_extension": file_extension,
    "detect_language": detect_language,
    "filter_descendants": filter_descendants,
    "filter_paths": filter_paths,
    "filter_reserved": filter_reserved,
    "filter_size": filter_size,
    "filter_links": filter_links,
    "join_files_content": join_files_content,
}

ORACLES = {
    "file_source": _TREE_SQL,
    "file_tree": _TREE_SQL,
    "decode_text": _DECODE_SQL,
    "binary_sniff": _SNIFF_SQL,
    "text_hash": f"with {SQL} select path, sha256(text) as text_hash from corpus",
    "line_count": f"""with {SQL}
        select path, cast(length(text) - length(replace(text, chr(10), ''))
                          + case when ends_with(text, chr(10)) then 0 else 1 end as bigint) as n_lines
        from corpus""",
    "path_parts": f"""with {SQL}
        select path, regexp_extract(path, '[^/]*$') as name, {dirname_sql('path')} as parent,
               substr(path, length('{ROOT}') + 2) as relative from corpus""",
    "file_extension": f"""{_NAMES_SQL}
        select path, regexp_extract(lower(name), '^\\.*[^.].*(\\.[^.]*)$', 1) as extension from names""",
    "detect_language": f"{_NAMES_SQL} select path, {LANGUAGE_SQL} as language from names",
    "filter_descendants": f"with {SQL} select path from corpus where starts_with(path, '/corpus/src1/')",
    "filter_paths": f"""with {SQL}
        select path, size from corpus where source = 'src2'
        union all select path, size from corpus
        where regexp_full_match(path, '/corpus/src1?[0-9]/docs/d[0-9]{{1,2}}\\.md')
        union all select path, size from corpus
        where regexp_full_match(path, '/corpus/src1?[0-9]/src/d[0-9]{{1,4}}\\.py')""",
    "filter_reserved": f"""with {SQL} select path from corpus
        where regexp_extract(path, '[^/]*$') not in ('.gitignore', '.quarryignore', 'Makefile')""",
    "filter_size": f"with {SQL} select path, size from corpus where size <= {SIZE_LIMIT}",
    "filter_links": f"with {SQL} select path from corpus where not is_link",
    "join_files_content": f"""with {SQL}, files as (select path, size, mtime from corpus),
        content as (select path, text from corpus)
        select files.path, size, mtime, text from files join content on files.path = content.path""",
}
