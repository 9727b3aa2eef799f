import random
import re

import pytest
from naive import hits
from pyspark.sql import functions as F

from codequarry.operators import scope, search


@pytest.fixture(scope="module")
def corpus(spark):
    def make(texts):
        return spark.createDataFrame(list(texts.items()), "path string, text string")

    return make


def found(result):
    return [(row.path, row.lineno, row.text) for row in result.collect()]


def test_substring_with_line_numbers(corpus):
    rows = search.search(corpus({"/r/a.py": "alpha\nbeta\nalpha again\n"}), "alpha").collect()
    assert [(row.lineno, row.text, row.root) for row in rows] == [(1, "alpha", "/r"), (3, "alpha again", "/r")]


def test_case(corpus):
    files = corpus({"/r/a.py": "Hello World\n"})
    assert search.search(files, "hello").count() == 1
    assert search.search(files, "HELLO").count() == 1
    assert search.search(files, "hello", case=True).count() == 0
    assert search.search(files, "Hello", case=True).count() == 1


def test_root_is_an_exact_prefix(corpus):
    files = corpus({f"/t/{name}/a.py": "needle\n" for name in ("root", "root-app", "ROOT", "r_ot")})
    assert search.search(files, "needle").count() == 4
    assert found(search.search(files, "needle", root="/t/root")) == [("/t/root/a.py", 1, "needle")]
    assert found(search.search(files, "needle", root="/t/./root/")) == [("/t/root/a.py", 1, "needle")]
    assert search.search(files, "needle", root="/").count() == 4
    assert found(search.search(files, "needle", root="/t/r_ot")) == [("/t/r_ot/a.py", 1, "needle")]


def test_paths(spark, corpus):
    files = corpus({f"/r/{name}": "x\n" for name in "abc"})
    assert search.search(files, "x", paths=["/r/a", "/r/q/../b"]).count() == 2
    assert search.search(files, "x", paths=[]).count() == 3
    assert search.search(files, "x", root="/other", paths=["/r/a"]).count() == 0
    many = [f"/r/{i}" for i in range(1000)] + ["/r/a"]
    assert search.search(files, "x", paths=many).count() == 1
    assert search.search(files, "x", paths=files.where("path > '/r/a'")).count() == 2


def test_short_and_long_path_lists_take_one_plan(corpus):
    files = corpus({f"/r/{name}": "x" for name in "abc"}).select("text", "path")
    for listed in (["/r/c", "/r/a"], [f"/r/{i}" for i in range(1000)] + ["/r/a"]):
        among = scope.among(files, listed)
        assert among.columns == ["text", "path"]
        assert "LeftSemi" in among._jdf.queryExecution().analyzed().toString()


def test_limit_and_order(corpus):
    files = corpus({"/b": "x\n" * 10, "/a": "xx\nx"})
    assert found(search.search(files, "x", max_results=3)) == [("/a", 1, "xx"), ("/a", 1, "xx"), ("/a", 2, "x")]
    assert found(search.search(files, "x", max_results=4))[-1] == ("/b", 1, "x")
    assert search.search(files, "x", max_results=0).count() == 0
    assert search.search(files, "x", max_results=-1).count() == 0
    assert search.search(files, "x", max_results=None).count() == 13


def test_more_hits_on_a_line_than_asked_for(corpus):
    assert search.search(corpus({"/a": "a" * 500}), "a", max_results=7).count() == 7


def test_empty_pattern_and_empty_text(corpus):
    assert search.search(corpus({"/a": "x\n", "/b": ""}), "").count() == 0
    assert search.search(corpus({"/b": ""}), "\n").count() == 0


def test_outputs(corpus):
    files = corpus({"/r/a.py": "one\ntwo one\n"})
    lines = search.grep_lines(search.search(files, "one")).collect()
    assert [row.line for row in lines] == ["/r/a.py:1: one", "/r/a.py:2: two one"]
    row = search.envelope(search.search(files, "one")).first()
    assert row["count"] == 2
    assert [hit.asDict() for hit in row.results] == [
        {"path": "/r/a.py", "lineno": 1, "text": "one", "root": "/r"},
        {"path": "/r/a.py", "lineno": 2, "text": "two one", "root": "/r"},
    ]
    empty = search.envelope(search.search(files, "none")).first()
    assert (empty["count"], empty.results) == (0, [])
    assert search.count_hits(files, "o").first()["count"] == 3
    assert search.count_hits(files, "").first()["count"] == 0


PATTERNS = [
    "a", "aa", "aba", "ab", "A", "\n", "\n\n", "a\n", "\na", "a\nb", "b\n\na", "a\n\n\nb", "\r", "\r\n", "a\r\nb",
    "\\E", "\\Q", "\\Ea\\Q", ".*", "%", "_", "$", "^a", "é", "É", "éé", "ß", "ÉA", "𝒳", "a𝒳", "𝒳𝒳", "Σ", "(a|b)", "[ab]",
]


@pytest.mark.parametrize("case", [False, True])
def test_random_texts_against_every_position(spark, corpus, case):
    rng = random.Random(7)
    pieces = [*"aabbAB\n\n", "\r\n", "\\E", "\\Q", ".*", "%", "_", "$", "^", "éé", "É", "ß", "𝒳", "𝒳", "Σ", "(a|b)", "[ab]"]
    texts = {f"/r/{i:03}": "".join(rng.choices(pieces, k=rng.randrange(60))) for i in range(120)}
    files = corpus(texts).cache()
    for pattern in PATTERNS:
        expected = [hit for path in sorted(texts) for hit in hits(path, texts[path], pattern, case)]
        assert found(search.search(files, pattern, max_results=None, case=case).orderBy("path", "lineno")) == expected, pattern
        assert found(search.search(files, pattern, max_results=25, case=case)) == expected[:25], pattern
        assert search.count_hits(files, pattern, case).first()["count"] == len(expected), pattern
    files.unpersist()


def test_plan_filters_before_splitting_and_never_shuffles(spark, corpus, tmp_path):
    corpus({"/r/a.py": "needle\n"}).write.parquet(str(tmp_path / "content"))
    content = spark.read.parquet(str(tmp_path / "content"))
    result = search.search(content, "needle", root="/r", paths=["/r/a.py"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/r/)" in plan
    assert re.search(r"Filter .*path#\d+ >= /r/a.py", plan)
    assert "TakeOrderedAndProject" in plan
    # Only the listed paths and the bound from the first step are exchanged.
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert "Contains(lower(text" in plan[plan.index("posexplode"):]


def rows_scanned(result):
    """Rows that the Parquet scans of a collected result hand on."""
    nodes, total = [result._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        inner = getattr(node, "executedPlan", None) if node.nodeName() == "AdaptiveSparkPlan" else None
        inner = node.plan if node.nodeName().endswith("QueryStage") else inner
        nodes += [inner()] if inner else [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_path_lists_reach_the_scan_as_several_ranges(corpus, tmp_path):
    """The texts between listed paths that lie far apart are not read."""
    files = corpus({f"/r/{i:04}": f"w{i} " * 100 for i in range(400)})
    files.repartitionByRange(1, "path").sortWithinPartitions("path").write.option("parquet.page.row.count.limit", 16).options(
        **{"parquet.page.size.row.check.min": 8}).parquet(str(tmp_path / "content"))
    content = files.sparkSession.read.parquet(str(tmp_path / "content"))
    listed = ["/r/0010", "/r/0200", "/r/0390"]
    among = scope.among(content, listed)
    assert sorted(row.path for row in among.collect()) == listed
    assert rows_scanned(among) <= 3 * 32 < 380
    many = [f"/r/{i:04}" for i in range(1000)]
    within = scope.among(content, many)._jdf.queryExecution().optimizedPlan().toString()
    assert 2 < within.count(">= /r/") <= scope.MOST_RANGES


def test_first_step_of_the_first_hits_moves_no_text(corpus, tmp_path):
    files = corpus({f"/{i:02}": f"x\nneedle {i} needle\n" for i in range(40)})
    files.repartition(4).write.parquet(str(tmp_path / "content"))
    content = files.sparkSession.read.parquet(str(tmp_path / "content"))
    result = search.search(content, "needle", max_results=5)
    assert found(result) == [(f"/{i:02}", 2, f"needle {i} needle") for i in (0, 0, 1, 1, 2)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("Subquery"):]
    first = first[first.index("TakeOrderedAndProject"):].split("\n")[0]
    assert "output=[path" in first and "text" not in first
    # The texts after the last of the first files are left out before lines are split.
    assert re.search(r"path#\d+ <= Subquery", plan)


def test_hits_of_two_files_with_equal_names_stay_apart(corpus):
    files = corpus({"/x/a": "q", "/y/a": "q"}).withColumn("extra", F.lit(1))
    assert [row.root for row in search.search(files, "q").collect()] == ["/x", "/y"]
