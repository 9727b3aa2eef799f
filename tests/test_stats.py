import json
import os.path

from naive import lines_of

from codequarry.functions import language, text as text_fn
from codequarry.operators import langstats
from pyspark.sql import functions as F


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def rows(result):
    return [tuple(row) for row in result.collect()]


def languages(spark, names):
    table = spark.createDataFrame([(name,) for name in names], "path string")
    return {row.path: row.language for row in table.select("path", language.language_of(F.col("path")).alias("language")).collect()}


def test_language_of_known_names(spark):
    expected = {
        "main.py": "Python", "app.tsx": "TypeScript", "Dockerfile": "Dockerfile", "Makefile": "Makefile",
        "unknown.xyz": "Unknown", "/r/.gitignore": "GitIgnore", "a/.env": "Unknown", "a/x.env": "Env",
        "x.tar.gz": "Unknown", "SETUP.PY": "Python", "package.json": "JSON", "go.mod": "Go", "a.": "Unknown",
        "...py": "Unknown", "..a.py": "Python", "/py": "Unknown", "dir.py/x": "Unknown", "x.R": "R",
        "\u212aeep.md": "Markdown", "cMakeLists.txt": "CMake", ".bashrc": "Shell", "": "Unknown",
    }
    assert languages(spark, expected) == expected


def test_every_entry_of_both_tables(spark):
    by_name = language.NAME_LANGUAGE
    assert languages(spark, [f"/d/{name.upper()}" for name in by_name]) == {
        f"/d/{name.upper()}": value for name, value in by_name.items()
    }
    by_extension = {f"/d/x.y{ext.upper()}": value for ext, value in language.EXTENSION_LANGUAGE.items()}
    assert languages(spark, by_extension) == by_extension
    assert (len(by_extension), len(by_name)) == (102, 23)


def test_extension_is_that_of_splitext(spark):
    from codequarry.functions import paths

    alphabet = ["a", ".", "B", " ", "\n", "é", "-"]
    names = [""]
    for _ in range(4):
        names += [name + letter for name in names[-7**3:] for letter in alphabet]
    names = sorted(set(names))
    table = spark.createDataFrame([(name,) for name in names], "name string")
    got = {row.name: row.ext for row in table.select("name", paths.extension(F.col("name")).alias("ext")).collect()}
    assert got == {name: os.path.splitext(name)[1] for name in names}


def test_dirname_and_basename(spark):
    from codequarry.functions import paths

    names = ["/", "/a", "a", "", "/a/b", "a/b", "/a/b/", "/a.b/c.d", "//a", "/é/ü/𝒳"]
    table = spark.createDataFrame([(name,) for name in names], "p string")
    got = table.select("p", paths.dirname(F.col("p")), paths.basename(F.col("p"))).collect()
    assert [tuple(row) for row in got] == [(n, os.path.dirname(n), os.path.basename(n)) for n in names]


def test_line_count(spark):
    texts = ["x", "x\n", "\n", "a\nb", "a\nb\n", "a\r\nb", "\n\n", "é\n𝒳"]
    table = spark.createDataFrame([(text,) for text in texts], "text string")
    got = {row.text: row.n for row in table.select("text", text_fn.line_count(F.col("text")).alias("n")).collect()}
    assert got == {text: lines_of(text) for text in texts}


def test_min_lines(spark):
    files = corpus(spark, {"/r/a.py": "1\n2\n3\n", "/r/b.py": "1\n2\n", "/r/c.js": "1\n", "/r/empty.py": ""})
    assert rows(langstats.language_stats(files, "/r")) == [("Python", 2, 3), ("JavaScript", 1, 0)]
    assert rows(langstats.totals(files, "/r")) == [(3, 3)]
    assert rows(langstats.totals(files, "/r", min_lines=1)) == [(3, 6)]


def test_order(spark):
    files = corpus(spark, {"/a.py": "1", "/a.js": "1", "/b.js": "1", "/a.go": "1\n2\n3", "/a.c": "1"})
    assert [row[0] for row in rows(langstats.language_stats(files))] == ["Go", "JavaScript", "C", "Python"]


def test_root(spark):
    files = corpus(spark, {f"/t/{name}/a.py": "1\n2\n3\n" for name in ("root", "root-app", "ROOT")})
    assert rows(langstats.totals(files, "/t/root")) == [(1, 3)]


def test_empty(spark):
    files = corpus(spark, {"/r/a.py": "x"}).limit(0)
    stats = langstats.language_stats(files)
    assert rows(stats) == []
    assert rows(langstats.totals(files)) == [(0, 0)]
    assert [row.line for row in langstats.report(stats).collect()] == ["No indexed files."]
    for indent in (None, 2):
        assert json.loads(langstats.to_json(stats, indent).first().json) == {
            "languages": [], "totals": {"files": 0, "lines": 0}
        }
    assert langstats.to_json(stats).first().json == json.dumps(
        {"languages": [], "totals": {"files": 0, "lines": 0}}, indent=2
    )


def test_renderings(spark):
    files = corpus(spark, {"/r/a.py": "1\n2\n3\n", "/r/b.c": "1\n2\n3\n4", "/r/c.proto": "1"})
    stats = langstats.language_stats(files)
    value = {
        "languages": [
            {"language": "C", "files": 1, "lines": 4},
            {"language": "Python", "files": 1, "lines": 3},
            {"language": "Protocol Buffers", "files": 1, "lines": 0},
        ],
        "totals": {"files": 3, "lines": 7},
    }
    for indent in (2, 4):
        assert langstats.to_json(stats, indent).first().json == json.dumps(value, indent=indent)
    assert json.loads(langstats.to_json(stats, None).first().json) == value
    width = len("Protocol Buffers")
    assert [row.line for row in langstats.report(stats).collect()] == [
        *("%-*s  %8d files  %10d lines" % (width, r["language"], r["files"], r["lines"]) for r in value["languages"]),
        "-" * (width + 34),
        "%-*s  %8d files  %10d lines" % (width, "TOTAL", 3, 7),
    ]
    only_c = langstats.report(langstats.language_stats(files.where("path like '%.c'"))).collect()
    assert [row.line for row in only_c][-1] == "%-*s  %8d files  %10d lines" % (1, "TOTAL", 1, 4)
    envelope = langstats.stats_envelope(files, "/r/").first().asDict(recursive=True)
    assert envelope == {"root": "/r", **value}
    assert langstats.stats_envelope(files).first().root == "all"
    assert langstats.totals_line(langstats.totals(files)).first().line == "Totals: 3 files, 7 lines"


def test_text_never_crosses_the_shuffle(spark, tmp_path):
    corpus(spark, {"/r/a.py": "x"}).write.parquet(str(tmp_path / "content"))
    stats = langstats.language_stats(spark.read.parquet(str(tmp_path / "content")))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    shuffled = plan[: plan.index("Exchange hashpartitioning")].count("text")
    assert shuffled == 0 and "partial_count" in plan
