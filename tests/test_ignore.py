import random

import pytest
from naive import walk

from codequarry.operators import ignore


def flags(spark, files, extra=(), names=(".gitignore", ".quarryignore"), root="/r"):
    prefix = root.rstrip("/") + "/"
    table = spark.createDataFrame([(prefix + path, text.encode()) for path, text in files.items()], "path string, content binary")
    sets = ignore.rule_sets(table, root, names)
    rules = ignore.root_rules(spark, ignore.root_texts(sets, extra))
    nested = sets.where("base <> ''")
    deeper = None
    if not nested.isEmpty():
        deeper = ignore.directory_rules(table, root, rules, ignore.rule_chains(nested))
    result = ignore.with_ignore_flags(table.select("path"), root, rules, deeper)
    return {
        row.path[len(prefix):]: "pruned" if row.pruned else "ignored" if row.ignored else "kept"
        for row in result.collect()
    }


CASES = [
    ("# hi\n\n", "a.py", "kept"),
    ("*.py\n", "src/a.py", "ignored"),
    ("*.py\n", "src/a.txt", "kept"),
    ("build/\n", "build/x.py", "pruned"),
    ("build\n", "build/x.py", "pruned"),
    ("build/\n", "build", "kept"),
    ("/src\n", "src/a.py", "pruned"),
    ("/src\n", "other/src/a.py", "kept"),
    ("*.py\n!keep.py\n", "keep.py", "kept"),
    ("*.py\n!keep.py\n", "other.py", "ignored"),
    ("**/test/**\n", "a/b/test/c.py", "pruned"),
    ("foo/**/bar\n", "foo/x/bar", "ignored"),
    ("src/generated/\n", "src/generated/x/y", "pruned"),
    ("file[0-9].txt\n", "file5.txt", "kept"),
    ("!build\nbuild/\n", "build/x", "ignored"),
    ("build/\n!build/x\n", "build/x", "pruned"),
    ("**/foo\n", "barfoo", "ignored"),
    ("a.py # note\n", "a.py", "kept"),
    ("\\*.py\n", "x.py", "kept"),
    ("\\*.py\n", "*.py", "ignored"),
    ("a\\\n", "a\\", "ignored"),
    ("! # x\n", "# x", "kept"),
    ("#x\n", "#x", "kept"),
    ("\\#x\n", "#x", "ignored"),
    ("/\n!\n!/\n", "x", "kept"),
    ("x\u2028y\n", "y", "ignored"),
    ("\u3000x\u00a0\n", "x", "ignored"),
    ("a.b\n", "axb", "kept"),
    ("a+b(c)|d^e$f{g}\n", "a+b(c)|d^e$f{g}", "ignored"),
    ("*\n", "x/y", "pruned"),
    ("*/\n", "x/y", "pruned"),
    ("*/\n", "x", "kept"),
    ("?\n", "x\ny", "kept"),
    ("x\n", "x\n", "ignored"),
    ("x**\n", "x\ny/z", "kept"),
    ("x\n", "x\n/z", "pruned"),
    ("é*\n", "éa/b", "pruned"),
    ("𝒳?\n", "𝒳𝒳", "ignored"),
]


def test_single_rules(spark):
    """Each case is a tree of its own, below one common folder."""
    for text, path, expected in CASES:
        assert walk({".gitignore": text, path: ""})[path] == expected, (text, path)
    texts = {f"t{i}/.gitignore": text for i, (text, _, _) in enumerate(CASES)}
    files = {f"t{i}/{path}": "" for i, (_, path, _) in enumerate(CASES)}
    got = flags(spark, {**texts, **files})
    assert got == walk({**texts, **files})
    # Rules of the root take the other way through the code; a few cases suffice.
    for text, path, expected in CASES[3:9] + CASES[14:16] + CASES[-6:]:
        assert flags(spark, {".gitignore": text, path: ""})[path] == expected, (text, path)


def test_precedence_between_sets(spark):
    assert flags(spark, {".gitignore": "*.log", "sub/.gitignore": "!a.log", "sub/a.log": ""})["sub/a.log"] == "ignored"
    assert flags(spark, {".gitignore": "!*.log", "sub/.gitignore": "a.log", "sub/a.log": ""})["sub/a.log"] == "kept"
    assert flags(spark, {".gitignore": "!a", "a": ""}, ["a"])["a"] == "kept"
    assert flags(spark, {".quarryignore": "!a", "a": ""}, ["a"])["a"] == "ignored"
    assert flags(spark, {".gitignore": "!a", ".quarryignore": "a", "a": ""})["a"] == "kept"
    assert flags(spark, {"sub/.gitignore": "sub", "sub/x": "", "x": ""})["sub/x"] == "ignored"
    assert flags(spark, {"sub/.own": "x", "sub/x": ""}, names=(".gitignore", ".own"))["sub/x"] == "ignored"


def test_extra_patterns(spark):
    files = {"a.py": "", "b.py": "", "c/b.py": ""}
    assert flags(spark, files, ["/b.py", "c/\n!a.py"]) == walk(files, ["/b.py", "c/\n!a.py"])


def test_documented_tree(spark):
    files = {
        ".quarryignore": "vendor/\n*.log\n/root-only.py\n", "vendor/big.py": "", "debug.log": "",
        "root-only.py": "", "nested/root-only.py": "", "ok.py": "",
    }
    kept = {path for path, state in flags(spark, files).items() if state == "kept"}
    assert kept == {".quarryignore", "nested/root-only.py", "ok.py"}


def test_root_at_the_top(spark):
    assert flags(spark, {"a/.gitignore": "x", "a/x": "", "x": ""}, root="/")["a/x"] == "ignored"


@pytest.mark.parametrize("seed", range(6))
def test_random_trees_against_a_walk(spark, seed):
    """Many small trees side by side, each in a directory that rules cannot name."""
    rng = random.Random(seed)
    names = ["a", "b", "ab", "build", "x.py", "y.py", "z.log"]
    globs = ["a", "b/", "/a", "*.py", "a/b", "**/b", "a/**", "build/", "?", "a*", "*", "/build/x.py", "b/*.log", "ab/", "x.py"]

    def rules():
        return "\n".join(rng.choice(["", "", "!", "/"]) + rng.choice(globs) for _ in range(rng.randrange(1, 4)))

    files = {}
    for tree in range(60):
        for _ in range(rng.randrange(3, 12)):
            path = "/".join(rng.choices(names, k=rng.randrange(1, 5)))
            files[f"T{tree}/{path}"] = ""
        for path in [p for p in files if p.startswith(f"T{tree}/")]:
            if rng.random() < 0.3:
                directory = path.rpartition("/")[0]
                files[f"{directory}/{rng.choice(['.gitignore', '.quarryignore'])}"] = rules()
    if rng.random() < 0.7:
        files[".gitignore"] = rules()
    if rng.random() < 0.5:
        files[".quarryignore"] = rules()
    extra = [rules() for _ in range(rng.randrange(3))]
    # A name that is both a file and a directory cannot occur in a tree.
    directories = {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)}
    files = {path: text for path, text in files.items() if path not in directories}
    assert flags(spark, files, extra) == walk(files, extra)
    root_only = {path: text for path, text in files.items() if "/" not in path or not text}
    assert flags(spark, root_only, extra) == walk(root_only, extra)


def test_thousands_of_root_rules(spark):
    """Names, suffixes, prefixes and globs by the hundred, with some changes of sign."""
    kinds = ["name{}/", "*.e{}", "pre{}*", "a?{}", "/top{}", "x{}/**"]
    lines = []
    for k in range(2000):
        lines.append(("!" if k % 100 == 99 else "") + kinds[k % 6].format(k))
    files = {".gitignore": "\n".join(lines)}
    expected = {}
    for k in (0, 1, 2, 3, 4, 199, 1999, 1996):
        for path in (f"name{k}/f", f"d/f.e{k}", f"d/pre{k}x", f"ab{k}", f"top{k}", f"d/top{k}", f"plain{k}/f"):
            files[path] = ""
            rule = {"name": 0, "f.e": 1, "pre": 2, "ab": 3, "top": 4}
            part = path.removeprefix("d/") if not path.startswith("d/top") else path
            kind = next((v for word, v in rule.items() if part.startswith(word)), None)
            hit = kind is not None and k % 6 == kind and k % 100 != 99
            expected[path] = ("pruned" if kind == 0 else "ignored") if hit else "kept"
    found = flags(spark, files)
    assert {path: found[path] for path in expected} == expected
