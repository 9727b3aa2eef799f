import os

import pytest
from naive import is_binary, walk
from test_search import rows_scanned
from pyspark.sql import functions as F

from codequarry import CodeIndex, TableSource
from codequarry.functions import text as text_fn
from codequarry.operators import diff, scope
from codequarry.plans.index import new_roots
from codequarry.sources import filetree, schemas
from codequarry.sources.scratch import Staging, scratch_dir


class Tree:
    """A directory of files with times under control."""

    def __init__(self, folder):
        self.root = str(folder)
        self.clock = 1_700_000_000

    def put(self, files):
        self.clock += 10
        for name, content in files.items():
            path = os.path.join(self.root, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as file:
                file.write(content if isinstance(content, bytes) else content.encode())
            os.utime(path, (self.clock, self.clock))

    def drop(self, name):
        os.unlink(os.path.join(self.root, name))


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "root").mkdir()
    return Tree(tmp_path / "root")


@pytest.fixture
def index(spark, tmp_path):
    return CodeIndex(spark, str(tmp_path / "index"))


def indexed(index, root):
    return {os.path.relpath(row.path, root) for row in index.files().collect()}


def counts(added=0, updated=0, removed=0, skipped=0, total=0):
    return {"added": added, "updated": updated, "removed": removed, "skipped": skipped, "total": total}


def test_life_of_an_index(spark, index, tree):
    tree.put({
        "greet.py": "def greet():\n    return 'hello'\n", "data.txt": "hello there\n", "bin": b"\0\1\2",
        "empty.py": "", ".hidden/_x.py": "x\n", "sub/.quarryignore": "*.log\n", "sub/a.log": "no\n",
        ".gitignore": "secret.txt\nbuild/\n", "secret.txt": "x", "build/x.py": "x",
    })
    assert index.index(tree.root) == counts(added=4, skipped=4, total=5)
    assert indexed(index, tree.root) == {"greet.py", "data.txt", "empty.py", ".hidden/_x.py"}
    hit = index.search("GREET", root=tree.root).first()
    assert (hit.path, hit.lineno, hit.text, hit.root) == (f"{tree.root}/greet.py", 1, "def greet():", tree.root)
    assert index.search("secret").count() == 0
    row = index.files().where("path like '%greet.py'").first()
    assert (row.size, row.mtime) == (32, float(tree.clock))
    import hashlib
    assert row.text_hash == hashlib.sha256(b"def greet():\n    return 'hello'\n").hexdigest()

    # Nothing changed; the binary file is tried again and still not stored.
    assert index.index(tree.root) == counts(skipped=4, total=5)
    assert index.files().where("path like '%greet.py'").first() == row

    # A changed file, a removed one, one now ignored, one that became binary
    # (its old text stays) and one that became text.
    tree.put({"data.txt": "y\n", ".gitignore": "greet.py\n", "empty.py": b"\0", "bin": "text now\n"})
    tree.drop(".hidden/_x.py")
    changes = counts(added=3, updated=1, removed=2, skipped=4, total=5)
    assert index.index(tree.root) == changes
    assert indexed(index, tree.root) == {"data.txt", "empty.py", "bin", "build/x.py", "secret.txt"}
    assert [row.text for row in index.search("y\n").collect()] == ["y"]
    assert index.search("hello").count() == 0
    assert index.files().where("path like '%empty.py'").first().size == 0
    assert index.summary(changes).first().line == "Indexed 5 files (+3, ~1, -2, skipped 4)"

    # The stale binary counts as a change again and stays again.
    assert index.index(tree.root) == counts(skipped=4, total=5)

    before = [sorted(map(tuple, table.collect())) for table in (index.files(), index.search("t", max_results=None))]
    index.compact()
    assert [sorted(map(tuple, t.collect())) for t in (index.files(), index.search("t", max_results=None))] == before
    assert [row.path for row in index.roots().collect()] == [tree.root]
    tree.drop("data.txt")
    assert index.index(tree.root)["removed"] == 1
    assert indexed(index, tree.root) == {"empty.py", "bin", "build/x.py", "secret.txt"}

    assert index.clear() == 4
    assert index.files().count() == index.roots().count() == index.search("t").count() == 0
    assert index.clear() == 0
    assert index.index(tree.root)["added"] == 3


def test_sibling_roots_in_one_index(index, tmp_path):
    for name in ("root", "root-app", "ROOT"):
        Tree(tmp_path / name).put({"a.py": "needle\n1\n2\n"})
    for name in ("root-app", "root", "ROOT"):
        assert index.index(str(tmp_path / name)) == counts(added=1, total=1)
    os.unlink(tmp_path / "root" / "a.py")
    assert index.index(f"{tmp_path}/root/") == counts(removed=1)
    assert indexed(index, str(tmp_path)) == {"root-app/a.py", "ROOT/a.py"}
    assert [row.path for row in index.roots().collect()] == [f"{tmp_path}/{n}" for n in ("ROOT", "root", "root-app")]
    assert index.totals(str(tmp_path / "ROOT")).first().asDict() == {"files": 1, "lines": 3}
    assert index.search("needle", root=str(tmp_path / "root")).count() == 0


def test_options(index, tree):
    tree.put({
        ".gitignore": "root-hidden.py\n", "root-hidden.py": "kept\n", "nested/.own": "nested-hidden.py\n",
        "nested/nested-hidden.py": "kept\n", "ok.py": "x" * 100, "db.sqlite": "x",
    })
    own = {"ignore_names": (".gitignore", ".own"), "reserved": ("db.sqlite",)}
    assert index.index(tree.root, no_ignore=True, extra_ignores=["ok.py"], **own) == counts(added=3, skipped=3, total=3)
    assert index.index(tree.root, extra_ignores=["ok.py"], **own) == counts(removed=3, skipped=6)
    assert index.index(tree.root, size_limit=99, no_ignore=True, **own) == counts(added=2, skipped=4, total=2)
    assert index.index(tree.root, size_limit=100, **own) == counts(added=1, removed=2, skipped=5, total=1)
    assert index.index(tree.root, size_limit=0, **own) == counts(removed=1, skipped=6)


def test_links(index, tree, tmp_path):
    tree.put({"a.py": "x\n", "d/b.py": "x\n"})
    Tree(tmp_path).put({"rules": "b.py\n"})
    os.symlink(f"{tree.root}/a.py", f"{tree.root}/link.py")
    os.symlink(f"{tree.root}/d", f"{tree.root}/e")
    os.symlink(f"{tmp_path}/gone", f"{tree.root}/broken")
    os.symlink(f"{tmp_path}/rules", f"{tree.root}/.gitignore")
    assert index.index(tree.root) == counts(added=1, skipped=1, total=1)
    assert indexed(index, tree.root) == {"a.py"}
    os.symlink(tree.root, f"{tmp_path}/other")
    assert index.index(f"{tmp_path}/other")["added"] == 1


def test_not_a_directory(index, tree):
    tree.put({"a.py": "x"})
    for path in (f"{tree.root}/a.py", f"{tree.root}/missing"):
        with pytest.raises(NotADirectoryError):
            index.index(path)
    assert index.roots().count() == 0


def file_table(spark, files, mtime=1.0):
    rows = [(path, len(content), mtime, content) for path, content in files.items()]
    return spark.createDataFrame(rows, "path string, size bigint, mtime double, content binary")


def test_file_table_with_nested_rules(spark, index):
    files = {
        "/r/.gitignore": b"*.log\n", "/r/a/.gitignore": b"x*\n", "/r/a/x.py": b"1", "/r/a/b/xx/y.py": b"2",
        "/r/a/keep.py": b"3", "/r/x.py": b"4", "/r/z.log": b"5", "/other/x.py": b"6",
    }
    table = file_table(spark, files)
    states = walk({path[3:]: content.decode() for path, content in files.items() if path.startswith("/r/")})
    kept = {path for path, state in states.items() if state == "kept" and not path.endswith("ignore")}
    assert index.index("/r", TableSource(table)) == counts(added=2, skipped=4, total=2)
    assert indexed(index, "/r") == kept == {"a/keep.py", "x.py"}
    # The same with the rule files given apart, and then without them.
    rule_files = table.where("path like '%ignore'").select("path", "content")
    assert index.index("/r", TableSource(table, rule_files)) == counts(skipped=4, total=2)
    none = TableSource(table, rule_files.limit(0))
    assert index.index("/r", none) == counts(added=3, skipped=2, total=5)


def test_time_tolerance_and_size(spark, index):
    index.index("/r", TableSource(file_table(spark, {"/r/a": b"x"}, 1.0)))
    for mtime, content, updated in [(1.0 + 9e-7, b"y", 0), (1.0 + 2e-6, b"y", 1), (1.0 + 2e-6, b"yy", 1)]:
        assert index.index("/r", TableSource(file_table(spark, {"/r/a": content}, mtime)))["updated"] == updated


def test_failed_run_leaves_no_trace(spark, index):
    index.index("/r", TableSource(file_table(spark, {"/r/a": b"x"})))
    broken = file_table(spark, {"/r/b": b"x"}).withColumn(
        "content", F.when(F.raise_error(F.lit("disk")).isNull(), F.col("content"))
    )
    with pytest.raises(Exception, match="disk"):
        index.index("/r", TableSource(broken, spark.createDataFrame([], "path string, content binary")))
    assert indexed(index, "/r") == {"a"}
    assert index.index("/r", TableSource(file_table(spark, {"/r/b": b"x"}))) == counts(added=1, removed=1, total=1)
    assert indexed(index, "/r") == {"b"}


def test_leftovers_of_a_failed_commit_do_not_matter(spark, index):
    for left in ("commits/_temporary/0", "content/gen=1", "files/gen=1/_temporary"):
        os.makedirs(f"{index.store.location}/{left}")
    assert index.files().count() == 0
    assert index.index("/r", TableSource(file_table(spark, {"/r/a": b"x"}))) == counts(added=1, total=1)
    assert indexed(index, "/r") == {"a"}


def test_two_writers_are_noticed(spark, index):
    index.index("/r", TableSource(file_table(spark, {"/r/a": b"x"})))
    with pytest.raises(ValueError, match="another run has written generation 1"):
        index.store.commit(1, {})
    assert indexed(index, "/r") == {"a"}


def test_reader_keeps_its_snapshot(spark, index):
    index.index("/r", TableSource(file_table(spark, {"/r/a": b"x"})))
    earlier = index.files()
    index.index("/r", TableSource(file_table(spark, {"/r/b": b"x"})))
    index.compact()
    index.clear()
    assert [row.path for row in earlier.collect()] == ["/r/a"]


def test_unchanged_content_is_not_read(index, tree):
    """Same size and time stand for the same content, whatever is in the file."""
    tree.put({"a.py": "old\n"})
    index.index(tree.root)
    tree.clock -= 10
    tree.put({"a.py": "new\n"})
    assert index.index(tree.root) == counts(total=1)
    assert [row.text for row in index.search("o").collect()] == ["old"]


def test_staging_uses_the_shared_folder_and_cleans_up(spark):
    with Staging(spark) as staging:
        assert staging.folder.startswith(scratch_dir(spark))
        table = staging.write(spark.range(3).withColumn("kind", F.lit("a")), "t", by="kind")
        assert staging.read_parts(table, "t", "kind", ["a", "b"]).count() == 3
        assert staging.read_parts(table, "t", "kind", ["b"]).count() == 0
        assert os.path.isdir(staging.folder)
    assert not os.path.exists(staging.folder)


def test_binary_and_decoding(spark):
    import random

    rng = random.Random(5)
    samples = [
        b"", b"hello\n", b"\0\1\2", b"\1" * 3 + b"a" * 7, b"\1" * 31 + b"a" * 69, b"\1" * 30 + b"a" * 70,
        b"a" * 8191 + b"\0", b"a" * 8192 + b"\0", b"\t\n\r" * 9, b"\x7f\x80\xff" * 4, b"\xff\xfe", b"\xef\xbb\xbfx",
        b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\r\n", b"\x1b[0m",
    ]
    for _ in range(1500):
        alphabet = rng.choice([range(256), range(9, 40), [1, 65, 66, 67], [0xE2, 0x82, 0xAC, 0x41, 0xF0, 0x9F, 0xC3]])
        samples.append(bytes(rng.choices(alphabet, k=rng.randrange(1, 30))))
    table = spark.createDataFrame(list(enumerate(samples)), "n int, content binary")
    rows = table.select(
        "n", text_fn.looks_binary(F.col("content")).alias("binary"), text_fn.decode_text(F.col("content")).alias("text"),
    ).collect()
    for row in rows:
        assert row.binary == is_binary(samples[row.n]), samples[row.n]
        assert row.text == samples[row.n].decode("utf-8", "replace"), samples[row.n]


def test_file_readers_agree(spark, tree):
    tree.put({f"d{i}/f{j}.txt": f"{i}\n" * j for i in range(3) for j in range(1, 4)})
    with Staging(spark) as staging:
        walked = filetree.read_content(filetree.list_tree(spark, tree.root, staging))
        rows = sorted(map(tuple, walked.collect()))
    assert walked.schema.simpleString() == filetree.binary_file_table(spark, tree.root).schema.simpleString()
    assert rows == sorted(map(tuple, filetree.binary_file_table(spark, tree.root).collect()))
    assert len(rows) == 9


def test_vanished_files_are_left_out(spark, tree):
    tree.put({"a": "x", "b": "y"})
    with Staging(spark) as staging:
        listing = filetree.list_tree(spark, tree.root, staging)
        tree.drop("a")
        assert [row.content for row in filetree.read_content(listing).collect()] == [b"y"]


def test_diff_and_roots(spark):
    old = spark.createDataFrame(
        [("/a", 1, 1.0, 1), ("/b", 1, 1.0, 1), ("/c", 1, 1.0, 2), ("/d", 1, 1.0, 2)],
        "path string, size bigint, mtime double, gen bigint",
    )
    seen = spark.createDataFrame(
        [("/a", 1, 1.0, False), ("/b", 2, 1.0, False), ("/c", 1, 1.0, True), ("/e", 1, 1.0, False), ("/f", 1, 1.0, True)],
        "path string, size bigint, mtime double, skipped boolean",
    )
    changes = diff.snapshot_diff(old, seen)
    assert {row.path: row.status for row in changes.collect()} == {
        "/a": "unchanged", "/b": "changed", "/c": "skipped_removed", "/d": "removed", "/e": "new", "/f": "skipped"
    }
    stored = changes.where("status in ('new', 'changed')")
    assert diff.counters(changes, stored).first().asDict() == counts(1, 1, 2, 2, 3)
    assert [row.path for row in diff.removed_paths(old, seen.where("not skipped")).orderBy("path").collect()] == ["/c", "/d"]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and "content" not in plan
    roots = schemas.local_table(spark, schemas.ROOTS, [("/a", "then")])
    given = schemas.local_table(spark, schemas.ROOTS, [("/a", "now"), ("/b", "now"), ("/b", "now")])
    assert [tuple(row) for row in new_roots(roots, given).collect()] == [("/b", "now")]


def test_filters(spark):
    files = spark.createDataFrame(
        [("/r/a", 0, False), ("/r/.gitignore", 5, False), ("/r/x/.quarryignore", 10, True), ("/r/b", 11, True)],
        "path string, size bigint, is_link boolean",
    )
    assert scope.within_size(files, 10).count() == 3
    assert scope.within_size(files, 0).count() == 1
    assert scope.without_links(files).count() == 2
    assert scope.without_reserved(files).count() == 2
    assert scope.without_reserved(files, reserved=("a",)).count() == 1


def test_index_inside_its_own_root(spark, tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    (root / "a.py").write_text("x\n")
    for location in (str(root / ".index"), f"file://{root}/.other"):
        inside = CodeIndex(spark, location)
        first = inside.index(str(root))
        again = [inside.index(str(root)) for _ in range(2)]
        assert again == [counts(total=again[0]["total"])] * 2
    assert first["added"] >= 1


def test_entries_that_cannot_be_read(tmp_path, monkeypatch):
    for name in "abcd":
        (tmp_path / name).write_text(name)
    real = os.scandir

    class Gone:
        def __init__(self, entry):
            self.entry, self.name, self.path = entry, entry.name, entry.path

        def is_symlink(self):
            return False

        def is_dir(self):
            return False

        def is_file(self):
            return True

        def stat(self, follow_symlinks=True):
            if self.name == "b":
                raise FileNotFoundError(self.path)
            if self.name == broken:
                raise OSError(5, "Input/output error")
            return self.entry.stat(follow_symlinks=follow_symlinks)

    class Scan:
        def __init__(self, folder):
            self.entries = sorted(real(folder), key=lambda e: e.name)

        def __enter__(self):
            return iter(map(Gone, self.entries))

        def __iter__(self):
            return iter(map(Gone, self.entries))

        def __exit__(self, *_):
            pass

    monkeypatch.setattr(os, "scandir", Scan)
    broken = None
    found = list(filetree._entries(str(tmp_path)))
    assert [(os.path.basename(p), size) for p, size, *_ in found] == [("a", 1), ("b", None), ("c", 1), ("d", 1)]
    broken = "c"
    with pytest.raises(OSError):
        list(filetree._entries(str(tmp_path)))
    monkeypatch.undo()
    assert not list(filetree._entries(str(tmp_path / "none")))
    with pytest.raises(FileNotFoundError):
        list(filetree._entries(str(tmp_path / "none"), required=True))


def words(rng, count):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(count))


def test_compacted_search_equals_search_of_everything_and_reads_less(spark, index):
    import random

    rng = random.Random(11)
    files = {f"/r/{i:04}.py": f"{words(rng, 60)}\r\n{words(rng, 300)}" for i in range(400)}
    files["/r/0200.py"] = "xyzzy ÄÖÜ straße\nnext line\tΑΣ Σα İx 日本語テキスト"
    files["/r/0201.py"] = "Xyzzy äöü"
    files |= {"/r/empty": "", "/r/zz": "ab", "/r/0399.py": "quux " * 5000}
    table = {path: text.encode() for path, text in files.items()}
    index.index("/r", TableSource(file_table(spark, table)))
    patterns = ["xyzzy", "ÄÖÜ", "straße\nNEXT", "line\t", "ΑΣ", "Σα", "i̇x", "日本", "ab", "quux quux", "\r\n", "no such text"]
    runs = [(p, case, None) for p in patterns for case in (False, True)] + [("abc", False, 7), ("XYZZY", False, 1)]
    answers = lambda: [
        sorted(map(tuple, index.search(p, max_results=n, case=case).collect())) for p, case, n in runs
    ]
    before = answers()
    assert sum(map(bool, before)) > 15
    index.compact(block_bytes=16 * 1024, row_group_bytes=64 * 1024)
    assert answers() == before
    rare, frequent = (index.search(p, max_results=None) for p in ("xyzzy", "abc"))
    assert rare.count() == len(rare.collect()) == 2 and rows_scanned(rare) <= 200
    assert frequent.collect() and rows_scanned(frequent) >= len(files) - 2
    # A later generation is searched whole, and hides what it replaces.
    table["/r/0200.py"], table["/r/new.py"] = b"changed", b"one\nxyzzy again"
    index.index("/r", TableSource(file_table(spark, table, mtime=1.0)))
    assert [row.path for row in index.search("xyzzy").collect()] == ["/r/0201.py", "/r/new.py"]
    index.clear()
    assert index.search("xyzzy").collect() == []


def test_grams_of_a_pattern_are_among_those_of_its_texts(spark):
    import random

    import numpy as np

    from codequarry.sources import grams

    rng = random.Random(2)
    letters = [*"aAbBiIkKzZ019 _-\n", "é", "É", "Σ", "σ", "İ", "ß", "K", "日", "𝒳", "ö"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(300)]
    lows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low")).collect()
    for text, low in zip(texts, lows):
        held = set(grams.numbers(np.frombuffer(low.low.encode(), np.uint8)).tolist())
        at = rng.randrange(len(text))
        part = text[at : at + rng.randrange(1, 12)]
        assert set(grams.pattern_grams(spark, part, True)) <= held, (text, part)
        if part.lower() in text.lower() and low.low.find(part.lower()) >= 0:
            assert set(grams.pattern_grams(spark, part, False)) <= held, (text, part)
    assert grams.pattern_grams(spark, "ab", False) == grams.pattern_grams(spark, "日a", True) == []
    assert len(grams.pattern_grams(spark, "abcde" * 99, False)) == 5


def test_statistics_read_no_text(spark, index):
    files = {"/r/a.py": b"1\n2\n3\n", "/r/b.py": b"1", "/r/empty.js": b"", "/r/c.c": b"1\r\n2\r\n3", "/r/bin": b"\0"}
    index.index("/r", TableSource(file_table(spark, files)))
    files["/r/b.py"] = b"1\n2\n3\n4"
    index.index("/r", TableSource(file_table(spark, files)))
    from codequarry.operators import langstats

    for _ in range(2):
        texts = index.store.snapshot().content().select("path", "text")
        for min_lines in (1, 3, 4):
            assert index.stats(min_lines=min_lines).collect() == langstats.language_stats(texts, min_lines=min_lines).collect()
            assert index.totals("/r", min_lines).collect() == langstats.totals(texts, "/r", min_lines).collect()
        for result in (index.stats("/r"), index.totals(), index.stats_envelope()):
            plan = result._jdf.queryExecution().executedPlan().toString()
            assert "n_lines" in plan and "text:string" not in plan and "content" not in plan
        index.compact()


def test_a_binary_is_read_no_further_than_the_sample(tmp_path, monkeypatch):
    import io

    import pyarrow as pa

    samples = {"bin": b"\0" + b"x" * 50_000, "late": b"a" * 8192 + b"\0" * 9000, "odd": b"\1" * 31 + b"a" * 69, "text": b"t" * 20_000, "empty": b""}
    for name, content in samples.items():
        (tmp_path / name).write_bytes(content)
    read = {}

    class Counted(io.FileIO):
        def read(self, size=-1):
            data = super().read(size)
            read[os.path.basename(self.name)] = read.get(os.path.basename(self.name), 0) + len(data)
            return data

        def readall(self):
            data = super().readall()
            read[os.path.basename(self.name)] += len(data)
            return data

    monkeypatch.setattr(filetree, "open", lambda path, mode, buffering: Counted(path, "rb"), raising=False)
    paths = pa.RecordBatch.from_pydict({"path": [str(tmp_path / name) for name in samples]})
    rows = [row for batch in filetree._read_files(iter([paths]), text_only=True) for row in batch.to_pylist()]
    kept = {os.path.basename(row["path"]): row["content"] for row in rows}
    assert kept == {name: content for name, content in samples.items() if not is_binary(content)}
    assert read == {"bin": 8192, "odd": 100, "late": 17192, "text": 20_000, "empty": 0}
    import random

    rng = random.Random(3)
    for _ in range(2000):
        sample = bytes(rng.choices(rng.choice([range(256), range(9, 40), [1, 65, 66, 67]]), k=rng.randrange(0, 40)))
        assert filetree._is_binary(sample) == is_binary(sample)


def test_a_deep_tree_takes_few_jobs(spark, tmp_path):
    deep = tmp_path
    for k in range(40):
        deep = deep / f"d{k}"
        deep.mkdir()
        (deep / "f.txt").write_text("x")
    for k in range(700):
        (tmp_path / "wide" / f"w{k}" / "x").mkdir(parents=True)
        (tmp_path / "wide" / f"w{k}" / "x" / "g").write_text("")
    expected = sorted(os.path.join(folder, name) for folder, _, names in os.walk(tmp_path) for name in names)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "tree")
    with Staging(spark) as staging:
        listing = filetree.list_tree(spark, str(tmp_path), staging)
        rounds = [name for name in os.listdir(f"{staging.folder}/tree") if name.startswith("round=")]
        assert sorted(row.path for row in listing.collect()) == expected
    assert len(tracker.getJobIdsForGroup("deep")) <= 20 and len(rounds) <= 4
    spark.sparkContext.setJobGroup("", "")


def test_join_of_colocated_tables_needs_no_exchange(spark, tmp_path):
    from codequarry.sources import colocated

    files = spark.range(300).selectExpr("concat('/r/', id) as path", "id as size")
    content = spark.range(100, 500).selectExpr("concat('/r/', id) as path", "repeat('x', id % 7) as text")
    left, right = (colocated.write(rows, str(tmp_path), 6) for rows in (files, content))
    joined = colocated.joined(left, right)
    assert joined.columns == ["path", "size", "text"]
    assert sorted(map(tuple, joined.collect())) == sorted((f"/r/{k}", k, "x" * (k % 7)) for k in range(100, 300))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert colocated.buckets_for(10**12, 8) == 7451 and colocated.buckets_for(0, 8) == 8
