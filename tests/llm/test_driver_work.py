"""What operators ask of the driver on small tables: every job, exchange and plan takes some of its memory."""

import random

from codequarry.llm import graph, neardup, quality
from codequarry.llm.shared import shared_folder

DOCS = "doc_id bigint, text string"


def jobs(spark, name, work):
    """The result of ``work()`` and the number of jobs that it ran."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_letters_are_counted_once_for_all_orders(spark):
    draw = random.Random(3)
    texts = spark.createDataFrame([("".join(draw.choices("abcd e.", k=50)),) for _ in range(30)], "text string")
    terms, n = jobs(spark, "letters", lambda: quality.train(quality.ngram_counts(texts)).toArrow())
    assert 0 < n < 20  # 41 when each order made those above anew
    assert sorted(set(terms["order"].to_pylist())) == [-4, -3, -2, -1, 1, 2, 3, 4]


def test_no_links_leave_labels_as_they_are(spark):
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "node bigint, label bigint")
    none, loops = (spark.createDataFrame(rows, "a bigint, b bigint") for rows in ([], [(3, 2), (1, 1)]))
    folder = shared_folder(spark)
    assert graph.merged(labels, none, folder, "none") is labels
    assert graph.merged(labels, loops, folder, "loops") is labels
    assert not graph.components(none).collect() and not graph.components(loops.where("a = b")).collect()
    assert graph.components(none).columns == ["node", "label"]
    some = spark.createDataFrame([(1, 3)], "a bigint, b bigint")
    assert sorted(map(tuple, graph.merged(labels, some, folder, "some").collect())) == [(1, 1), (2, 1), (3, 1)]


def test_settled_buckets_end_the_search(spark, monkeypatch):
    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    texts += [f"{texts[0]} end", None, "", "one two"]
    names, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda frame, folder=None, name="table": names.append(name) or write(frame, folder, name))
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    expected = [(k, {20: 0, 22: 21}.get(k, k)) for k in range(len(texts))]
    assert sorted(map(tuple, found)) == expected
    assert "sets" in names and not {"more-sets", "prefixes", "promising"} & set(names)
