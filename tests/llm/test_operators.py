"""The ten operators and the pipeline against slow plain versions, on rows made to be awkward."""

import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codequarry.llm import (
    decontaminate, fingerprints, html, kernels, mixture, neardup, pii, quality, records, repeats, substrings, suffixes,
)
from codequarry.llm.graph import components
from codequarry.llm.queries import ORACLES, QUERIES, tokenizer_path
from codequarry.llm.shared import shared_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, epoch string"


def awkward(seed=1):
    """Nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["the", "of", "ände", "été", "Zoë", "über", "x,", "end."] + [f"w{k}" for k in range(400)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(300)
    texts = [None, "", " \n\t ", "one", "one two three four", "one  two\nthree four five", "Ωmega ß 日本語   x", " ".join(words(6000))]
    texts += [" ".join(base)] * 3 + [" ".join(base).upper(), "".join(f"{w}\n" for w in base)]
    for _ in range(6):
        near = list(base)
        near[draw.randrange(300)] = "edited"
        texts.append(" ".join(near))
    for _ in range(6):
        texts.append(" ".join(words(draw.randrange(5, 80)) + passage + words(draw.randrange(5, 80))))
    texts += ["again " * 200, "ab" * 400, "same same " * 60, " ".join(passage[:20]), " ".join(passage[5:24])]
    return list(enumerate(texts))


def frame(spark, docs):
    langs, sources = ["en", "de", None], ["big", "big", "small", None]
    return spark.createDataFrame(
        [(i, t, langs[k % 3], sources[k % 4], None, 1.0, "x") for k, (i, t) in enumerate(docs)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return awkward()


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(result):
    return sorted(tuple(r) for r in result.collect())


# 1
def test_near_duplicates(table, docs):
    assert rows(neardup.near_duplicates(table)) == sorted(brute.classes(docs))


def test_near_duplicates_of_repeated_rows_and_none(spark, docs, empty):
    twice = frame(spark, docs[:14] + docs[:14] + [(None, "one")])
    found = neardup.deduplicated(twice)
    assert found.columns == twice.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted({c for _, c in brute.classes(docs[:14])})
    assert not neardup.near_duplicates(empty).collect()
    assert not neardup.deduplicated(empty).collect()


@pytest.mark.parametrize("block", [9_000, neardup.BLOCK])
def test_links_to_one_member_of_a_large_bucket(spark, monkeypatch, block):
    """Variants are like the text they stem from, few are like another variant."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for k in range(90):
        variant = list(base)
        for start in range(5, 390, 57):
            variant[start + draw.randrange(45)] = f"edit{k}-{start}"
        texts.append(" ".join(variant))
    made = list(enumerate(texts))
    assert rows(neardup.near_duplicates(frame(spark, made))) == sorted(brute.classes(made)) == [(k, 0) for k in range(91)]
    apart = [(k, t) for k, t in made if k % 10]
    assert rows(neardup.near_duplicates(frame(spark, apart))) == sorted(brute.classes(apart))


def test_prefix_buckets_of_two_members_are_open(spark):
    """Nobody paired the members of a prefix bucket, unlike those of a band."""
    met = spark.createDataFrame([(1, 10, 10), (1, 11, 11), (2, 10, 10), (2, 12, 10)], "bucket bigint, key bigint, label bigint")
    assert sorted(r.key for r in neardup._open_members(met, paired=1).collect()) == [10, 11]
    assert not neardup._open_members(met, paired=3).collect()


def test_neighbours_are_paired_across_components_only(spark):
    """400 texts that share nine tenths of their words meet in most bands; few drawn members pair all of them."""
    draw = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(400):
        variant = list(base)
        for start in range(0, 300, 100):
            variant[start + draw.randrange(100)] = f"edit{k}-{start}"
        texts.append((k, " ".join(variant)))
    nodes = neardup._sketches(frame(spark, texts).select(F.col("doc_id").alias("id"), "text")).select("key", "id", "bands", "bytes").persist()
    assert neardup._candidates(nodes).count() < 12 * 400
    met = nodes.select(F.explode("bands").alias("bucket"), "key", F.lit(1).alias("label"))
    assert not neardup._beside(met).count()
    odd = met.agg(F.min("key").alias("k")).first().k
    two = met.withColumn("label", F.when(F.col("key") == odd, 2).otherwise(1))
    found = neardup._beside(two).collect()
    assert 0 < len(found) <= 2 * 24 and all(odd in (r.a, r.b) and r.a > r.b for r in found)


def test_half_alike_texts_give_no_candidates(spark):
    """600 texts that share three quarters of their words meet in many bands, but in no prefix."""
    draw = random.Random(5)
    passage = " ".join(f"common{k}" for k in range(150))
    texts = [(k, passage + " " + " ".join(f"own{draw.randrange(1 << 30)}" for _ in range(50))) for k in range(600)]
    rows_ = frame(spark, texts).select(F.col("doc_id").alias("id"), "text")
    nodes = neardup._sketches(rows_).select("key", "id", "bands", "bytes").persist()
    labels = nodes.select(F.col("key").alias("node"), F.col("key").alias("label"))
    folder = shared_folder(spark)
    assert not neardup._rest(nodes, labels, rows_, 0.8, folder).count()
    assert spark.read.parquet(f"{folder}/open").count() > 590
    assert spark.read.parquet(f"{folder}/open-prefixes").count() <= 600
    assert rows(neardup.near_duplicates(frame(spark, texts))) == [(k, k) for k in range(600)]


def test_like_multisets_share_a_prefix_shingle():
    """Whatever the frequencies, which only order the shingles."""
    draw = np.random.default_rng(9)
    linked = 0
    for _ in range(3000):
        size = draw.integers(1, 60)
        universe = draw.choice(1 << 20, size, replace=False).astype(np.uint32)
        sides = []
        for _ in range(2):
            mine = np.sort(universe[draw.random(size) < draw.choice([0.9, 0.95, 1.0])])
            sides.append((mine, draw.choice([1, 1, 1, 2, 9], len(mine)).astype(np.uint32)))
        if neardup.similarity(*sides) < 0.8:
            continue
        linked += 1
        frequencies = draw.integers(2, draw.choice([3, 50]), neardup.CELLS)
        assert np.intersect1d(*(neardup.prefix(*side, frequencies, 0.8) for side in sides)).size
    assert linked > 500


def test_links_of_a_block_join_what_all_links_join():
    draw = np.random.default_rng(4)
    for _ in range(150):
        universe = draw.choice(1 << 20, 30, replace=False).astype(np.uint32)
        sets = []
        for _ in range(draw.integers(2, 14)):
            mine = np.sort(universe[draw.random(30) < 0.93])
            sets.append((mine, draw.choice([1, 1, 1, 1, 7], len(mine)).astype(np.uint32)))
        labels = draw.integers(0, 8, len(sets))
        both = np.concatenate((np.arange(len(sets)), np.flatnonzero(labels != labels[0])))
        odd = np.arange(len(both)) >= len(sets)
        links = [(int(both[a]), int(both[b])) for a, b in neardup.joining([sets[k] for k in both], odd, labels[both], 0.8)]
        assert len(links) < len(set(labels)) or not links
        assert all(neardup.similarity(sets[a], sets[b]) >= 0.8 for a, b in links)

        def joined(pairs):
            of = list(labels)
            for a, b in pairs:
                of = [of[a] if x == of[b] else x for x in of]
            return {(a, b) for a in range(len(of)) for b in range(len(of)) if of[a] == of[b]}

        every = [(a, b) for a in range(len(sets)) for b in range(a) if labels[a] != labels[b] and neardup.similarity(sets[a], sets[b]) >= 0.8]
        assert joined(links) == joined(every)


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(3)
    hashes = kernels.mix(np.arange(1, 401, dtype=np.uint64))
    x, y = draw.integers(1, 9, 300), draw.integers(1, 9, 300)
    a, b = (hashes[:300], x), (hashes[100:], y)
    signature = neardup.signatures(
        np.repeat([0, 1], 300), np.concatenate((a[0], b[0])), np.concatenate((x, y)), 2, m=4096)
    wa, wb = np.zeros(400), np.zeros(400)
    wa[:300], wb[100:] = x, y
    both = np.arange(100, 300)
    expected = sum(1 / np.maximum(wa / wa[d], wb / wb[d]).sum() for d in both)
    assert abs((signature[0] == signature[1]).mean() - expected) < 0.03
    plain = 200 / 400
    assert neardup.similarity(a, b) == pytest.approx(max(plain, expected))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 90)], "a bigint, b bigint")
    assert rows(components(links)) == sorted([(k, 0) for k in range(41)] + [(90, 90), (100, 90)])


def test_components_broadcast_nothing(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert components(spark.createDataFrame([(k, k + 1) for k in range(9)], "a bigint, b bigint")).count() == 10
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsCount())]
    assert any("SortMergeJoin" in plan for plan in plans) and not any("BroadcastHashJoin" in plan for plan in plans)


# 2
def test_classifier_tells_noise_from_text(spark):
    draw = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "brst" for b in "aeiou" for c in ("n", "ma", "lo", "ter")]
    clean = lambda: " ".join(draw.choice(vocabulary) for _ in range(80))
    noise = lambda: " ".join(draw.choice(vocabulary).upper() + "$%&" for _ in range(80))
    texts = [clean() for _ in range(300)] + [noise() for _ in range(60)] + [None, "", "ban"]
    table = spark.createDataFrame([(k, t, "en" if k % 2 else None, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, score string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(k, 0, 0) for k in range(300, 330)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.Classifier(table, labels)
    kept = {r.doc_id for r in model.kept(table).collect()}
    assert kept == {*range(300), 360, 361, 362}
    assert model.kept(table).columns == table.columns
    # The same documents in another table are scored anew; clashing names of columns do no harm.
    other = table.withColumns({"key": F.lit(1), "good_key": F.lit(2), "language": F.lit("x"), "_good": F.lit(3), "_of": F.lit(4)})
    again = model.kept(other)
    assert again.columns == other.columns and {r.doc_id for r in again.collect()} == kept
    assert {r.doc_id for r in model.results().where("kept").collect()} == kept
    untrained = quality.Classifier(table, labels.limit(0))
    assert untrained.kept(table).count() == len(texts)
    assert not quality.Classifier(table.limit(0), labels).results().collect()


def test_classifier_scores_words_and_tells_toxic_ones(spark):
    """Words of usual letters that trusted text lacks, words of toxic documents, and one usual word over and over."""
    draw = random.Random(6)
    made = [f"{a}{b}{c}" for a in "brst" for b in "aeiou" for c in ("n", "ma", "lo", "ter", "ri")]
    insults, vocabulary = made[::50], [w for k, w in enumerate(made) if k % 50]
    clean = lambda: [draw.choice(vocabulary) for _ in range(80)]
    texts = [" ".join(clean()) for _ in range(300)] + [" ".join([*clean(), insults[k % 2], *clean()]) for k in range(120)]
    texts += [" ".join(insults[k % 2] for k in range(80)), " ".join([vocabulary[3]] * 80)]
    table = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(k, 1, 1) for k in range(300, 380)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality.Classifier(table, labels).results().collect()}
    assert sum(found[k].kept for k in range(200, 300)) >= 95
    assert sum(found[k].kept for k in range(380, 422)) == 0
    assert found[420].perplexity > found[0].perplexity


def test_model_is_a_distribution(spark):
    texts = spark.createDataFrame([("the cat sat on the mat",), ("the dog",), (None,)], "text string")
    terms = quality.train(quality.ngram_counts(texts)).toPandas()
    losses = quality.loss_table(*(terms[c].to_numpy() for c in ("order", "key", "term")))
    assert np.allclose(np.exp(-losses.reshape(-1, 64)).sum(axis=1), 1, atol=1e-4)


# 3
def test_fingerprints(table, docs):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(table).collect()}
    order = sorted(docs, reverse=True)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        row = found[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), brute.hexed(edited))
        own, other, after = map(brute.shingles, (text, edited, following))
        assert abs(row.near_edited - brute.jaccard(own, other)) < 0.2
        assert abs(row.near_next - brute.jaccard(own, after)) < 0.2
        assert row.distinct_shingles == pytest.approx(len(own), rel=0.35)


def test_fingerprints_of_equal_and_no_rows(spark, empty):
    twice = frame(spark, [(3, "a b c d e f")] * 3 + [(None, None)])
    found = fingerprints.edited_fingerprints(twice).collect()
    assert len(found) == 4 and len({r.fingerprint for r in found if r.n_chars}) == 1
    assert not fingerprints.edited_fingerprints(empty).collect()


def test_sketches_merge(spark):
    text = " ".join(f"w{k}" for k in range(900))
    parts = spark.createDataFrame([(text, text + " tail")], "a string, b string")
    a, b = fingerprints.shingles(F.col("a")), fingerprints.shingles(F.col("b"))
    row = parts.select(
        fingerprints.merged(fingerprints.sketch(a), fingerprints.sketch(b)).alias("merged"),
        fingerprints.sketch(F.concat(a, b)).alias("whole")).first()
    assert row.merged == row.whole


# 4 and 8
def expected_words(docs):
    found = brute.without_repeats(docs, 20, lambda t: t.encode().split(), lambda kept: b" ".join(kept))
    return sorted((i, n, gone, brute.hexed(kept)) for i, n, gone, kept, _ in found)


def expected_bytes(docs):
    found = brute.without_repeats(docs, 100, lambda t: t.encode(), bytes)
    return sorted((i, n, gone, runs, brute.hexed(kept)) for i, n, gone, kept, runs in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    docs = awkward(seed)
    assert rows(substrings.digests(frame(spark, docs))) == expected_words(docs)
    assert rows(suffixes.digests(frame(spark, docs))) == expected_bytes(docs)


def test_repeats_without_rows_and_with_equal_ids(spark, empty):
    assert not substrings.digests(empty).collect() and not suffixes.digests(empty).collect()
    body = " ".join(f"w{k}" for k in range(60))
    found = substrings.digests(frame(spark, [(1, body), (1, f"{body} more"), (None, body)])).collect()
    assert sorted(r.n_removed for r in found) == [0, 60, 60]
    assert len(substrings.digests(frame(spark, [(1, body)] * 2)).collect()) == 2


def test_crowded_anchors_go_through_a_shuffle(spark, docs):
    def always(dealt, groups):
        return suffixes.refine(dealt, groups, scheme, block_rows=1)

    scheme = repeats.Scheme(100, 32, suffixes.byte_codes)
    documents = repeats.identified(frame(spark, docs), "doc_id", "text")
    spans = repeats.repeated_spans(documents, scheme, always).collect()
    removed = {r.id: int(repeats.covered(r.spans, 100, len((r.text or "").encode())).sum()) for r in spans}
    assert removed == {i: gone for i, _, gone, _, _ in expected_bytes(docs)}


def test_buckets_are_in_suffix_order():
    data = np.frombuffer(b"mississippi-mississippi", np.uint8)
    found = suffixes.buckets(data, 11)
    strings = [data[k : k + 11].tobytes() for k in range(len(found))]
    assert [sorted(set(strings)).index(s) for s in strings] == found.tolist()


def test_buckets_of_periodic_and_random_bytes():
    draw = np.random.default_rng(4)
    for turn in range(300):
        size, length = int(draw.integers(30, 150)), int(draw.integers(1, 30))
        data = draw.integers(0, int(draw.integers(1, 4)), size).astype(np.uint8)
        if turn % 3 == 0:
            data = np.tile(data[: int(draw.integers(1, 9))], 20)[: max(size // 4, 1)]
        data[draw.integers(0, len(data))] = 255
        if len(data) < length:
            continue
        places = np.flatnonzero(draw.integers(0, 2, len(data) - length + 1))
        found = suffixes.buckets(data, length, int(draw.integers(1, 8)), places, portion=int(draw.integers(1, 20)))
        strings = [data[k : k + length].tobytes() for k in places]
        assert [sorted(set(strings)).index(s) for s in strings] == found.tolist()


def test_pointers_are_refined_bucket_by_bucket():
    """Only buckets of several members are sorted, and each suffix points to the place where its bucket begins."""
    data = np.frombuffer(b"abcabcabx" * 30 + b"abcabcaby", np.uint8)
    order, pointer = suffixes.suffix_order(data, 40, first=3, portion=4)
    strings = [data[k : k + 40].tobytes() for k in order]
    assert strings == sorted(strings)
    for place, k in enumerate(order):
        assert pointer[k] <= place and strings[pointer[k]] == strings[place]


def test_streamed_groups_in_tiny_batches(spark):
    draw = random.Random(2)
    items = [(draw.randrange(4), draw.randrange(3), draw.randrange(50), 0, k, False) for k in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        table = spark.createDataFrame(items, "k bigint, c bigint, id bigint, tie bigint, pos bigint, settled boolean")
        found = rows(repeats.first_of_equals(table, keep_open=True).select("id", "tie", "pos", "open"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    firsts = {}
    for k, c, *row, _ in sorted(items):
        firsts.setdefault((k, c), tuple(row))
    several = {k for k, _ in firsts if sum(a == k for a, _ in firsts) > 1}
    expected = [(*row, False) for k, c, *row, _ in items if firsts[k, c] != tuple(row)]
    expected += [(*row, True) for (k, _), row in firsts.items() if k in several]
    assert found == sorted(expected)


# 5
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href=x>Home</a><li>About</ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div>
<article class=post><h1>Title &amp; more</h1><p>First <b>bold<p>Second&nbsp;line<br>goes   on &lt;here&gt;
<div class="box">Read our magazine</div><aside>Side</aside><form>Name <input></form><ul><li>one<li>two</ul>
<section id="comments"><article><p>A reader says</p></article></section><!-- <p>no</p> --></article><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nFirst bold\nSecond line goes on <here>\none\ntwo"


def test_extraction_deletes_what_a_site_repeats(spark):
    numbered = lambda text, k: text.replace("First", f"First {k}").replace("one", f"one {k}")
    unique = [numbered(PAGE, k) for k in range(8)]
    pages = [(k, f"http://A.example/{k}", page) for k, page in enumerate(unique)]
    pages += [(20, "http://b.example/", PAGE), (21, None, PAGE), (22, "not a url", ""), (23, "http://b.example/", None), (None, "http://b.example/", "plain &amp; text")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {(r.page_id, r.n_chars): r.text for r in html.main_texts(table).collect()}
    texts = {k: t for (k, _), t in found.items()}
    whole = TEXT.replace("on <here>", "on <here>\nRead our magazine")
    assert [texts[k] for k in range(8)] == [numbered(TEXT, k) for k in range(8)]
    assert texts[20] == texts[21] == whole
    assert texts[22] == texts[23] == "" and texts[None] == "plain & text"
    assert all(n == len(t) for (_, n), t in found.items())
    assert not html.main_texts(table.limit(0)).collect()


def test_copies_of_one_article_are_no_template(spark):
    page = "<body><article><div class=part><p>Same text here.</p></div></article></body>"
    table = spark.createDataFrame([(k, "http://c.example/", page) for k in range(30)], "page_id bigint, url string, html string")
    assert {r.text for r in html.main_texts(table).collect()} == {"Same text here."}


def test_deep_and_broken_pages():
    assert html.extract("<div>" * 3000 + "deep" + "</p>" * 10, set()) == "deep"
    assert html.extract("<main><p>a<p>b</main><p>c", set()) == "a\nb"


def test_sites_without_telling_elements(spark):
    """The longest box of each page is the same on all, and the article lies in two boxes."""
    legal = "<div class=c9><p>" + "All rights are reserved by the owners of this site. " * 9 + "</p></div>"
    links = "<div class=c1><a href=/>Home</a> <a href=/x>More</a></div>"
    page = "<body>{1}<div class=c2><div class=c3><p>Article {0} begins here.</p></div><div class=c3><p>It goes on, {0}.</p></div></div>{2}</body>"
    pages = [(k, "http://d.example/", page.format(k, links, legal)) for k in range(8)]
    pages += [(k, "http://e.example/", page.format(1, links, legal)) for k in range(20, 28)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in html.main_texts(table).collect()}
    assert [found[k] for k in range(8)] == [f"Article {k} begins here.\nIt goes on, {k}." for k in range(8)]
    assert all("Article 1 begins here." in found[k] for k in range(20, 28))


# 6
def test_base_spans():
    cases = {
        "a.b+c@d-e.f.g x@y @z.w": [(0, 0, 13)],
        "1.2.3.4.5 256.1.1.1 0255.0.0.1": [(0, 1, 7), (20, 1, 30)],
        "4111 1111-1111 1111, 4111111111111112": [(0, 2, 19)],
        "+1 (017) 555-7713. +12 3": [(0, 3, 17)],
        "é 1.2.3.4": [(2, 1, 9)], "": [], "a" * 100_000 + "@": [], "1" * 100_000: [],
    }
    for text, spans in cases.items():
        assert pii.base_spans(text) == spans, text[:40]


def test_crf_learns_shapes_and_keeps_the_base(spark):
    draw = random.Random(4)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    texts = []
    for k in range(120):
        texts.append(f"call +{number(1)} ({number(3)}) {number(3)}-{number(4)} or mail bob.{k}@mail{k % 9}.example.com in {number(4)}")
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None, "", "no cue"])], "doc_id bigint, text string, pii int")
    model = pii.train(pii.labelled_table(table, sample_docs=60))
    held = texts[60:]
    right = sum(set(pii.base_spans(t)) <= set(s) for t, s in zip(held, model.spans(held), strict=True))
    assert right / len(held) > 0.95
    for row in pii.personal_data(table).collect():
        text = texts[row.doc_id] if row.doc_id < 120 else ""
        base = pii.as_text(pii.base_spans(text))
        assert row.base_sha256 == brute.hexed(base)
        assert set(filter(None, base.split(","))) <= set(filter(None, row.spans.split(",")))
    assert not pii.personal_data(table.limit(0)).collect()


def test_crf_adds_spans_that_miss_a_pattern(spark):
    draw = random.Random(9)
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    phone = lambda: f"{number(1)} ({number(3)}) {number(3)}-{number(4)}"
    texts = [f"call +{phone()} or mail bob{k}@mail{k % 9}.example.com in {number(4)}" for k in range(100)]
    texts += [f"host {draw.randrange(256)}.{draw.randrange(256)}.0.{k} has {number(3)} users" for k in range(3)]
    missed = [f"call {phone()} in {number(4)}" for _ in range(10)] + [f"mail bob{k}(at)mail{k}.example.com now" for k in range(10)]
    texts += [f"in {number(4)} there were {number(3)} of {number(2)}" for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labelled = pii.labelled_table(table).collect()
    assert any(3 in row.labels for row in labelled)
    model = pii.train(pii.labelled_table(table))
    found = model.spans(missed)
    assert not any(pii.base_spans(text) for text in missed)
    wanted = [(5, 3, text.index(" in ")) for text in missed[:10]] + [(5, 0, text.index(" now")) for text in missed[10:]]
    assert sum(span in spans for span, spans in zip(wanted, found, strict=True)) >= 16
    assert sum(map(bool, model.spans(texts[103:]))) < 20


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(1)
    crf = pii.Crf({})
    crf.moves = draw.normal(size=crf.moves.shape)
    n = len(pii.LABELS)
    scores = draw.normal(size=(2, 3, n))
    for path, e in zip(crf.decode(scores), scores, strict=True):
        best = max(((crf.moves[n, a] + e[0, a] + crf.moves[a, b] + e[1, b] + crf.moves[b, c] + e[2, c], (a, b, c))
                    for a in range(n) for b in range(n) for c in range(n)))
        assert tuple(path) == best[1]


def test_combined_spans_leave_out_overlaps():
    base = [(5, 0, 10), (20, 1, 30)]
    assert pii.combined(base, [(0, 3, 5), (8, 2, 12), (10, 2, 20), (29, 3, 40), (30, 3, 31)]) == [
        (0, 3, 5), (5, 0, 10), (10, 2, 20), (20, 1, 30), (30, 3, 31)]


# 7
@pytest.mark.parametrize("slice_entries", [200_000, 7])
def test_contamination(spark, table, docs, slice_entries):
    text = docs[-8][1]
    items = [(1, " ".join(text.split()[10:40])), (2, "w1"), (3, None), (10, "!!"), (20, "THE of"), (2, text)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.with_contamination(table, benchmark, "found", slice_entries=slice_entries)
    got = {r.doc_id: (r.found.n_words, sum(r.found.hits[1::2]) - sum(r.found.hits[::2]), len(r.found["items"])) for r in found.collect()}
    assert got == {r[0]: r[1:4] for r in brute.contamination(docs, items)}
    assert rows(decontaminate.contamination(table, benchmark)) == sorted(brute.contamination(docs, items))
    clean = {r[0] for r in brute.contamination(docs, items) if not r[5]}
    assert {r.doc_id for r in decontaminate.decontaminated(table, benchmark).collect()} == clean


def test_items_without_an_id_count_as_hits_only(spark):
    text = " ".join(f"w{k}" for k in range(20))
    benchmark = spark.createDataFrame([(None, text), (1, text)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = decontaminate.with_contamination(docs, benchmark, "found").first().found
    assert row["items"] == ["1"] and row.hits == [0, 20]
    alone = decontaminate.with_contamination(docs, benchmark.where("item_id is null"), "found").first().found
    assert alone["items"] == [] and alone.hits == [0, 20]


def test_contamination_without_items_or_documents(spark, table, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminated(table, none).count() == table.count()
    assert not decontaminate.contamination(empty, none).collect()


# 9
def naive_plan(tokens, budget_share, balance, max_repeats):
    """Exponent by scanning all multiples of 2^-12 around; weights and goals."""
    total = sum(tokens.values())
    weights = lambda a: {s: (n / total) ** a / sum((m / total) ** a for m in tokens.values()) for s, n in tokens.items()}
    def good(a):
        w = weights(a)
        entropy = -sum(x * math.log(x) for x in w.values())
        repeats = [w[s] * budget_share * total / n for s, n in tokens.items()] if budget_share else [w[s] / tokens[s] for s in tokens]
        most = max(repeats) / (1 if budget_share else min(repeats))
        return entropy <= balance * math.log(len(tokens)) and most <= max_repeats
    return weights(next((k / 4096 for k in range(4097) if good(k / 4096)), 1.0))


@pytest.mark.parametrize("limits", [(1.0, 0.9, 4.0), (2.0, 0.99, 3.0), (None, 1.0, 2.0), (0.3, 0.95, 4.0)])
def test_mixture(spark, limits):
    draw = random.Random(8)
    docs = [(k, " ".join(["w"] * draw.randrange(1, 60)), "big" if k % 3 else f"s{k % 5}" if k % 2 else None) for k in range(400)]
    docs += [(900, None, "blank"), (901, "", "big")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, epoch int")
    share, balance, most = limits
    options = {"budget_share": share, "balance": balance, "max_repeats": most, "block_docs": 16}
    found = mixture.with_copies(table, "copy", **options).collect()
    tokens, got = {}, {}
    for _, text, source in docs:
        if text:
            tokens[source] = tokens.get(source, 0) + len(text.split())
    for row in found:
        got[row.source] = got.get(row.source, 0) + row.copy.n_tokens
    weights = naive_plan(tokens, *limits)
    total = sum(tokens.values())
    budget = share * total if share else max(n / weights[s] for s, n in tokens.items())
    for source, weight in weights.items():
        goal = weight * budget
        assert goal * 0.999 - 61 <= got.get(source, 0) <= goal * 1.001 + 1
    if share is None:
        assert {r.doc_id for r in found} == {d[0] for d in docs}
    # Epochs of a source are permutations: the part of the last one is what comes first in it.
    copies = {}
    for row in found:
        copies.setdefault((row.source, row.copy.epoch), []).append(row.doc_id)
    assert all(len(v) == len(set(v)) for v in copies.values())
    assert mixture.mixed(table, **options).columns == table.columns
    assert not mixture.mixed(table.limit(0), **options).collect()


# 10
def test_records(spark, table, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    folder = shared_folder(spark)
    found = rows(records.token_records(table, folder, tokenizer_path()))
    start, expected = 0, []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    index = spark.read.parquet(f"{folder}/index")
    back = {r.id: r.tokens for r in records.read_records(index, folder).collect()}
    assert all(back[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs)


@pytest.mark.parametrize("text", [
    "Straße ÉCOLE naïve, İstanbul ſ ΣΑΣ it's I'LL a.b don't <|endoftext|>x", "x́ é. ǅ ﬁ Å", "日本語 テスト،  \t a\r\nb",
    "Ða Þ. µ ª!!", "a$$$ B%%% c&&&,", "12 3a a3 ..a ''s 's", " x\x1cy\x85z",
])
def test_encoder_equals_the_tokenizer(text):
    encode = records.encoder(tokenizer_path())
    assert np.frombuffer(encode([text])[0], encode.width).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_takes_arrow_columns_and_keeps_letters_once(monkeypatch):
    monkeypatch.setattr(records, "CACHE_STEMS", 3)
    draw, signs = random.Random(5), "abCÉſİßı .,'\n\r!$%1\u0301\u00a0\u2028文"
    texts = ["".join(draw.choices(signs, k=draw.randrange(30))) for _ in range(2000)] + [None, "", " ", "\n \n", "a.", "A,a.. a"]
    encode = records.WordEncoder(tokenizer_path())
    for k in range(3):
        found = encode(pa.array(texts)[k * 600 :])
        whole = encode.tokenizer.encode_batch_fast([text or "" for text in texts[k * 600 :]], add_special_tokens=False)
        assert [np.frombuffer(ids, encode.width).tolist() for ids in found] == [e.ids for e in whole]
    encode(["Quz quz, QUZ! quz.. qUz"])
    assert "quz" in encode.stems and not any("quz" in word.lower() for word in encode.known)
    assert encode([]) == [] and encode([None, ""]) == [b"", b""]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    assert records.encoder(tokenizer_path()).by_word
    for name in ("byte_bpe_50k.json",):
        encode = records.encoder(public_tokenizers.path(name))
        texts = ["Two words,  three\nlines\n\n of text's", "", None, "É 12345 <|endoftext|> x" * 50]
        found = [np.frombuffer(ids, encode.width).tolist() for ids in encode(texts)]
        assert found == [encode.tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_damaged_records_are_found():
    good = records.frame(b"payload")
    assert records.unframe(good) == b"payload"
    for k in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])


def test_records_of_no_rows(spark, empty):
    assert not records.token_records(empty, shared_folder(spark), tokenizer_path()).collect()


# SQL and the pipeline
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        connection.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    expected = connection.sql(ORACLES[name])
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.select(*expected.columns)) == sorted(expected.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == start.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] <= counts[4]
    last = corpus_pipeline.run(spark, folder)
    assert last.count() == counts[4]
    assert rows(last.select(F.sum("n_tokens").alias("n")))[0][0] == max(r.start + r.n_tokens for r in last.collect())


def test_stages_send_texts_in_small_batches(spark):
    import corpus_pipeline

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('some word ', 50000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        for name, stage in corpus_pipeline.STAGES[2:3]:
            spark.conf.set(setting, before)
            stage(spark, docs, "/root/testdata/sf0.001")
            assert max(r.size for r in docs.mapInArrow(sizes, "size bigint").collect()) < 3 << 20, name
    finally:
        spark.conf.set(setting, before)
