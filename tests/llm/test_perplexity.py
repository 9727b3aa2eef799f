"""Perplexity of the quality classifier against a plain interpolated modified Kneser-Ney model."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import quality


def one_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def discounts(counts):
    """Discount of each count by the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    of = {1: 1 - 2 * y * n2 / max(n1, 1), 2: 2 - 3 * y * n3 / max(n2, 1), 3: 3 - 4 * y * n4 / max(n3, 1)}
    of = {k: min(max(d, 0.05), k - 0.05) for k, d in of.items()}
    return lambda count: of[min(count, 3)]


class Plain:
    def __init__(self, texts, spelling):
        self.spelling = spelling
        self.pairs = [Counter(), Counter()]
        for text in texts:
            self.pairs[self.fold(text)].update(zip([None, *self.words(text)], self.words(text), strict=False))
        self.ends = [Counter(word for _, word in pairs) for pairs in self.pairs]
        self.of_pair = discounts([n for pairs in self.pairs for n in pairs.values()])
        self.of_word = discounts([n for ends in self.ends for n in ends.values()])
        self.after = [defaultdict(list), defaultdict(list)]
        for fold in (0, 1):
            for (before, _), n in self.pairs[fold].items():
                self.after[fold][before].append(n)

    def fold(self, text):
        return int(quality.folds(*one_text(text))[0])

    def words(self, text):
        return re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]+", text)

    def spelled(self, word):
        data, bounds = one_text(word)
        return math.exp(-quality.spelled(data, bounds[:1], bounds[1:], self.spelling)[0] / quality._UNIT)

    def word(self, fold, word):
        ends = self.ends[fold]
        total, n = sum(ends.values()), ends[word]
        left = sum(map(self.of_word, ends.values()))
        return (n - self.of_word(n) if n else 0) / total + left / total * self.spelled(word)

    def next(self, fold, before, word):
        counts, n = self.after[fold].get(before), self.pairs[fold][before, word]
        if not counts:
            return self.word(fold, word)
        left = sum(map(self.of_pair, counts))
        return (n - self.of_pair(n) if n else 0) / sum(counts) + left / sum(counts) * self.word(fold, word)

    def perplexity(self, text):
        other, words = 1 - self.fold(text), self.words(text)
        loss = -sum(math.log(self.next(other, a, b)) for a, b in zip([None, *words], words, strict=False))
        return math.exp(loss / len(text.encode()))


def test_perplexity_equals_a_plain_model(spark):
    draw = random.Random(8)
    vocabulary = [a + b for a in ("ba", "ke", "lo", "mi", "tu") for b in ("n", "r", "sto", "x1", "")] + [".", ",", "--"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.randrange(5, 60))) for _ in range(90)]
    texts += ["unseen words only here", "ban", "ban ban ban ban", "Ban,ker--lo. x", texts[0]]
    table = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r.perplexity for r in quality.Classifier(table, labels).results().collect()}
    trusted = spark.createDataFrame([(t,) for t in texts[:60]], "text string")
    terms = quality.train(quality.ngram_counts(trusted)).toPandas()
    plain = Plain(texts[:60], quality.loss_table(*(terms[c].to_numpy() for c in ("order", "key", "term"))))
    for k, text in enumerate(texts):
        assert found[k] == pytest.approx(plain.perplexity(text), rel=1e-3), text


def test_portions_and_groups_give_the_same_and_leave_no_files(spark, monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choices(["a", "bc", "d.", "EF", "42", "x-y"] + [f"w{k}" for k in range(90)], k=draw.randrange(40))) for _ in range(150)]
    texts += [None, "", "a a a " * 400, "a " * 70_000, texts[3], texts[3]]
    table = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, int(k > 60)) for k in range(80)], "doc_id bigint, quality int, toxic int")
    found, folders, make = [], [], quality.shared_folder
    monkeypatch.setattr(quality, "shared_folder", lambda s: folders.append(make(s)) or folders[-1])
    for portions, size, part in ((2, 16 << 20, 1 << 20), (1, 1 << 30, 1 << 30), (4, 3000, 900)):
        monkeypatch.setattr(quality, "PORTIONS", portions)
        monkeypatch.setattr(quality, "_GROUP_BYTES", size)
        monkeypatch.setattr(quality, "_ASK_SLICE", part)
        found.append(sorted(quality.Classifier(table, labels).scores.select("id", "n", "loss", "evidence", "again").collect()))
    assert found[0] == found[1] == found[2] and any(r.evidence is not None for r in found[0])
    assert all(not (Path(f.removeprefix("file:")) / "fit").exists() and not (Path(f.removeprefix("file:")) / "gained").exists() for f in folders)


def test_counts_in_few_bytes():
    for counts in ([0, 1, 1], [255], [256, 3], [70_000, 0], [1 << 33]):
        small = quality._narrow(np.array(counts))
        assert quality._wide(pa.py_buffer(small.tobytes()), len(counts)).tolist() == counts
    assert quality._narrow(np.array([3, 9])).itemsize == 1


def test_a_group_answers_a_slice_by_one_row():
    column = lambda *rows: pa.array([np.array(x, k).tobytes() for x, k in rows], pa.binary())
    ask = {"group": pa.array([3, 3]), **{c: pa.nulls(2, pa.float64()) for c in ("gram", "own", "after", "evidence")}}
    ask |= {"grams": column(([5, 9, 5, 7], "<i8"), ([9, 8], "<i8")), "times": column(([1, 2, 3, 1], "u1"), ([1, 1], "u1"))}
    ask |= {"follows": column(([0, 0, 1, 0], "u1"), ([1, 0], "u1")), "keys": column(([70, 71, 72], "<i8"), ([70, 73], "<i8"))}
    ask |= {"sizes": column(([2, 1, 1], "<i4"), ([1, 1], "<i4")), "slice": pa.array([1, 1])}
    terms = np.array([5, 9]), np.array([100, 10]), np.array([1000, 0]), np.array([0.5, -np.inf])
    answers = quality._answers(pa.RecordBatch.from_pydict(ask), *terms)
    assert answers.num_rows == 2
    found = {row["key"]: (row["gain"], row["evidence"]) for row in quality._summed(pa.Table.from_batches([answers])).to_pylist()}
    assert found == {70: (130, 0.5), 71: (1300, 0.5)}
