"""Quality classifier: an interpolated modified Kneser-Ney model of the words of trusted text.

Words are runs of letters, digits and bytes from 0x80, marks are runs of other
signs; both keep their case and are told apart by 64-bit hashes. The model
predicts each of them from the one before. Words that trusted text does not
hold are spelled by a model of bytes of order four over 64 classes, the base
of the interpolation; only that base, of at most 64^4 rows whatever the
corpus, is broadcast. The counts of words and pairs grow with the corpus and
never pass the driver: the distinct words and pairs of each document meet the
terms of the model in groups of hashes, and the terms are summed up by document.
A task holds the terms of one group and streams what is asked of it. A frequent
word is asked for by every document, all in one group, at some ten bytes each.

Each text belongs to one of two folds by its hash and is scored by the model
of the trusted texts of the other fold, so no text is known from itself or from
an equal copy, and thresholds hold for texts outside the trusted ones. Only the
spelling is counted over both folds.

A document's score is its mean negative log likelihood per byte, drawn towards
the mean of its language by ``prior`` bytes, so that a few words cannot look
extreme. It is kept if the score lies within language-specific quantiles of the
trusted scores, widened by ``errors`` standard errors of such quantiles, which
vanish as trusted documents grow in number.

Besides, each word has an evidence of toxicity: the log ratio of its shares of
toxic and of trusted documents, less ``errors`` standard errors. A document
whose strongest word lies above zero and above the ``high`` quantile of trusted
documents of its language is not kept. Nor is one whose share of words that
equal one of the two before lies above that quantile: a frequent word over and
over has a usual likelihood.

Defined results: null and empty texts score the mean of their language and are
kept; a null language is a language; a language with fewer than ``least``
trusted documents takes the quantiles of all of them; without trusted
documents all are kept; repeated labels and rows count once and as often as
they occur; a document is trusted if all its labels say so, toxic if any does;
equal texts have equal scores within a language. Sums are of integers, so that
scores do not depend on the order of rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm import kernels
from codequarry.llm.shared import dropped, free_name, schema_with, shared_folder, with_column, written, written_alone

ORDER = 4
_COUNT_SLICE = 4 << 20
#: Text whose words are counted at once; a worker holds on to much of what one slice took, some hundred times its bytes.
_WORD_SLICE = 1 << 20


def _symbols() -> np.ndarray:
    """Class of each byte; 0 stands for the start of a text."""
    classes = np.full(256, 49, np.int32)
    classes[97:123] = np.arange(1, 27)
    classes[65:91], classes[48:58] = 27, 28
    classes[0x80:0xC0], classes[0xC0:] = 51 + np.arange(0x40) % 13, 50
    # White space and marks with a class of their own.
    for k, byte in enumerate(b"\n.,!?'\"-()|#$%&*@:;/"):
        classes[byte] = 30 + k if k < 19 else 48
    classes[[9, 11, 12, 13]], classes[32] = 30, 29
    return classes


SYMBOLS = _symbols()


def codes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The n-gram of order four that ends at each byte, as 24 bits; starts of texts are padded."""
    sizes = np.diff(bounds)
    shift = np.repeat(np.arange(1, len(sizes) + 1) * (ORDER - 1), sizes)
    at = np.arange(len(data)) + shift
    padded = np.zeros(len(data) + (len(sizes) + 1) * (ORDER - 1), np.int32)
    padded[at] = SYMBOLS[data]
    joined = padded.copy()
    for k in range(1, ORDER):
        joined[k:] |= padded[:-k] << (6 * k)
    return joined[at]


def ngram_counts(texts: DataFrame) -> DataFrame:
    """Counts of all n-grams of order four in a one-column DataFrame of texts: code, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 0, _COUNT_SLICE):
            total = np.bincount(codes(*kernels.buffer(batch.column(0))), minlength=1)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["code", "n"])

    return texts.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    return _discounts_of({row.n: row.k for row in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()})


def _discounts_of(of: dict[int, int]) -> list[float]:
    n1, n2, n3, n4 = (of.get(k, 0) for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1))
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def train(counts: DataFrame, folder: str | None = None) -> DataFrame:
    """Terms of the model: order, key, term.

    With order n above 0, ``key`` is an n-gram and ``term`` its discounted share of
    its context; with order -n, ``key`` is a context of n - 1 symbols and ``term`` the
    weight of the next lower order after it. Counts of all orders are written to ``folder``
    once; a plan that made them anew for each use took 60 stages.
    """
    levels = [counts.select("code", "n")]
    for order in range(ORDER - 1, 0, -1):
        # Continuation counts: in how many n-grams each shorter one ends.
        levels.append(levels[-1].groupBy(F.col("code").bitwiseAND((1 << 6 * order) - 1).alias("code")).agg(F.count("*").alias("n")))
    each = [level.select(F.lit(order).alias("order"), "code", "n") for order, level in zip(range(ORDER, 0, -1), levels, strict=True)]
    grams = written_alone(functools.reduce(DataFrame.unionByName, each), folder or shared_folder(counts.sparkSession), "grams")
    found = grams.where("n <= 4").groupBy("order", "n").agg(F.count("*").alias("k")).collect()
    cases = F.lit(None).cast("double")
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts_of({row.n: row.k for row in found if row.order == order})
        cases = F.when(F.col("order") == order, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(cases)
    grams = grams.withColumn("context", F.shiftright("code", 6)).withColumn("discount", cases)
    contexts = grams.groupBy("order", "context").agg(F.sum("n").alias("total"), F.sum("discount").alias("left"))
    terms = grams.join(contexts, ["order", "context"]).select("order", F.col("code").alias("key"), ((F.col("n") - F.col("discount")) / F.col("total")).alias("term"))
    return terms.unionByName(contexts.select((-F.col("order")).alias("order"), F.col("context").alias("key"), (F.col("left") / F.col("total")).alias("term")))


def loss_table(order: np.ndarray, key: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Negative log probability of the last symbol of every n-gram of order four."""
    p = np.full(64, 1 / 64, np.float32)
    for n in range(1, ORDER + 1):
        weight = np.ones(64 ** (n - 1), np.float32)
        weight[key[order == -n]] = term[order == -n]
        # The lower order does not see the first symbol of the context.
        p = (weight.reshape(-1, 64 ** (n - 2) if n > 1 else 1)[:, :, None] * p.reshape(1, -1, 64)).reshape(-1)
        p[key[order == n]] += term[order == n].astype(np.float32)
    np.log(p, out=p)
    return np.negative(p, out=p)


def trusted_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Ids that all their labels call good and not toxic."""
    return labelled_ids(labels, id).where("not bad").select("trusted")


def labelled_ids(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Trusted and toxic ids: trusted, bad."""
    return (
        labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("trusted"))
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0 or t = 1").select("trusted", (F.col("t") == 1).alias("bad"))
    )


#: Class of each byte as part of a word: 0 for white space, 1 for marks, 2 for letters and digits.
_CLASS = np.ones(256, np.int8)
_CLASS[kernels.SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_START, _PAIR, _FOLD = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
#: Terms are rounded to multiples of its inverse.
_UNIT = 1 << 20
_HALF, _ROW, _WHOLE = (np.uint64(x) for x in (32, 40, 64))
#: Pairs are joined in so many portions, as are documents with the model, so that the files of one are gone before the next.
PORTIONS = 2
#: Text that asks of one group of the model, and text that asks by one row.
_GROUP_BYTES, _ASK_SLICE, _LOW = 16 << 20, 1 << 20, 8
#: Words without repeats that each text is taken to have besides its own.
_DRAWN = 10


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of word bytes and of marks."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kinds = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kinds[1:] != kinds[:-1]
    new[bounds] = True
    edges = np.flatnonzero(new)
    inner = kinds[edges[:-1]] > 0
    starts = edges[:-1][inner]
    return np.searchsorted(bounds, starts, "right") - 1, starts, edges[1:][inner]


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, losses: np.ndarray) -> np.ndarray:
    """Negative log probability of each word and the space after it, spelled after a space; in units."""
    sizes = ends - starts + 2
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    text = np.full(bounds[-1], 32, np.uint8)
    lengths = ends - starts
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[within + np.repeat(bounds[:-1] + 1, lengths)] = data[within + np.repeat(starts, lengths)]
    each = np.rint(losses[codes(text, bounds)].astype(np.float64) * _UNIT).astype(np.int64)
    each[bounds[:-1]] = 0
    sums = np.concatenate(([0], np.cumsum(each)))
    return np.diff(sums[bounds])


def folds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fold of each text."""
    return (kernels.span_hashes(kernels.BYTE_CODES[data], bounds[:-1], bounds[1:]) & np.uint64(1)).astype(np.int32)


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return kernels.mix(before * _PAIR + word * np.uint64(3) + np.uint64(1))


def of_fold(gram: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Hash of a word or pair in the model of a fold."""
    return kernels.mix(gram + (fold.astype(np.uint64) + np.uint64(1)) * _FOLD)


def _before(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and whether it is the first of its row."""
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    before = np.roll(hashes, 1)
    before[first] = _START
    return before, first


def _groups(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct tuple, and the number of that tuple for each row.

    Equal tuples have equal keys. Where different ones do too, a tuple can get several numbers.
    """
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[order][1:] != column[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def word_counts(texts: DataFrame, spelling) -> DataFrame:
    """Counts of (text, bad): fold, before, word, n, good, toxic, spelled; before is null for words on their own.

    Pairs have the number n of their occurrences in trusted texts, words the numbers of trusted and of toxic texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses = loss_table(*spelling.value)
        for batch in kernels.slices(batches, 0, _WORD_SLICE):
            data, bounds = kernels.buffer(batch.column(0))
            if not len(data):
                continue
            bad = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rows, starts, ends = words(data, bounds)
            hashes, fold = kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends), folds(data, bounds)[rows]
            before, _first = _before(rows, hashes)
            of_bad = bad[rows]
            one, number = _groups(of_fold(hashes, fold), fold, hashes)
            place = number * len(batch) + rows
            met, _ = _groups(place, place)
            toxic = np.bincount(number[met], of_bad[met], len(one)).astype(np.int64)
            good = np.bincount(number[met], minlength=len(one)) - toxic
            ours = np.flatnonzero(~of_bad)
            # Pairs of a word before stay together, which compresses well.
            near = of_fold(before, fold) >> _HALF << _HALF | hashes >> _HALF
            two, times = _groups(near[ours], fold[ours], before[ours], hashes[ours])
            n, two = np.bincount(times, minlength=len(two)), ours[two]
            none, signed = np.zeros(len(two), np.int64), lambda x: x.view(np.int64)
            at = np.concatenate((one, two))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fold[at]), pa.array(signed(before[at]), mask=np.arange(len(at)) < len(one)), pa.array(signed(hashes[at])),
                 *(pa.array(np.concatenate(x).astype(np.int64)) for x in (
                     (np.zeros(len(one)), n), (good, none), (toxic, none), (spelled(data, starts[one], ends[one], losses), none)))],
                names=["fold", "before", "word", "n", "good", "toxic", "spelled"])

    found = texts.mapInArrow(count, "fold int, before bigint, word bigint, n bigint, good bigint, toxic bigint, spelled bigint")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return found.groupBy("fold", "before", "word").agg(*sums, F.max("spelled").alias("spelled"))


def _discounted(n: str, discounts: list[float]) -> Column:
    d1, d2, d3 = discounts
    return F.col(n) - F.when(F.col(n) == 1, d1).when(F.col(n) == 2, d2).otherwise(d3)


def word_terms(
    counts: DataFrame, texts: dict[int, tuple[int, int]], errors: float, folder: str, of_terms: str,
) -> tuple[DataFrame, dict[int, float]]:
    """Terms (gram, own, after, evidence) of the model, and the log weight of spelling by fold.

    The log likelihood of a text is the sum, over its words, of the weight and of
    the spelled log probability, plus ``own`` of each of its words and pairs, plus
    ``after`` of each word that another one follows: what the pair adds to its
    back-off, the word to its spelling, and the weight of backing off. ``texts`` has
    the numbers of trusted and of toxic texts by fold. The terms are written to the folder ``of_terms``.
    """
    pairs = counts.where("before is not null")
    by_pair = _discounts(pairs.select("n"))
    many = lambda n, d: sum((F.count_if(c) * x for c, x in zip((F.col(n) == 1, F.col(n) == 2, F.col(n) > 2), d, strict=True)), F.lit(0.0))
    heads = written_alone(pairs.groupBy("fold", F.col("before").alias("word")).agg(F.log(many("n", by_pair) / F.sum("n")).alias("after"), F.sum("n").alias("total")), folder, "heads")
    ends = written_alone(pairs.groupBy("fold", "word").agg(F.count("*").alias("n")), folder, "ends")
    by_word = _discounts(ends)
    sums = {r.fold: (r.total, r.left) for r in ends.groupBy("fold").agg(F.sum("n").alias("total"), many("n", by_word).alias("left")).collect()}
    weights = {fold: math.log(left / total) for fold, (total, left) in sums.items()}
    of_fold_ = lambda of: F.element_at(F.create_map(*(F.lit(x) for f in (0, 1) for x in (f, float(of.get(f, 0.0))))), F.col("fold"))
    spell, weight = F.col("spelled") / -float(_UNIT), of_fold_(weights)
    share = F.when(F.col("n").isNotNull(), _discounted("n", by_word) / of_fold_({f: t for f, (t, _) in sums.items()})).otherwise(0.0)
    part = lambda n, k: (F.col(n) + 0.5) / (of_fold_({f: t[k] for f, t in texts.items()}) + 1)
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("good") + 0.5))
    alone = counts.where("before is null").select("fold", "word", "good", "toxic", "spelled").join(ends, ["fold", "word"], "left")
    alone = written_alone(alone.select(
        "fold", "word", F.log(share + F.exp(weight + spell)).alias("p"), (weight + spell).alias("base"),
        (F.log(part("toxic", 1) / part("good", 0)) - errors * doubt).alias("evidence")), folder, "words")
    rounded = lambda x: F.round(x * _UNIT).cast("bigint")
    # The start of a text is no word of its own, only one that others follow.
    singles = alone.join(heads, ["fold", "word"], "full").select(
        "fold", F.lit(None).cast("bigint").alias("before"), "word", rounded(F.coalesce(F.col("p") - F.col("base"), F.lit(0.0))).alias("own"),
        rounded(F.coalesce("after", F.lit(0.0))).alias("after"), "evidence")
    leads = heads.withColumnRenamed("word", "before")
    portion = lambda rows, k: rows.where(F.pmod("before", F.lit(PORTIONS)) == k)

    def doubles(k: int) -> DataFrame:
        met = portion(pairs.select("fold", "before", "word", "n"), k).join(portion(leads, k), ["fold", "before"])
        return met.join(alone.select("fold", "word", "p"), ["fold", "word"]).select(
            "fold", "before", "word",
            rounded(F.log(_discounted("n", by_pair) / F.col("total") + F.exp(F.col("after") + F.col("p"))) - F.col("after") - F.col("p")).alias("own"),
            F.lit(0).cast("bigint").alias("after"), F.lit(None).cast("double").alias("evidence"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(0).to_numpy()
            before, word = (batch.column(k).fill_null(0).to_numpy().view(np.uint64) for k in (1, 2))
            single = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            gram = of_fold(np.where(single, word, pair(before, word)), fold)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *batch.columns[3:]], names=["gram", "own", "after", "evidence"])

    keyed = lambda rows: rows.mapInArrow(key, "gram bigint, own bigint, after bigint, evidence double")
    parts = [written_alone(keyed(rows), of_terms, f"part_{k}") for k, rows in enumerate([singles, *map(doubles, range(PORTIONS))])]
    return functools.reduce(DataFrame.unionByName, parts), weights


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the fewest bytes that hold all of them, little endian."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))).newbyteorder("<"))


def _wide(data: pa.Buffer, n: int) -> np.ndarray:
    """What ``_narrow`` made of ``n`` numbers."""
    return np.frombuffer(data, f"<u{data.size // n}").astype(np.int64)


def _answers(asked: pa.RecordBatch, gram: np.ndarray, own: np.ndarray, after: np.ndarray, evidence: np.ndarray) -> pa.RecordBatch:
    """A row for each row of ``asked``: its slice, and gain and strongest evidence of each of its texts with a known word.

    The terms are those of a group, in ascending order of ``gram``.
    """
    out: tuple[list[bytes], ...] = ([], [], [])
    for k in range(len(asked)):
        grams, keys, sizes = (np.frombuffer(asked.column(c)[k].as_buffer(), kind) for c, kind in ((5, "<i8"), (8, "<i8"), (9, "<i4")))
        times, follows = (_wide(asked.column(c)[k].as_buffer(), len(grams)) for c in (6, 7))
        at = np.minimum(np.searchsorted(gram, grams), len(gram) - 1)
        known = gram[at] == grams
        gain = np.where(known, times * own[at] + follows * after[at], 0)
        starts = np.cumsum(sizes) - sizes
        found = np.logical_or.reduceat(known, starts)
        best = np.maximum.reduceat(np.where(known, evidence[at], -np.inf), starts)[found]
        for some, values in zip(out, (keys[found], np.add.reduceat(gain, starts)[found], best), strict=True):
            some.append(values.tobytes())
    return pa.RecordBatch.from_arrays([asked.column(10), *(pa.array(x, pa.binary()) for x in out)], names=["slice", "keys", "gains", "best"])


def _summed(answers: pa.Table) -> pa.Table:
    """Gain and strongest evidence of each text from all answers to a slice."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in answers[name]])
    keys, gains, best = joined("keys", "<i8"), joined("gains", "<i8"), joined("best", "<f8")
    one, number = _groups(keys, keys)
    gain, most = np.zeros(len(one), np.int64), np.full(len(one), -np.inf)
    np.add.at(gain, number, gains)
    np.maximum.at(most, number, best)
    return pa.table({"key": keys[one], "gain": gain, "evidence": pa.array(most, mask=most == -np.inf)})


class Scorer:
    """A trained model: terms joined with the words of documents, and the broadcast spelling of bounded size."""

    def __init__(self, spelling, terms: DataFrame, weights: dict[int, float]):
        self.spelling, self.terms, self.weights = spelling, terms, weights

    def basic(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """``docs`` with a struct ``name``: n bytes, its negative log likelihood spelled word by word, share of repeats."""
        spelling, weights, at = self.spelling, self.weights, docs.columns.index(text)
        kind = pa.struct([("n", pa.int64()), ("base", pa.int64()), ("again", pa.float64())])

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            losses = loss_table(*spelling.value)
            weight = np.rint(np.array([weights.get(f, 0.0) for f in (1, 0)]) * _UNIT).astype(np.int64)
            for batch in kernels.slices(batches, at):
                data, bounds = kernels.buffer(batch.column(at))
                base, again = np.zeros(len(batch), np.int64), np.zeros(len(batch))
                if len(data):
                    rows, starts, ends = words(data, bounds)
                    np.add.at(base, rows, spelled(data, starts, ends, losses) - weight[folds(data, bounds)[rows]])
                    hashes = kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends)
                    same = np.zeros(len(rows), bool)
                    for k in (1, 2):
                        same[k:] |= (hashes[k:] == hashes[:-k]) & (rows[k:] == rows[:-k])
                    again = np.bincount(rows, same, len(batch)) / (np.bincount(rows, minlength=len(batch)) + _DRAWN)
                values = [pa.array(np.diff(bounds), pa.int64()), pa.array(base), pa.array(again)]
                yield with_column(batch, name, pa.StructArray.from_arrays(values, fields=list(kind)))

        return docs.mapInArrow(spell, schema_with(docs, name, "struct<n: bigint, base: bigint, again: double>"))

    def gained(self, docs: DataFrame, text: str, folder: str) -> DataFrame:
        """Per different text: hash of the text, gain of its log likelihood over its spelling, strongest evidence.

        Hashes are dealt into groups. What a slice of texts asks of a group travels as one row, which meets the
        sorted terms of that group; texts without any known word have no row.
        """
        held = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("key"))
        groups = max(1, (held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _GROUP_BYTES)
        portions = PORTIONS if groups > 1 else 1
        parts = [written_alone(self._gained(held, k, portions, groups), folder, f"gained_{k}") for k in range(portions)]
        found = functools.reduce(DataFrame.unionByName, parts)
        return found.groupBy("key").agg(F.sum("gain").alias("gain"), F.max("evidence").alias("evidence"))

    def _gained(self, held: DataFrame, portion: int, portions: int, groups: int) -> DataFrame:
        """What the words and pairs of one of ``portions`` portions of all hashes give to each text."""
        asks = "grams binary, times binary, follows binary, keys binary, sizes binary, slice bigint"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in kernels.slices(batches, 0, _ASK_SLICE):
                data, bounds = kernels.buffer(batch.column(0))
                if not len(data):
                    continue
                key = batch.column(1).to_numpy()
                rows, starts, ends = words(data, bounds)
                hashes, other = kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends), 1 - folds(data, bounds)
                before, first = _before(rows, hashes)
                heads = rows[first]
                row = np.concatenate((rows, rows, heads))
                gram = of_fold(np.concatenate((hashes, pair(before, hashes), np.full(len(heads), _START))), other[row])
                # How often a word or pair occurs, and how often another one follows it.
                times = np.repeat([1, 1, 0], [len(rows), len(rows), len(heads)])
                follows = np.concatenate((~np.append(first[1:], True), np.zeros(len(rows), bool), np.ones(len(heads), bool)))
                ours = np.flatnonzero(gram % np.uint64(portions) == portion)
                if not len(ours):
                    continue
                row, gram, times, follows = row[ours], gram[ours], times[ours], follows[ours]
                one, number = _groups(row.astype(np.uint64) << _ROW | gram >> (_WHOLE - _ROW), row, gram)
                times, follows = (_narrow(np.bincount(number, x, len(one)).astype(np.int64)) for x in (times, follows))
                row, gram = row[one], gram[one].view(np.int64)
                group = (gram >> _LOW) % groups
                order = np.argsort(group, kind="stable")
                row, gram, group, times, follows = (x[order] for x in (row, gram, group, times, follows))
                changed = lambda x: np.append(True, x[1:] != x[:-1])
                edges = np.append(np.flatnonzero(changed(group)), len(group))
                texts = np.append(np.flatnonzero(changed(group) | changed(row)), len(group))
                cuts, keys, sizes = np.searchsorted(texts, edges), key[row[texts[:-1]]], np.diff(texts).astype("<i4")
                cut = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
                # Only tells which answers meet; equal slices may share a number.
                slice_ = np.full(len(edges) - 1, kernels.mix(key.view(np.uint64)).sum(dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[edges[:-1]], pa.int64()), cut(gram, edges), cut(times, edges), cut(follows, edges), cut(keys, cuts), cut(sizes, cuts), pa.array(slice_)],
                    names=["group", "grams", "times", "follows", "keys", "sizes", "slice"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, parts, terms = None, [], None
            for batch in batches:
                asking = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
                of = batch.column(0).to_numpy()
                edges = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (asking[1:] != asking[:-1])))
                for start, end in zip(edges, [*edges[1:], len(of)], strict=True):
                    if of[start] != group:
                        group, parts, terms = of[start], [], None
                    some = batch.slice(start, end - start)
                    if not asking[start]:
                        parts.append([some.column(k).fill_null(lost).to_numpy() for k, lost in ((1, 0), (2, 0), (3, 0), (4, -np.inf))])
                        continue
                    if terms is None and parts:
                        gram, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
                        order, parts = np.argsort(gram), []
                        terms = [gram[order], *(x[order] for x in values)]
                    if terms is not None:
                        yield _answers(some, *terms)

        terms = self.terms.where(F.pmod("gram", F.lit(portions)) == portion).withColumn("group", F.pmod(F.shiftright("gram", _LOW), F.lit(groups)))
        asked = held.mapInArrow(ask, f"group bigint, {asks}")
        both = terms.unionByName(asked, allowMissingColumns=True).select("group", "gram", "own", "after", "evidence", "grams", "times", "follows", "keys", "sizes", "slice")
        # The terms of a group come before what is asked of it.
        sorted_ = both.repartition("group").sortWithinPartitions("group", F.col("grams").isNotNull())
        # A row per slice and group, not per text and group: both numbers grow with the input.
        answered = sorted_.mapInArrow(answer, "slice bigint, keys binary, gains binary, best binary")
        found = answered.groupBy("slice").applyInArrow(_summed, "key bigint, gain bigint, evidence double")
        return found.groupBy("key").agg(F.sum("gain").alias("gain"), F.max("evidence").alias("evidence"))

    def losses(self, rows: DataFrame, gained: DataFrame) -> DataFrame:
        """Rows (key, score) with n, loss, again and evidence; equal texts share what they gain."""
        copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
        each = gained.join(copies, "key").withColumn("gain", F.col("gain") / F.col("copies")).drop("copies")
        loss = (F.col("score.base") - F.coalesce("gain", F.lit(0.0))) / float(_UNIT)
        return rows.join(each, "key", "left").withColumns({"n": F.col("score.n"), "again": F.col("score.again"), "loss": loss}).drop("score", "gain")


class Classifier:
    """Model and thresholds fitted to the trusted documents of a table."""

    def __init__(
        self, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
        low: float = 0.005, high: float = 0.995, errors: float = 2.0, prior: float = 60.0, least: int = 50,
    ):
        folder = shared_folder(docs.sparkSession)
        fit = f"{folder}/fit"
        self.docs, self.text, self.lang, self.prior = docs, text, lang, prior
        rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
        marked = labelled_ids(labels)
        trusted = marked.where("not bad").select("trusted")
        # One plan at every size: texts meet their labels in a shuffle, never by a broadcast that grows with the labels.
        texts = written_alone(rows.join(marked.hint("merge"), F.col("id") == F.col("trusted")).select("text", "bad"), fit, "labelled")
        letters = train(written_alone(ngram_counts(texts.where("not bad").select("text")), fit, "counts"), fit).toArrow()
        # At most twice the sum of 64^n rows for n up to the order.
        spelling = docs.sparkSession.sparkContext.broadcast(
            (letters["order"].to_numpy().astype(np.int8), letters["key"].to_numpy().astype(np.int32), letters["term"].to_numpy().astype(np.float32)))
        numbers = _fold_sizes(texts)
        counted = written_alone(word_counts(texts, spelling), fit, "words_counted")
        dropped(docs.sparkSession, f"{fit}/labelled")
        terms, weights = word_terms(counted, numbers, errors, fit, f"{folder}/terms")
        dropped(docs.sparkSession, fit)
        self.scorer = Scorer(spelling, terms, weights)
        basic = self.scorer.basic(rows, "text", "score").select("id", "lang", F.xxhash64("text").alias("key"), "score")
        basic = written(basic, folder, "basic")
        self.scores = written_alone(self.scorer.losses(basic, self.scorer.gained(rows, "text", f"{folder}/gained")), folder, "scores")
        dropped(docs.sparkSession, f"{folder}/gained")
        good = self.scores.join(trusted, F.col("id") == F.col("trusted"), "left_semi").where("n > 0")
        means = good.groupBy("lang").agg((F.sum("loss") / F.sum("n")).alias("mean"), F.count("*").alias("k"))
        overall = good.agg((F.sum("loss") / F.sum("n")).alias("mean")).first().mean or 0.0
        self.means = written(means.where(F.col("k") >= least).select("lang", "mean"), folder, "means")
        self.overall = overall
        drawn = self._drawn(good.alias("d").join(self.means.alias("m"), F.expr("d.lang <=> m.lang"), "left"), "d.n", "d.loss")
        q = F.percentile_approx("score", [low, 0.5, high], 10_000)
        often = F.percentile_approx("again", [0.5, high], 10_000)
        worst = F.greatest(F.percentile_approx("evidence", high, 10_000), F.lit(0.0))
        # Standard error of a normal quantile over its distance from the median, times the root of the number.
        wide = {p: errors * math.sqrt(p * (1 - p)) / (NormalDist().pdf(z := NormalDist().inv_cdf(p)) * abs(z)) for p in (low, high)}
        slack = lambda p: F.lit(wide[p]) / F.sqrt(F.greatest("k", F.lit(1)))
        limits = (
            drawn.select(F.col("d.lang").alias("lang"), "m.mean", drawn_score().alias("score"), F.coalesce("evidence", F.lit(0.0)).alias("evidence"), "again")
        )
        bounds = lambda t: t.select(
            *(c for c in t.columns if c in ("lang", "mean")), (F.col("q")[0] - slack(low) * (F.col("q")[1] - F.col("q")[0])).alias("low"),
            (F.col("q")[2] + slack(high) * (F.col("q")[2] - F.col("q")[1])).alias("high"), "worst",
            (F.col("often")[1] + slack(high) * (F.col("often")[1] - F.col("often")[0])).alias("often"))
        of = [q.alias("q"), worst.alias("worst"), often.alias("often"), F.count("*").alias("k")]
        of_all = bounds(limits.agg(*of)).first()
        self.low, self.high, self.worst, self.often = of_all if of_all.low is not None else (-1e9, 1e9, 1e9, 1e9)
        of_lang = written(bounds(limits.groupBy("lang", "mean").agg(*of)).where("mean is not null"), folder, "limits")
        self.limits = of_lang.select(*(F.col(c).alias(f"limit_{c}") for c in ("lang", "mean", "low", "high", "worst", "often")))

    def _drawn(self, rows: DataFrame, n: str, loss: str) -> DataFrame:
        mean = F.coalesce(F.col("m.mean"), F.lit(float(self.overall)))
        return rows.withColumn("_drawn", (F.col(loss) + self.prior * mean) / (F.col(n) + self.prior))

    def judged(self, rows: DataFrame) -> DataFrame:
        """Rows (lang, n, loss, evidence, again) with score, low, high and kept. One limit row per language."""
        joined = rows.join(self.limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
        limit = lambda name, of: F.coalesce(f"limit_{name}", F.lit(float(of)))
        score = (F.col("loss") + self.prior * limit("mean", self.overall)) / (F.col("n") + self.prior)
        judged = joined.withColumn("score", score).withColumn("low", limit("low", self.low)).withColumn("high", limit("high", self.high))
        clean = (F.coalesce("evidence", F.lit(0.0)) <= limit("worst", self.worst)) & (F.col("again") <= limit("often", self.often))
        return judged.withColumn("kept", (F.col("n") == 0) | F.col("score").between(F.col("low"), F.col("high")) & clean)

    def scored(self, docs: DataFrame) -> DataFrame:
        """Scores (key, lang, n, loss, evidence, again) of documents: those at hand if the model was fitted to this very table."""
        if docs is self.docs:
            return self.scores
        basic = self.scorer.basic(docs.select(F.col(self.text).alias("text"), F.col(self.lang).alias("lang")), "text", "score")
        basic = written(basic.select(F.xxhash64("text").alias("key"), "lang", "score"))
        return self.scorer.losses(basic, self.scorer.gained(docs, self.text, shared_folder(docs.sparkSession)))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The documents whose score is within the limits."""
        taken = list(docs.columns)
        key, lang, good, of = (taken.append(name) or name for name in (free_name(taken, n) for n in ("key", "language", "good_key", "good_language")))
        named = docs.withColumn(key, F.xxhash64(self.text)).withColumn(lang, F.col(self.lang))
        found = self.judged(self.scored(docs)).where("kept").select(F.col("key").alias(good), F.col("lang").alias(of)).distinct()
        same = (F.col(key) == F.col(good)) & F.col(lang).eqNullSafe(F.col(of))
        return named.join(found, same, "left_semi").select(*docs.columns)

    def results(self) -> DataFrame:
        """Per document: doc_id, lang, n_bytes, perplexity, score, lower and upper limit, kept."""
        return self.judged(self.scores).select(
            F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_bytes"),
            F.exp(F.when(F.col("n") > 0, F.col("loss") / F.col("n"))).alias("perplexity"), "score", "low", "high", "kept")


def _fold_sizes(texts: DataFrame) -> dict[int, tuple[int, int]]:
    """Numbers of trusted and of toxic texts by fold."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(folds(*kernels.buffer(batch.column(0)))), batch.column(1)], names=["fold", "bad"])

    counts = texts.mapInArrow(fold, "fold int, bad boolean").groupBy("fold").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad"))
    return {r.fold: (r.good, r.bad) for r in counts.collect()}


def drawn_score() -> Column:
    return F.col("_drawn")
