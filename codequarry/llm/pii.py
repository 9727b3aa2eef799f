"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

Four kinds of spans follow fixed patterns (the base). On top, a CRF labels the
tokens of every stretch of words with a digit or an at sign; tokens of other
words are outside by definition, so stretches are decoded on their own and
exactly. The CRF is trained on the driver from a labelled table: of each kind of
span, and of texts without any, at most ``sample_docs`` / 5 documents. Its
labels are the base spans and variants of them that miss their pattern: phones
without plus sign, cards and addresses with other separators, e-mail addresses
with "(at)". Features do not spell the patterns out: shapes, neighbours, lengths,
check digits, and the shapes of up to ``NEAR`` tokens of the same word to each
side, at every place of words of any length. Spans it finds are added where they overlap none of the base.
Stretches of more than ``MOST_TOKENS`` tokens are no examples, as training costs
grow with their length; they are decoded like all others.

Defined results: null and empty texts have no spans; patterns scan long runs of
digits, letters or signs in linear time; without any base span to learn from
nothing is added; repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codequarry.llm import kernels
from codequarry.llm.shared import schema_with, with_column, written

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CUE = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Longest stretch to train from.
MOST_TOKENS = 60
#: Tokens of a word to each side of a token that its features see.
NEAR = 12
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
LABELS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
_N = len(LABELS)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(map(int, reversed(digits))):
        total += digit if k % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(spans)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of words with a digit or at sign, one white-space character apart."""
    begin = end = -1
    for m in _WORD.finditer(text):
        if not _CUE.search(m[0]):
            continue
        if begin >= 0 and m.start() == end + 1 and text[end] == " ":
            end = m.end()
            continue
        if begin >= 0:
            yield begin, end
        begin, end = m.span()
    if begin >= 0:
        yield begin, end


def _shape(token: str) -> str:
    if token.isdigit() and token.isascii():
        return f"9x{len(token)}" if len(token) < 20 else "9x20"
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "Aa"
    return token


def tokens(text: str, begin: int, end: int) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Tokens of a stretch and the features of each."""
    places, words = [], []
    for word in _WORD.finditer(text, begin, end):
        pieces = [m.span() for m in _TOKEN.finditer(text, word.start(), word.end())]
        marks = ["9" if text[a] in "0123456789" else "a" if text[a].isalpha() else text[a] for a, _ in pieces]
        for k, place in enumerate(pieces):
            # The word around the token; the token itself is marked, so that each has its own place.
            shape = f"{''.join(marks[max(0, k - NEAR) : k])}^{''.join(marks[k : k + 1 + NEAR])}"
            places.append(place)
            words.append((shape, k == 0, k == len(pieces) - 1))
    shapes = ["<", *(_shape(text[a:b]) for a, b in places), ">"]
    rows = []
    for k, (a, b) in enumerate(places):
        before, own, after = shapes[k : k + 3]
        word, first, last = words[k]
        row = ["bias", f"s={own}", f"p={before}", f"n={after}", f"ps={before}|{own}", f"sn={own}|{after}", f"w={word}", f"ws={word}|{own}"]
        row += ["first"] * first + ["last"] * last
        row.append(f"p2={shapes[k - 1] if k else '<'}|{before}|{own}")
        if own.startswith("9x"):
            row.append(f"long={b - a >= 12}|{b - a <= 19}")
            if 12 <= b - a <= 19:
                row.append(f"check={luhn(text[a:b])}")
            if b - a <= 3:
                row.append(f"byte={int(text[a:b]) <= 255}")
        rows.append(row)
    return places, rows


def examples(text: str) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Labelled stretches of a text, and those with a span of its corrupted variant."""
    spans = base_spans(text)
    yield from labelled(text, spans)
    if spans:
        yield from (row for row in labelled(*corrupted(text, spans, len(text))) if any(row[1]))


def labelled(text: str, spans: list[Span]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Feature rows and label numbers of every stretch, labels from ``spans``."""
    for begin, end in stretches(text):
        places, rows = tokens(text, begin, end)
        marks = [0] * len(places)
        for start, kind, stop in spans:
            if start < end and stop > begin:
                inside = [k for k, (a, b) in enumerate(places) if a >= start and b <= stop]
                for k in inside:
                    marks[k] = 2 + 2 * kind
                if inside:
                    marks[inside[0]] = 1 + 2 * kind
        yield rows, marks


def corrupted(text: str, spans: list[Span], way: int) -> tuple[str, list[Span]]:
    """``text`` with each span altered so that it misses its pattern, and the spans as they then are; overlapping ones are left."""
    out, marks, at = [], [], 0
    for start, kind, end in spans:
        if start < at:
            continue
        old = text[start:end]
        if kind == 0:
            new = old.replace("@", ("(at)", "[at]")[way % 2], 1)
        elif kind == 1:
            new = old.replace(".", ",-"[way % 2])
        elif kind == 2:
            digits = re.sub(r"\D", "", old)
            new = "./"[way % 2].join(digits[k : k + 4] for k in range(0, len(digits), 4))
        else:
            new = old.lstrip("+")
        out += [text[at:start], new]
        place = sum(map(len, out)) - len(new)
        marks.append((place, kind, place + len(new)))
        at = end
    return "".join([*out, text[at:]]), marks


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Linear-chain CRF: a weight for each feature and label and for each pair of neighbouring labels."""

    def __init__(self, features: dict[str, int]):
        self.features = features
        self.weights, self.moves = np.zeros((len(features), _N)), np.zeros((_N + 1, _N))  # last row: start

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.features.get
        return np.array([self.weights[[f for f in map(get, row) if f is not None]].sum(axis=0) for row in rows])

    def fit(self, examples: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.5, penalty: float = 1e-4) -> Crf:
        """Maximise the penalised log likelihood by Adagrad over the examples in turn."""
        seen_w, seen_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        packed = [([np.array([self.features[f] for f in row]) for row in rows], np.array(marks)) for rows, marks in examples]
        for _ in range(epochs):
            for ids, marks in packed:
                n = len(marks)
                e = np.array([self.weights[i].sum(axis=0) for i in ids])
                inner = self.moves[:_N]
                ahead, back = np.empty((n, _N)), np.zeros((n, _N))
                ahead[0] = self.moves[_N] + e[0]
                for t in range(1, n):
                    ahead[t] = _logsum(ahead[t - 1][:, None] + inner, 0) + e[t]
                for t in range(n - 2, -1, -1):
                    back[t] = _logsum(inner + (e[t + 1] + back[t + 1])[None], 1)
                total = _logsum(ahead[-1], 0)
                own = np.exp(ahead + back - total)
                moves = np.zeros_like(self.moves)
                moves[_N] -= own[0]
                moves[_N, marks[0]] += 1
                for t in range(1, n):
                    moves[:_N] -= np.exp(ahead[t - 1][:, None] + inner + (e[t] + back[t])[None] - total)
                    moves[marks[t - 1], marks[t]] += 1
                own = -own
                own[np.arange(n), marks] += 1
                which = np.concatenate(ids)
                gradient = np.zeros((len(which), _N))
                gradient += np.repeat(own, [len(i) for i in ids], axis=0)
                used, place = np.unique(which, return_inverse=True)
                step = np.zeros((len(used), _N))
                np.add.at(step, place, gradient)
                step -= penalty * self.weights[used]
                moves -= penalty * self.moves
                seen_w[used] += step**2
                seen_m += moves**2
                self.weights[used] += rate * step / np.sqrt(seen_w[used])
                self.moves += rate * moves / np.sqrt(seen_m)
        return self

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """Viterbi paths of a batch of sequences of one length: (sequences, length, labels) to (sequences, length)."""
        count, length, _ = emissions.shape
        best, came = self.moves[_N] + emissions[:, 0], np.zeros((count, length, _N), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + self.moves[None, :_N]
            came[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + emissions[:, t]
        paths = np.zeros((count, length), np.int64)
        paths[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            paths[:, t - 1] = came[np.arange(count), t, paths[:, t]]
        return paths

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Labelled spans of each text; stretches of one length are decoded together."""
        waiting: dict[int, list] = defaultdict(list)
        for k, text in enumerate(texts):
            if _CUE.search(text):
                for begin, end in stretches(text):
                    places, rows = tokens(text, begin, end)
                    waiting[len(places)].append((k, places, self.emissions(rows)))
        found: list[list[Span]] = [[] for _ in texts]
        for length, group in waiting.items():
            size = max(1, 200_000 // length)
            for some in (group[i : i + size] for i in range(0, len(group), size)):
                for (k, places, _), path in zip(some, self.decode(np.array([e for *_, e in some])).tolist(), strict=True):
                    open_kind = -1
                    for (start, end), label in zip(places, path, strict=True):
                        kind = (label - 1) // 2 if label else -1
                        if label and label % 2 == 0 and kind == open_kind:
                            first, _kind, _end = found[k][-1]
                            found[k][-1] = (first, kind, end)
                        elif label:
                            found[k].append((start, kind, end))
                        open_kind = kind
        return found


def combined(base: list[Span], added: list[Span]) -> list[Span]:
    """The base and those added spans that overlap none of it."""
    out, k = list(base), 0
    reach = 0  # furthest end of base spans that start before the added one
    for span in sorted(added):
        while k < len(base) and base[k][0] < span[2]:
            reach = max(reach, base[k][2]) if base[k][0] <= span[0] else reach
            if base[k][0] > span[0]:
                break
            k += 1
        if reach <= span[0] and not (k < len(base) and base[k][0] < span[2]):
            out.append(span)
    return sorted(out)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def labelled_table(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_docs: int = 600) -> DataFrame:
    """Stretches of a bounded sample of documents of each kind with features and labels: features, labels."""
    kind = docs.schema[id].dataType.simpleString()

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 1):
            held = [sorted({k for _, k, _ in base_spans(body)}) or [len(KINDS)] if body and _CUE.search(body) else [] for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32()))], names=["id", "kinds"])

    narrow = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(kinds, f"id {kind}, kinds array<int>")
    narrow = written(narrow.where(F.size("kinds") > 0).withColumn("draw", F.xxhash64("id")))
    some = -(-sample_docs // (len(KINDS) + 1))
    of = [narrow.where(F.array_contains("kinds", k)).orderBy("draw", "id").limit(some).select(F.col("id").alias("drawn")) for k in range(len(KINDS) + 1)]
    drawn = written(reduce(DataFrame.unionByName, of).distinct())
    # About ``sample_docs`` ids at most.
    texts = docs.join(F.broadcast(drawn), F.col(id).eqNullSafe(F.col("drawn")), "left_semi").select(F.col(text).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 0):
            rows = [row for body in batch.column(0).to_pylist() for row in examples(body or "") if len(row[1]) <= MOST_TOKENS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.string()))), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                names=["features", "labels"])

    return texts.mapInArrow(label, "features array<array<string>>, labels array<int>")


def train(table: DataFrame, examples: int = 800) -> Crf | None:
    """CRF fitted to about ``examples`` different stretches of a labelled table, of each kind alike; None if none holds a span."""
    some, order = -(-examples // (len(KINDS) + 1)), (F.xxhash64("features"), "features", "labels")
    of = [F.array_contains("labels", 1 + 2 * k) for k in range(len(KINDS))]
    of.append(~reduce(Column.__or__, of))
    different = written(table.distinct())
    taken = {(tuple(map(tuple, row.features)), tuple(row.labels)): row for k in of for row in different.where(k).orderBy(*order).limit(some).collect()}
    # In an order that deals the kinds out evenly.
    rows = sorted(taken.values(), key=lambda row: crc32(repr(row).encode()))
    if not any(any(row.labels) for row in rows):
        return None
    names = dict.fromkeys(f for row in rows for token in row.features for f in token)
    return Crf({name: k for k, name in enumerate(names)}).fit([(row.features, row.labels) for row in rows])


def with_spans(docs: DataFrame, model: Crf | None, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with a struct ``name``: base and all spans as text, and the number of base spans of each kind."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    fields = [("base", pa.string()), ("spans", pa.string()), *((f"n_{kind}", pa.int64()) for kind in KINDS)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in kernels.slices(batches, at):
            texts = [body or "" for body in batch.column(at).to_pylist()]
            base = [base_spans(body) if _CUE.search(body) else [] for body in texts]
            added = crf.spans(texts) if crf else [[] for _ in texts]
            rows = []
            for own, more in zip(base, added, strict=True):
                kinds = [kind for _, kind, _ in own]
                row = {"base": as_text(own), "spans": as_text(combined(own, more))}
                rows.append(row | {f"n_{kind}": kinds.count(k) for k, kind in enumerate(KINDS)})
            yield with_column(batch, name, pa.array(rows, pa.struct(fields)))

    kind = "struct<base: string, spans: string, " + ", ".join(f"n_{k}: bigint" for k in KINDS) + ">"
    return docs.mapInArrow(find, schema_with(docs, name, kind))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
            at = end
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    model = train(written(labelled_table(rows, "doc_id", "text")))
    found = with_spans(rows, model)
    return found.select("doc_id", *(f"pii.n_{kind}" for kind in KINDS), F.sha2("pii.base", 256).alias("base_sha256"), "pii.spans")


