"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

A text is the multiset of its runs of five words (ASCII letters lowered); a
shingle's weight is how often it occurs. Each shingle is a Poisson process with
its weight as rate, whose arrivals fall on uniformly drawn components of the
signature; a component keeps its earliest arrival's shingle. A shingle stops
as soon as its next arrival is later than all that the components have. Two
signatures agree in a component with the probability Jaccard similarity.

Texts of equal words are one node from the start. Nodes that share a band of
``rows`` components meet in a bucket; each is paired with two pseudo-random
members of it, the same ones in buckets of the same members. Pairs whose signatures agree often
enough are verified on their exact shingles: first the most alike of each node, then all that
still lie between different components. Members of buckets that hold several components even then
are paired with a neighbour of another component, another one in each bucket, and verified
likewise, so a bucket of n nodes gives at most 3n pairs. With 24 bands of 4 rows a
pair at similarity 0.8 shares no bucket with probability 3e-6.

That joins nearly all members of a bucket. Members of buckets that still hold
several components are then joined on their shingles by prefixes: all texts order
their shingles alike, rare ones first, and two texts whose similarity is at least
``least`` share one among the first of each, up to a share of 1 - ``least`` of its
shingles or of their weight. (Of the linked texts' shingles, or of their weight, at
least the share ``least`` is common, so no more precedes the first common one.) A
shared passage is frequent and comes last, so it makes no candidates. Texts that
share a prefix shingle are compared in blocks, every one outside the shingle's
largest component with all: first by signatures, which leave of each prefix shingle
the members with a partner that agrees often enough and shares no smaller prefix
shingle, then exactly. A block gives members or links that join its components, not
pairs, so its output is linear in its members. Frequencies come from ``CELLS`` counters, whatever the number of shingles;
their errors change the order, which is the same for all texts, but lose no link.

Two texts are linked if their Jaccard similarity, weighted or plain, is at least
``similarity``; classes are the components of links.

Defined results: texts without words are one class; texts of one to four words
are one shingle; the class id is the smallest doc_id of the class, null only if
all are null; repeated rows are in one class, and ``deduplicated`` keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codequarry.llm import kernels
from codequarry.llm.graph import merged
from codequarry.llm.shared import counted, free_name, schema_with, shared_folder, with_column, written

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Shingles on a side of a block; one text may hold more. A signature counts as many as it has components.
BLOCK = 1 << 18
#: Counters of shingle frequencies.
CELLS = 1 << 19
#: How much less often than ``least`` signatures of a pair worth verifying may agree.
_MARGIN = 0.25
_SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, by row: rows, hashes, counts; and a hash of each row's words."""
    data = _LOWER[data]
    rows, starts, ends = kernels.words(data, bounds)
    codes = kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends)
    n = len(bounds) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    keys = kernels.span_hashes(codes, first[:-1], first[1:]) if len(codes) else np.zeros(n, _U)
    at = np.arange(max(0, len(codes) - SIZE + 1))
    at = at[rows[at] == rows[at + SIZE - 1]] if len(at) else at
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SIZE))
    begin, end = np.concatenate((at, first[short])), np.concatenate((at + SIZE, first[short + 1]))
    row = rows[begin] if len(begin) else begin
    hashes = kernels.span_hashes(codes, begin, end) if len(begin) else np.zeros(0, _U)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(new)
    return row[heads], hashes[heads], np.diff(np.append(heads, len(row))), keys


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures of ``n`` rows; rows without shingles have zeros."""
    earliest, signature = np.full(n * m, np.inf), np.zeros(n * m, _U)
    time, active, arrival = np.zeros(len(rows)), np.arange(len(rows)), 0
    rates = counts.astype(np.float64)
    while len(active):
        arrival += 1
        draw = kernels.mix(hashes[active] + _U(arrival * 0xD1B54A32D192ED03 % (1 << 64)))
        # Exponential waiting time from the upper 53 bits, component from another mix.
        time[active] -= np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rates[active]
        slot = rows[active] * m + (kernels.mix(draw) % _U(m)).astype(np.int64)
        np.minimum.at(earliest, slot, time[active])
        won = earliest[slot] == time[active]
        signature[slot[won]] = hashes[active[won]]
        latest = earliest.reshape(n, m).max(axis=1)
        active = active[time[active] < latest[rows[active]]]
    return signature.reshape(n, m)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """Hash of each band of each row, different for each band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(kernels.mix(np.arange(1, BANDS + 1, dtype=_U)), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = kernels.mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, key of the words, band hashes, a byte of each component); no bands without words."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 1, _SLICE):
            n = len(batch)
            rows, hashes, counts, keys = shingles(*kernels.buffer(batch.column(1)))
            signature = signatures(rows, hashes, counts, n)
            bands = band_hashes(signature).view(np.int64)
            some = np.zeros(n, bool)
            some[rows] = True
            offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            bytes_ = np.ascontiguousarray((signature >> _U(17)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel())),
                 pa.array([row.tobytes() for row in bytes_], pa.binary())],
                names=["id", "key", "bands", "bytes"])

    return docs.mapInArrow(sketch, f"id {kind}, key bigint, bands array<bigint>, bytes binary")


def _keyed(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the hash of each text's words."""
    at = docs.columns.index(text)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, at, _SLICE):
            data, bounds = kernels.buffer(batch.column(at))
            data = _LOWER[data]
            rows, starts, ends = kernels.words(data, bounds)
            codes = kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends)
            first = np.searchsorted(rows, np.arange(len(bounds)))
            keys = kernels.span_hashes(codes, first[:-1], first[1:]) if len(codes) else np.zeros(len(batch), _U)
            yield with_column(batch, name, pa.array(keys.view(np.int64)))

    return docs.mapInArrow(key, schema_with(docs, name, "bigint"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in a common bucket, a above b: of each node and the two drawn members."""
    rows = nodes.select("key", F.explode("bands").alias("bucket"))
    # Of one draw in all buckets, so that nodes that share many of them are paired with few heads.
    drawn = F.struct(F.xxhash64("key").alias("draw"), "key")
    heads = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(drawn).alias("low"), F.max(drawn).alias("high")).where("n > 1")
    met = rows.join(heads.select("bucket", F.col("low.key").alias("low"), F.col("high.key").alias("high")), "bucket")
    return _pairs(met.select("key", F.explode(F.array("low", "high")).alias("other")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.where("other <> key").select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b")).distinct()


def _beside(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours with different labels among the members (bucket, key, label) of a bucket, a above b."""
    # Some more orders than one: neighbours among the members of a bucket that its draw deals to one of its parts.
    part = F.pmod(F.xxhash64("bucket", "key"), F.lit(64))
    beside = F.lag(F.struct("key", "label")).over(Window.partitionBy("bucket", "part").orderBy("key"))
    paired = met.withColumn("part", part).withColumn("beside", beside).where("label <> beside.label")
    return _pairs(paired.select("key", F.col("beside.key").alias("other")))


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share ``least`` of components, with that share."""
    of = lambda side: nodes.select(F.col("key").alias(side), F.col("bytes").alias(f"{side}_bytes"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), -1) for k in (2, 3))
            share = (a == b).mean(axis=1)
            good = np.flatnonzero(share >= least)
            some = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(share[good])], names=["a", "b", "share"])

    return joined.select("a", "b", "a_bytes", "b_bytes").mapInArrow(agree, "a bigint, b bigint, share double")


def _open_members(met: DataFrame, paired: int) -> DataFrame:
    """(bucket, key, label) of buckets with several labels and more than ``paired`` members, with their size.

    Buckets that were paired need no search up to three members: both drawn ones met all others. Those of prefixes were not paired.
    """
    open_ = met.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return met.join(open_.where((F.col("size") > paired) & (F.col("low") != F.col("high"))).select("bucket", "size"), "bucket")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Sums of ``CELLS`` counters: in how many of the sets the shingles of each occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)), minlength=CELLS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], names=["cell", "n"])

    sums = sets.select("hashes").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint32(CELLS)).astype(np.int64)


def prefix(hashes: np.ndarray, counts: np.ndarray, frequencies: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a multiset in the common order that a multiset of similarity ``least`` may share first.

    Shingles that no other multiset holds are left out.
    """
    often = frequencies[_cells(hashes)]
    order = np.lexsort((hashes, often))
    weight = counts[order].astype(np.float64)
    slack = 1 - least + 1e-9
    first = (np.arange(len(order)) <= slack * len(order)) | (np.cumsum(weight) - weight <= slack * weight.sum())
    return hashes[order[first & (often[order] > 1)]]


def _prefix_buckets(sets: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(bucket, key, label): the prefix shingles of each member (key, label)."""
    frequencies = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            found = [prefix(np.frombuffer(h, np.uint32), np.frombuffer(c, np.uint32), frequencies.value, least) for h, c in packed]
            row = np.repeat(np.arange(len(batch)), [len(f) for f in found])
            buckets = np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int64)
            some = batch.select([0, 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *some.columns], names=["bucket", "key", "label"])

    return members.join(sets, "key").select("key", "label", "hashes", "counts").mapInArrow(cut, "bucket bigint, key bigint, label bigint")


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (bucket, key, label) of each block (bucket, row, column), odd or not; ``sizes`` has the size of each key."""
    of_label = members.join(sizes, "key").groupBy("bucket", "label").agg(F.sum("size").alias("n"))
    usual = of_label.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("usual"), (F.sum("n") - F.max("n")).alias("odd"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = members.join(usual, "bucket").withColumn("rows", blocks("all")).withColumn("columns", blocks("odd"))
    draw = F.xxhash64("key", "bucket")
    # A block compares some of the odd members, its columns, with some of all members, its rows.
    row, column = F.pmod(draw, F.col("rows")).cast("int"), F.pmod(F.xxhash64(draw), F.col("columns")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    kept = ("bucket", "key", "label")
    as_rows = dealt.select(*kept, F.lit(False).alias("odd"), row.alias("row"), F.explode(every("columns")).alias("column"))
    as_columns = dealt.where("label <> usual").select(
        *kept, F.lit(True).alias("odd"), column.alias("column"), F.explode(every("rows")).alias("row"))
    return as_rows.unionByName(as_columns)


def _promising(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Members (bucket, key, label) with a partner of another label there.

    Signatures of partners agree in at least the share ``least``, and they meet in no smaller bucket.
    """
    signed = nodes.join(members.groupBy("key").agg(F.collect_list("bucket").alias("others")), "key").select("key", "bytes", "others")
    sizes = signed.select("key", (F.length("bytes") + F.size("others")).alias("size"))

    def compare(block: pa.Table) -> pa.Table:
        odd, keys, labels = (block.column(c).to_numpy() for c in ("odd", "key", "label"))
        bucket = block.column("bucket")[0].as_py()
        parts = np.frombuffer(b"".join(block.column("bytes").to_pylist()), np.uint8).reshape(len(keys), -1)
        lists = block.column("others").combine_chunks()
        smaller, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy())
        smaller, owner = smaller[smaller < bucket], owner[smaller < bucket]
        bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
        universe, place = np.unique(smaller, return_inverse=True)
        mine, good = np.zeros(len(universe)), np.zeros(len(keys), bool)
        for k in np.flatnonzero(odd):
            own = place[bounds[k] : bounds[k + 1]]
            mine[own] = 1
            earlier = np.bincount(owner, mine[place], len(keys))
            mine[own] = 0
            near = ~odd & (labels != labels[k]) & (earlier == 0) & ((parts == parts[k]).mean(axis=1) >= least)
            good |= near
            good[k] = near.any()
        return pa.table({"bucket": np.full(good.sum(), bucket), "key": keys[good], "label": labels[good]})

    held = _blocks(members, sizes).join(signed, "key")
    return held.groupBy("bucket", "row", "column").applyInArrow(compare, "bucket bigint, key bigint, label bigint").distinct()


def _searched(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the labels which links between members of a bucket join."""

    def compare(block: pa.Table) -> pa.Table:
        odd, keys = block.column("odd").to_numpy(), block.column("key").to_numpy()
        packed = zip(block.column("hashes").to_pylist(), block.column("counts").to_pylist(), strict=True)
        found = joining([(np.frombuffer(h, np.uint32), np.frombuffer(c, np.uint32)) for h, c in packed], odd, block.column("label").to_numpy(), least)
        a, b = (keys[[pair_[k] for pair_ in found]] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held = _blocks(members, sets.select("key", (F.length("hashes") / 4).alias("size"))).join(sets, "key")
    return held.groupBy("bucket", "row", "column").applyInArrow(compare, "a bigint, b bigint")


def joining(sets: list[tuple[np.ndarray, np.ndarray]], odd: np.ndarray, labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Linked pairs of an odd multiset and another one that join labels, no more than labels joined."""
    rows, out = np.flatnonzero(~odd), []
    if not len(rows):
        return out
    _, component = np.unique(labels, return_inverse=True)
    sizes = np.array([len(sets[r][0]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    universe, place = np.unique(np.concatenate([sets[r][0] for r in rows]), return_inverse=True)
    shares = np.concatenate([sets[r][1] / sets[r][1].sum() for r in rows])
    repeats = np.array([sets[r][1].max() > 1 for r in rows])
    mine = np.zeros(len(universe))
    for k in np.flatnonzero(odd):
        hashes, counts = sets[k]
        at = np.searchsorted(universe, np.unique(hashes))
        at = at[(at < len(universe))]
        at = at[np.isin(universe[at], hashes)]
        mine[at] = 1
        held = mine[place]
        common = np.add.reduceat(held, starts)
        plain = common / (sizes + len(hashes) - common) >= least
        # Common shingles hold at least the similarity's share of each weight.
        maybe = ~plain & (repeats | (counts.max() > 1)) & (np.add.reduceat(held * shares, starts) >= least - 1e-9)
        mine[at] = 0
        for r, sure in [(r, True) for r in np.flatnonzero(plain)] + [(r, False) for r in np.flatnonzero(maybe)]:
            other, own = component[rows[r]], component[k]
            if other != own and (sure or similarity(sets[rows[r]], sets[k]) >= least):
                component[component == other] = own
                out.append((k, rows[r]))
    return out


def _open_buckets(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, key, label) of the buckets that still hold several labels."""
    labelled = nodes.where(F.size("bands") > 0).join(labels.withColumnRenamed("node", "key"), "key")
    return _open_members(labelled.select(F.explode("bands").alias("bucket"), "key", "label"), paired=3).drop("size")


def _rest(nodes: DataFrame, labels: DataFrame, rows: DataFrame, least: float, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join the components which still meet in a bucket. ``known`` has the shingle sets of all of them."""
    members, n = counted(_open_buckets(nodes, labels).select("key", "label").distinct(), folder, "open")
    if not n:
        return members.toDF("a", "b")
    if known is None:
        known = written(_shingle_sets(rows, nodes.join(members, "key", "left_semi").select("key", "id")), folder, "open-sets")
    sets = known.join(members, "key", "left_semi")
    buckets = written(_prefix_buckets(sets, members, least), folder, "prefixes")
    shared = written(_open_members(buckets, paired=1).drop("size"), folder, "open-prefixes")
    promising = written(_promising(shared, nodes, least - _MARGIN), folder, "promising")
    return _searched(promising, sets, least)


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingles and counts of one document of each wanted (key, id), as packed arrays."""
    texts = docs.join(wanted.select(F.col("id").alias("wanted")).distinct(), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 0, _SLICE):
            rows, hashes, counts, keys = shingles(*kernels.buffer(batch.column(0)))
            cut = np.searchsorted(rows, np.arange(len(batch) + 1))
            small = (hashes >> _U(32)).astype(np.uint32)
            packed = [(small[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                names=["key", "hashes", "counts"])

    found = texts.mapInArrow(sets, "key bigint, hashes binary, counts binary")
    return found.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the plain and the probability Jaccard similarity of two multisets (hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    # Sets come sorted, which the stable sort finds out in one pass.
    order = np.argsort(b[0], kind="stable")
    at = np.searchsorted(b[0], a[0], sorter=order)
    at[at == len(b[0])] = 0
    at = order[at]
    i = np.flatnonzero(b[0][at] == a[0])
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if a[1].max() == b[1].max() == 1:
        return plain
    x, y = a[1][i].astype(np.float64), b[1][at[i]].astype(np.float64)
    # J_P = sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d). Sorted by x/y, each inner sum is two prefix sums.
    ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    xs, ys = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    # For e with x_e / y_e above x_d / y_d the first term is the larger one.
    above = np.searchsorted(ratio, ratio, "right")
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    inner = (xs[-1] - xs[above] + only_a) / x + (ys[above] + only_b) / y
    return max(plain, float((1 / inner).sum()))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs whose exact similarity is at least ``least``."""
    of = lambda s: sets.select(F.col("key").alias(s), F.col("hashes").alias(f"{s}_h"), F.col("counts").alias(f"{s}_c"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_h", "a_c", "b_h", "b_c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)
            good = []
            for k, packed in enumerate(sides):
                ah, ac, bh, bc = (np.frombuffer(part, np.uint32) for part in packed)
                if similarity((ah, ac), (bh, bc)) >= least:
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return joined.mapInArrow(verify, "a bigint, b bigint")


def _with_label(pairs: DataFrame, labels: DataFrame, side: str) -> DataFrame:
    return pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per distinct (id, words): id, key, class_id, keep_key. ``keep_key`` is the key of the document that stays."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sketches = written(_sketches(rows), folder, "sketches")
    nodes = written(
        sketches.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")),
        folder, "nodes")
    pairs = written(_alike(_candidates(nodes.where(F.size("bands") > 0)), nodes, least - _MARGIN), folder, "pairs")
    each = nodes.select(F.col("key").alias("node"), F.col("key").alias("label"))
    # The most alike partner of each node settles most.
    most = F.max_by("b", "share").alias("b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(_shingle_sets(rows, nodes.join(ends, "key", "left_semi").select("key", "id")), folder, "sets")
    best = pairs.groupBy("a").agg(most)
    labels = merged(each, _verified(best, sets, least), folder, "best-labels")
    apart = _with_label(_with_label(pairs.join(best, ["a", "b"], "left_anti"), labels, "a"), labels, "b")
    labels = merged(labels, _verified(apart.where("a_label <> b_label").select("a", "b"), sets, least), folder, "met-labels")
    # That settles most buckets; only members of the others are paired with their neighbours.
    met, n = counted(_open_buckets(nodes, labels), folder, "met")
    if n:
        more = nodes.join(met.select("key"), "key", "left_semi").join(sets.select("key"), "key", "left_anti")
        sets = sets.unionByName(written(_shingle_sets(rows, more.select("key", "id")), folder, "more-sets"))
        near = _alike(_beside(met), nodes, least - _MARGIN).join(pairs, ["a", "b"], "left_anti")
        labels = merged(labels, _verified(near, sets, least), folder, "beside-labels")
        labels = merged(labels, _rest(nodes, labels, rows, least, folder, sets), folder, "searched-labels")
    node_class = nodes.select("key", "id").join(labels.withColumnRenamed("node", "key"), "key")
    heads = node_class.groupBy("label").agg(F.min("id").alias("class_id"), F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("keep_key"))
    of_key = written(node_class.join(heads, "label").select("key", "class_id", "keep_key"), folder, "classes")
    return sketches.select("id", "key").join(of_key, "key").select("id", "key", "class_id", "keep_key")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, class_id."""
    return classes(docs, id, text).select(F.col("id").alias("doc_id"), "class_id")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id."""
    found = classes(docs, id, text)
    key, keep, keep_id, turn = (free_name(docs.columns, n) for n in ("words_key", "keep_key", "keep_id", "turn"))
    stays = found.where("key = keep_key and id <=> class_id").select(
        F.col("key").alias(keep), F.col("class_id").alias(keep_id)).distinct()
    on = (F.col(key) == F.col(keep)) & F.col(id).eqNullSafe(F.col(keep_id))
    first = F.row_number().over(Window.partitionBy(key).orderBy(id, text))
    return _keyed(docs, text, key).join(stays, on).withColumn(turn, first).where(F.col(turn) == 1).select(*docs.columns)
