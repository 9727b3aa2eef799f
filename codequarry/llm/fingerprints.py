"""Document fingerprints: bottom-k sketches of hashed word shingles, in Spark's own functions.

A sketch is the sorted array of the ``k`` smallest distinct 63-bit hashes of a
text's shingles of five words. Sketches of parts merge into that of the whole
(``merged``), and two of them estimate resemblance, containment and the number
of distinct shingles. A text with fewer distinct shingles than ``k`` has all of
them in its sketch, and its estimates are exact.

Defined results: a text of one to four words is one shingle; a null or blank
text has an empty sketch, which resembles an empty one by 1 and others by 0;
equal texts have equal fingerprints, also with ties and repeated rows; rows of
equal id follow each other by the hash of their texts; null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 128
_TOP = (1 << 63) - 1
_GAPS = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, size: int = 5) -> Column:
    """63-bit hashes of all runs of ``size`` words."""
    words = F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), ""), lambda w: F.xxhash64(w))

    def hashed(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(codes) - size)
        runs = F.transform(starts, lambda i: F.xxhash64(*(F.get(codes, i + j) for j in range(size))).bitwiseAND(_TOP))
        short = F.array(F.xxhash64(codes).bitwiseAND(_TOP))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(codes) >= size, runs).when(F.size(codes) > 0, short).otherwise(none)

    return let(words, hashed)


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return sketch(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the union's sketch that both have."""
    both = let(merged(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, among those hashes both sketches reach; 1 if a has none."""
    reach = F.least(*(F.when(F.size(s) < k, _TOP).otherwise(F.element_at(s, -1)) for s in (a, b)))
    part = let(reach, lambda r: let(F.filter(a, lambda x: x <= r), lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(s, b)) / F.size(s))))
    return F.when(F.size(a) == 0, 1.0).otherwise(part)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    estimate = (k - 1) * float(_TOP) / F.element_at(a, -1).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(estimate)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ".")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K) -> DataFrame:
    """``docs`` with the sketch of a text column; no shuffle."""
    return docs.withColumn(name, sketch(shingles(F.col(text)), k))


def _place(id: Column, bounds: Column, n: int) -> Column:
    """Number of sorted ``bounds`` below ``id``, by binary search; 0 for null."""
    steps = [1 << bit for bit in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) < id), at + step).otherwise(at),
    )


def dealt_by_id(rows: DataFrame, ranges_per_partition: int = 8) -> tuple[DataFrame, Window]:
    """Rows (id, text) dealt so that a window finds the next row in descending id; the last is followed by the first.

    Rows are dealt into ranges of ids, each sorted on its own. A range also gets
    a copy of the row that heads the following range, so texts cross one
    shuffle and no task sees more than a few ranges. Drop rows with ``is_copy``.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * ranges_per_partition
    quantiles = F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)
    bounds = sorted(set(rows.select(quantiles.alias("q")).first().q or []))
    literal = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    placed = rows.select(
        "id", "text", F.xxhash64("text").alias("tie"), _place(F.col("id"), literal, len(bounds)).alias("range"),
    )
    heads = placed.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head"))
    order = Window.orderBy(F.desc("range"))
    following = heads.select(
        "range", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"),
    ).select(F.col("range").alias("before"), F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    same = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    # One row of three numbers for each of a fixed number of ranges.
    copies = placed.join(F.broadcast(following), same).select(
        "id", "text", "tie", F.col("before").alias("range"), F.lit(True).alias("is_copy"))
    within = Window.partitionBy("range").orderBy("is_copy", F.desc_nulls_last("id"), F.desc("tie"), F.desc("text"))
    return placed.withColumn("is_copy", F.lit(False)).unionByName(copies).repartition("range"), within


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third replaced by as much of the beginning of
    the next document's text, in descending order of id.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt, within = dealt_by_id(rows)
    sketched = fingerprints(dealt, "text", "sketch", k)
    following = F.lead(F.struct("text", "sketch")).over(within)
    paired = sketched.withColumn("next", following).where(~F.col("is_copy"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = (
        paired.withColumn("n_chars", F.char_length("text").cast("bigint"))
        .withColumn("edited", F.concat(
            F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
            F.substring(F.col("next.text"), F.lit(1), third)))
        .withColumn("edited_sketch", sketch(shingles(F.col("edited")), k))
    )
    own, other = F.col("sketch"), F.col("edited_sketch")
    return edited.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"), resemblance(own, F.col("next.sketch"), k).alias("near_next"),
        containment(own, other, k).alias("contained_in_edited"), distinct_count(own, k).alias("distinct_shingles"),
    )
