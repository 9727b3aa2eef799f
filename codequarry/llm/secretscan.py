"""Secrets in every historical version of every path, by an incremental ledger of content-addressed blobs.

A version's text is its blob, addressed by SHA-256. The ledger is an append-only
Parquet table with one row per blob and rule version that was ever scanned, and
the spans found. An update looks up which pairs the ledger lacks, fetches one
text of each blob that has such pairs, scans it by just the missing rules and
appends the findings. Findings are then joined back to all paths and versions of
each blob. A second run over the same history scans nothing, a new version scans
one blob, and a rule of a new version scans every blob by that rule alone.

Copies are folded before their text crosses the shuffle. Blobs with more than a
thousandth of all versions, of which there are at most a thousand, are joined
back by broadcast, so that a copy on a third of all paths fills no task.

Defined results: a null text is the empty blob; empty texts have no spans;
repeated rows give equal results; an empty history leaves the ledger as it is;
texts and matches may be of any length, as all patterns scan in linear time. Two
updates at a time may both append a pair; their rows are equal and count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry.llm import kernels
from codequarry.llm.shared import shared_folder, written
from codequarry.sources.scratch import file_system


class Rule(NamedTuple):
    """A pattern under a name; a match counts if ``group`` has ``least`` characters. Raise ``version`` with every change."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The base kinds in their order.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
        + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12,
    ),
    # A match of these that is too short is a whole run, so the length can be part of the pattern.
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)

#: Forms that issuers document, in addition to the base.
ADDED = (
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abpr]-[0-9A-Za-z-]{20,}"),
)

LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def finder(rule: Rule):
    """Function from a text to the rule's spans, leftmost and not overlapping, in code points."""
    compiled, group, least = re.compile(rule.pattern), rule.group, rule.least

    def find(text: str) -> list[dict]:
        return [{"start": m.start(), "end": m.end()} for m in compiled.finditer(text) if m.end(group) - m.start(group) >= least]

    return find


def blob_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class Ledger:
    """The table of scanned pairs at ``location``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def entries(self) -> DataFrame:
        """blob, rule, version, spans; one row per pair."""
        return self._stored().dropDuplicates(["blob", "rule", "version"])

    def _stored(self) -> DataFrame:
        system, path = file_system(self.spark, self.location)
        if not system.exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.location)

    def pending(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """Blobs that some rule has not scanned: blob, todo (names of those rules)."""
        scanned = self._of(rules).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        every = F.array(*(F.lit(rule.name) for rule in rules))
        todo = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done"))
        return blobs.select("blob").join(scanned, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)

    def update(self, texts: DataFrame, blobs: DataFrame, rules: Sequence[Rule]) -> None:
        """Scan what is pending of ``blobs``; ``texts`` (blob, text) holds the text of each at least once."""
        pending = written(self.pending(blobs, rules))
        if pending.isEmpty():
            return
        # The semi join, if it can be broadcast, runs before the fold: then only pending texts move.
        one = texts.join(pending.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        found = one.join(pending, "blob").select("blob", "todo", "text").mapInArrow(_scanner(rules), LEDGER)
        found.write.mode("append").parquet(self.location)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """Blobs with spans: blob, found (array of start, order of the rule, end; sorted)."""
        order = F.create_map(*(F.lit(v) for k, rule in enumerate(rules) for v in (rule.name, k)))
        ordered = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order"), s["end"].alias("end")))
        # Most pairs have no spans and are left out before anything is shuffled.
        some = self._of(rules).where(F.size("spans") > 0).dropDuplicates(["blob", "rule"]).withColumn("order", order[F.col("rule")])
        # One list per rule and blob, so no more lists than rules meet.
        return some.select("blob", ordered.alias("own")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("found"))

    def _of(self, rules: Sequence[Rule]) -> DataFrame:
        """Stored rows of these rules in their versions; a pair may occur twice."""
        versions = F.create_map(*(F.lit(v) for rule in rules for v in (rule.name, rule.version)))
        return self._stored().where(versions[F.col("rule")] == F.col("version"))


def _scanner(rules: Sequence[Rule]):
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {rule.name: (finder(rule), rule.version) for rule in rules}
        for batch in kernels.slices(batches, 2):
            rows = [
                (blob, name, find[name][1], find[name][0](text or ""))
                for blob, todo, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for name in todo
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), _SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["blob", "rule", "version", "spans"])

    return scan


def scan_history(
    history: DataFrame, ledger: Ledger, keys: Sequence[str], text: str = "text", rules: Sequence[Rule] = (*BASE, *ADDED)
) -> DataFrame:
    """Findings of every version after bringing the ledger up to date: ``keys``, blob, found.

    ``keys`` are the columns that name a path and its version. ``found`` is an
    array of (start, order of the rule, end) by start, then rule.
    """
    texts = history.select(blob_of(text).alias("blob"), F.col(text).alias("text"))
    keyed = [F.col(key).alias(f"key{k}") for k, key in enumerate(keys)]
    named = written(history.select(*keyed, blob_of(text).alias("blob")))
    blobs = written(named.groupBy("blob").agg(F.count("*").alias("versions")))
    ledger.update(texts, blobs, rules)

    found = written(ledger.findings(rules))
    total = named.count()
    # Fewer than a thousand blobs can each have more than a thousandth of all versions.
    hot = F.broadcast(written(blobs.where(F.col("versions") * 1000 > total).select("blob")))
    few = F.broadcast(found.join(hot, "blob", "left_semi"))
    back = named.join(hot, "blob", "left_semi").join(few, "blob", "left").unionByName(
        named.join(hot, "blob", "left_anti").join(found, "blob", "left"))
    none = F.array().cast("array<struct<start: int, order: int, end: int>>")
    return back.select(
        *(F.col(f"key{k}").alias(key) for k, key in enumerate(keys)), "blob", F.coalesce("found", none).alias("found"))


def as_text(found: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*(F.lit(rule.name) for rule in rules))
    one = F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Without a ``ledger`` a new one in the shared folder is used.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, f"{shared_folder(spark)}/ledger")
    rules = (*BASE, *ADDED)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    back = scan_history(rows, ledger, ["doc_id"], "text", rules)
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    orders = F.transform("found", lambda s: s["order"])
    counts = [(F.size("found") - F.size(F.array_remove(orders, k))).cast("bigint").alias(f"n_{rule.name}") for k, rule in enumerate(BASE)]
    return back.select("doc_id", *counts, F.sha2(as_text(base, rules), 256).alias("base_sha256"), as_text(F.col("found"), rules).alias("spans"))
