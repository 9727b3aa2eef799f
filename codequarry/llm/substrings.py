"""Substring dedup over words: Rabin-Karp hashes of every window of 20 words, repeated windows merged into intervals.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every window is hashed in every text;
``repeats`` says how their counting is kept within a small multiple of the
corpus. Hashes have 64 bits, and windows that are settled by group need two of
them to be equal.

Defined results: null and blank texts have no words; texts of fewer words than a
window keep all; rows of equal id and text are one document; rows of equal id
and different texts are ordered by the hash of the text; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import kernels, repeats

WINDOW, GRAM = 20, 8


def word_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, starts, ends = kernels.words(data, bounds)
    return rows, kernels.span_hashes(kernels.BYTE_CODES[data], starts, ends)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256, and the kept text."""
    scheme = repeats.Scheme(window, gram, word_codes)
    rows = repeats.identified(docs, id, text)
    spans = repeats.repeated_spans(rows, scheme, lambda dealt, groups: repeats.compare_windows(dealt, groups, scheme))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 2):
            out = []
            for body, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (body or "").encode().split()  # on just the white space above
                kept = words
                if places:
                    gone = repeats.covered(places, window, len(words))
                    kept = [word for word, out_ in zip(words, gone, strict=True) if not out_]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), sha256(joined).hexdigest(), joined.decode()))
            n, removed, digest, texts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(texts, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = spans.mapInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return done.withColumn("id", repeats.original_id(F.col("id")))


def digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
