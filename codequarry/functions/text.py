"""Expressions on file content and decoded text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sample size, control bytes and ratio of the binary test.
SNIFF_BYTES = 8192
CONTROL_BYTES = "".join(map(chr, [*range(0, 9), 11, 12, *range(14, 32)]))
CONTROL_RATIO = 0.30


def decode_text(content: Column) -> Column:
    """UTF-8 text of binary content; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def looks_binary(content: Column) -> Column:
    """True when the first bytes hold a NUL or too many control bytes.

    One regex scan settles files without control bytes, which are most; only
    the others are counted, in ISO-8859-1, where every byte is a character.
    """
    sample = F.substring(content, 1, SNIFF_BYTES)
    by_byte = F.decode(sample, "ISO-8859-1")
    control = F.length(by_byte) - F.length(F.regexp_replace(by_byte, f"[{CONTROL_BYTES}]+", ""))
    return (
        F.when(~F.rlike(sample.cast("string"), F.lit(f"[{CONTROL_BYTES}]")), False)
        .when(F.contains(sample, F.lit(b"\0")), True)
        .otherwise(control / F.octet_length(sample) > CONTROL_RATIO)
    )


def text_hash(text: Column) -> Column:
    """SHA-256 in hex of the text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def line_count(text: Column) -> Column:
    """Newlines, plus one for a last line without one."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when(text.endswith("\n"), 0).otherwise(1)).cast("bigint")
