"""Column helpers that the operators on texts share; all of them stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII blanks; no element is empty."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def bit_sums(hashed: Column, name: str) -> list[Column]:
    """Aggregates that count the set bits of a 64-bit column, two counters to a sum.

    Sum ``j`` adds bit ``j`` in its low half and bit ``j + 32`` in its high half, so 32
    additions a row count all 64 bits; a half is full only after 2^32 rows.
    """
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(pair)).alias(f"{name}{j}") for j in range(32)]


def bit_count_of(name: str, bit: int) -> Column:
    """The count of one bit out of the sums that ``bit_sums`` made."""
    packed = F.col(f"{name}{bit % 32}")
    return F.shiftrightunsigned(packed, 32) if bit >= 32 else packed.bitwiseAND(F.lit((1 << 32) - 1))
