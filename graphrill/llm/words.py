"""Words of a text, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """``text`` in NFC, lower case; null counts as empty. NFC is a static method of a library that ships with Spark."""
    return F.lower(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def words(text: Column) -> Column:
    """The maximal runs of letters and digits (Unicode L and N), an empty array if there are none."""
    return F.regexp_extract_all(normal(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashes(tokens: Column) -> Column:
    """64-bit hashes of the strings in ``tokens``."""
    return F.transform(tokens, lambda w: F.xxhash64(w))
