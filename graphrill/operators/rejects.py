"""Delimited lines with two integers: the valid ones loaded, the faulty ones kept apart with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field: quoted, with blanks around it, or unquoted without any quote. Possessive, so long lines cannot backtrack.
QUOTED = r'[ \t]*+"[^"]*+(?:""[^"]*+)*+"[ \t]*+'
FIELD = rf'(?:{QUOTED}|[^",]*+)'
#: Strictly two fields of ASCII digits, quoted or not.
DIGITS = r'[ \t]*+(?:"([0-9]++)"|([0-9]++))[ \t]*+'
PAIR = rf"\A{DIGITS},{DIGITS}\r?\z"
WELL_QUOTED = rf"\A{FIELD}(?:,{FIELD})*+\r?\z"
TWO_FIELDS = rf"\A{FIELD},{FIELD}\r?\z"
MOST = "9223372036854775807"


def _value(line: Column, first: int) -> Column:
    """Digits of a field of a PAIR without leading zeros, or '0'."""
    digits = F.concat(F.regexp_extract(line, PAIR, first), F.regexp_extract(line, PAIR, first + 1))
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(bare) > 0, bare).otherwise(F.lit("0"))


def _fits(digits: Column) -> Column:
    return (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= MOST))


def strict_load(raw: DataFrame, line: str = "raw_line", offset: str = "record_id") -> DataFrame:
    """(offset, c0, c1) of the lines that are exactly two valid integers; all else is left out.

    One carriage return at the end belongs to the line end. Only the built-in regular expressions run.
    """
    text = F.col(line)
    pairs = raw.where(text.rlike(PAIR)).select(offset, _value(text, 1).alias("c0"), _value(text, 3).alias("c1"))
    return pairs.where(_fits(F.col("c0")) & _fits(F.col("c1"))).select(offset, F.col("c0").cast("bigint").alias("c0"), F.col("c1").cast("bigint").alias("c1"))


def diagnose(line: Column) -> Column:
    """The first reason that holds for a line that is not valid; a null line counts as an empty one."""
    line = F.coalesce(line, F.lit(""))
    # Without its line end: a lone carriage return would otherwise count as content of the last unquoted field.
    line = F.regexp_replace(line, r"\r\z", "")
    return (
        F.when(~line.rlike(WELL_QUOTED), "broken_quoting")
        .when(~line.rlike(TWO_FIELDS), "column_count")
        .otherwise("invalid_value")
    )


def split_lines(raw: DataFrame, line: str = "raw_line", offset: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The valid pairs (offset, c0, c1), and the faulty lines (offset, reason) as the raw offsets less the loaded ones.

    ``offset`` is unique and not null. Repeated lines with offsets of their own are all kept. Every line is in exactly one
    of the two results; an empty table gives two empty ones. Other columns play no part.
    """
    valid = strict_load(raw, line, offset)
    rest = raw.select(offset, line).join(valid.select(offset), offset, "left_anti")
    return valid, rest.select(offset, diagnose(F.col(line)).alias("reason"))
