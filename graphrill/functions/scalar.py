"""Scalar functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _utc(text: Column, pattern: str) -> Column:
    """Epoch seconds of a text with an offset, whatever the session's time zone."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))


def compact(seconds: Column) -> Column:
    """Epoch seconds as the number YYYYMMDDHHMMSS in UTC; by arithmetic, so the session's time zone plays no part."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    date = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    clock = F.floor(rest / 3600) * 10000 + F.floor(rest % 3600 / 60) * 100 + rest % 60
    return (date.cast("bigint") * 1_000_000 + clock).cast("bigint")


def ttr_time(text: Column) -> Column:
    """'Mon Sep 24 03:35:21 +0000 2012' or 'Sun, 28 Oct 2012 17:32:08 +0000' as YYYYMMDDHHMMSS; null for other texts."""
    # The weekday says nothing that the date does not.
    bare = F.regexp_replace(text, r"^\w{3},? ", "")
    return compact(F.coalesce(_utc(bare, "MMM d HH:mm:ss Z yyyy"), _utc(bare, "d MMM yyyy HH:mm:ss Z")))


def flow_time(date: Column, clock: Column) -> Column:
    """'2012-10-28' and '17:32:08.123' as YYYYMMDDHHMMSS."""
    return F.concat(F.regexp_replace(date, r"\D", ""), F.regexp_replace(F.substring(clock, 1, 8), r"\D", "")).cast("bigint")


def host(text: Column) -> Column:
    """The part of 'host:port' before the first colon."""
    return F.substring_index(text, ":", 1)


def port(text: Column) -> Column:
    """The part of 'host:port' after the first colon; null without one."""
    return F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + F.lit(1), F.length(text)))


def valid_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9_]+", name) is not None


def is_valid_name(name: Column) -> Column:
    """valid_name, of a column."""
    return name.rlike(r"\A[A-Za-z0-9_]+\z")


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def coordinates(metadata: Column) -> Column:
    """(lat, lon) of geo.coordinates in a JSON text; null if it has none."""
    lat, lon = (F.get_json_object(metadata, f"$.geo.coordinates[{i}]").try_cast("double") for i in (0, 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def located(metadata: Column) -> Column:
    """(lat, lon, sentiment, categories, ref) of a JSON text with location.lat and location.lng; null without them."""
    lat, lon = (F.get_json_object(metadata, f"$.location.{k}").try_cast("double") for k in ("lat", "lng"))
    categories = F.array_join(F.from_json(F.get_json_object(metadata, "$.categories"), "array<string>"), ",")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), F.get_json_object(metadata, "$.sent").try_cast("double").alias("sentiment"), categories.alias("categories"), F.get_json_object(metadata, "$.ref").alias("ref")))


def starts_with(a: Column, b: Column) -> Column:
    """Does the array ``a`` begin with the array ``b``?"""
    return (F.size(a) >= F.size(b)) & (F.slice(a, 1, F.size(b)) == b)


def append(a: Column, b: Column) -> Column:
    """Texts or arrays one after the other."""
    return F.concat(a, b)


def prepend(a: Column, b: Column) -> Column:
    return F.concat(b, a)


def truncate(a: Column, n: int, array: bool = False) -> Column:
    """The first ``n`` characters, or elements if ``array``."""
    return F.slice(a, 1, n) if array else F.left(a, F.lit(n))
