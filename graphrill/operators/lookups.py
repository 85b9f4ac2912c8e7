"""Lookups of hot keys in large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.session import top_k

#: So many of the most frequent keys are looked up in a broadcast table, whatever the size of the table.
HEAVY = 200
#: Keys that the sketch of the most frequent ones holds at once.
HELD = 8192


def heaviest(key: Column) -> Column:
    """An aggregate: the most frequent values of ``key``, at most HEAVY, from one bounded sketch; nulls do not count.

    Every value of more than a few in HELD of the rows is found. A miss costs balance only, never a row.
    """
    return F.filter(top_k(key, HEAVY, HELD)["item"], lambda x: x.isNotNull())


def heavy(source: DataFrame, key: Column, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """(_heavy, _heavy_value): the most frequent keys of ``source`` and what ``table`` has for them; at most HEAVY rows."""
    top = source.select(key.alias("_key")).where(F.col("_key").isNotNull()).agg(heaviest(F.col("_key")).alias("_top")).select(F.explode("_top").alias("_heavy"))
    return heavy_of(top, table, table_key, value)


def heavy_of(top: DataFrame, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """heavy, for keys (_heavy) that are known, at most HEAVY."""
    found = table.select(F.col(table_key).alias("_table_key"), F.col(value).alias("_heavy_value"))
    return found.join(F.broadcast(top), F.col("_table_key") == F.col("_heavy")).select("_heavy", "_heavy_value")


def known_first(rows: DataFrame, key: str, heavy_rows: DataFrame, into: str, known: Column | None = None) -> DataFrame:
    """``rows`` with ``into`` where ``known`` or ``heavy_rows`` has it, by broadcast alone; there the key becomes null."""
    done = F.col("_heavy_value") if known is None else F.coalesce(known, "_heavy_value")
    rows = rows.join(F.broadcast(heavy_rows), F.col(key) == F.col("_heavy"), "left").withColumn(into, done)
    return rows.withColumn(key, F.when(F.col(into).isNull(), F.col(key))).drop("_heavy", "_heavy_value")


def lookup_rest(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, into: str, spread: Column) -> DataFrame:
    """``rows`` with ``into`` filled by the ``value`` that ``table`` has for ``key``; rows whose key is null are spread."""
    rest = F.col(key).isNotNull()
    rows = rows.withColumn("_spread", F.when(rest, F.lit(0).cast("bigint")).otherwise(F.coalesce(spread, F.lit(1)).cast("bigint")))
    # A zero that the optimizer does not see, else it takes the second column out of the join and the spread is lost.
    zero = F.pmod(F.xxhash64(table_key), F.lit(1)).cast("bigint")
    found = table.select(F.col(table_key).alias("_table_key"), F.col(value).alias("_found"), zero.alias("_zero"))
    same = (F.coalesce(F.col(key), F.lit("0").cast(dict(rows.dtypes)[key])) == F.col("_table_key")) & (F.col("_spread") == F.col("_zero"))
    joined = rows.join(found, same, "left")
    return joined.withColumn(into, F.coalesce(into, F.when(rest, F.col("_found")))).drop("_spread", "_table_key", "_zero", "_found")


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, into: str, heavy_rows: DataFrame, known: Column | None = None, spread: Column | None = None) -> DataFrame:
    """``rows`` with ``into``: the ``value`` that ``table`` has for ``key``, null if none; ``table_key`` is unique.

    Keys in ``heavy_rows`` (of heavy) are looked up by broadcast, and rows with ``known`` not null need no lookup. These rows
    and those with a null key go through the shuffle of the rest under ``spread``, a value that differs from row to row, so
    no task gets a hot key. ``spread`` is by default a hash of all columns.
    """
    columns = rows.columns
    rows = rows.withColumn("_key", F.col(key)).withColumn("_by", F.xxhash64(*columns) if spread is None else spread)
    rows = known_first(rows, "_key", heavy_rows, into, known)
    return lookup_rest(rows, "_key", table, table_key, value, into, F.col("_by")).drop("_key", "_by")
