"""Reading rules of the update feed: repeated rows, names of vertices and types, times."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.operators.lookups import heavy, heavy_of, known_first, lookup, lookup_rest
from graphrill.session import broadcast_if_few, is_small


def once(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per ``key`` with ``columns``; of rows that differ, the greatest in the order of ``columns`` (nulls least).

    The rows move once, by ``key``; repeats are rare, so nothing is combined before. Null keys are equal to each other.
    """
    rest = [c for c in columns if c not in key]
    rows = rows.select(*key, *rest).repartition(*key)
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def once_in_place(rows: DataFrame, key: list[str], columns: list[str], hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """As once, but of most rows only the key moves: rows with a repeated key meet, the others stay where they are.

    ``hold`` writes the repeated keys and their rows, ``rows`` are read again each time. If the repeated keys are not small,
    all rows move and are held.
    """
    repeated = hold(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]), "repeated")
    if not is_small(repeated):
        return hold(once(rows, key, columns), "rows")
    rows = rows.select(*columns)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    met = hold(once(rows.join(F.broadcast(repeated), same, "left_semi"), key, columns), "met")
    return rows.join(F.broadcast(repeated), same, "left_anti").unionByName(met)


def name_key(string: Column, number: Column) -> Column:
    """What names a side or type: 's' and its string, else 'n' and its number; null if it has neither.

    A string that is null or empty is unset; the number 0 is an id like any other.
    """
    return F.when(F.length(string) > 0, F.concat(F.lit("s"), string)).when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string")))


def _dictionary(names: DataFrame, kind: str) -> DataFrame:
    kept = names.where((F.col("kind") == kind) & F.col("name").isNotNull())
    return kept.select(F.concat(F.lit("s"), "name").alias("_name"), F.col("id").alias("_id"))


def _number(key: str) -> Column:
    return F.when(F.substring(key, 1, 1) == "n", F.substring(F.col(key), 2, 20).cast("bigint"))


def named(rows: DataFrame, key: str, names: DataFrame, kind: str, into: str) -> DataFrame:
    """``rows`` with the id that the column ``key`` (of name_key) means through ``names``; rows that name nothing are left out.

    ``key`` is dropped. For rows that are already grouped by ``key``, and for types, of which there are few.
    """
    ids = _dictionary(names, kind)
    if kind != "vertex":
        ids = broadcast_if_few(ids)
    joined = rows.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_name"), "left")
    return joined.withColumn(into, F.coalesce("_id", _number(key))).drop("_name", "_id", key).where(F.col(into).isNotNull())


def heavy_names(source: DataFrame, key: Column, names: DataFrame) -> DataFrame:
    """The most frequent string keys of ``source`` with their ids, for named_rows."""
    return heavy(source, F.when(key.startswith("s"), key), _dictionary(names, "vertex"), "_name", "_id")


def names_of(keys: list[str], names: DataFrame) -> DataFrame:
    """heavy_names, for string keys that are known to be frequent."""
    top = names.sparkSession.createDataFrame([(k,) for k in keys], "_heavy string")
    return heavy_of(top, _dictionary(names, "vertex"), "_name", "_id")


def partly_named(rows: DataFrame, key: str, heavy_rows: DataFrame, into: str) -> DataFrame:
    """``rows`` with the ids of numbers and of the names in ``heavy_rows``, whose ``key`` becomes null; nothing moves."""
    return known_first(rows, key, heavy_rows, into, _number(key))


def rest_named(rows: DataFrame, key: str, names: DataFrame, into: str, spread: Column) -> DataFrame:
    """``rows`` of partly_named with the other ids; rows that name nothing are left out, and ``key`` is dropped."""
    return lookup_rest(rows, key, _dictionary(names, "vertex"), "_name", "_id", into, spread).drop(key).where(F.col(into).isNotNull())


def named_rows(rows: DataFrame, key: str, names: DataFrame, heavy_rows: DataFrame, into: str, spread: Column) -> DataFrame:
    """As named, for vertices and rows that are not grouped by ``key``, which may have hot names (see lookup)."""
    return rest_named(partly_named(rows.where(F.col(key).isNotNull()), key, heavy_rows, into), key, names, into, spread)


def epoch(time: Column, sent_at: Column) -> Column:
    """Epoch seconds of ``time``, which is epoch seconds or YYYYMMDDHHMMSS (14 digits, UTC); null or 1: those of ``sent_at``.

    14 digits that are no date count as unset.
    """
    return F.coalesce(own_epoch(time), F.unix_seconds(sent_at.cast("timestamp")))


def own_epoch(time: Column) -> Column:
    """Epoch seconds of a time that is set, else null."""
    text = time.cast("string")
    stamp = F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit("+00:00")), F.lit("yyyyMMddHHmmssXXX")))
    return F.when(F.length(text) == 14, stamp).when(time != 1, time)


def with_epoch(rows: DataFrame, batches: DataFrame, into: str = "at") -> DataFrame:
    """``rows`` with the epoch seconds of each, by batch_id and time; deletions have a null time, so that of their batch.

    Times of batches are broadcast if they are small. Beyond that only the rows without a time of their own move, by batch,
    those of batches with very many rows excepted.
    """
    sent = batches.groupBy("batch_id").agg(F.max("sent_at").alias("_sent"))
    if is_small(sent):
        joined = rows.join(F.broadcast(sent), "batch_id", "left")
        return joined.withColumn(into, epoch(F.col("time"), F.col("_sent"))).drop("_sent")
    timed = rows.withColumn(into, own_epoch(F.col("time")))
    unset = timed.where(F.col(into).isNull())
    sent = sent.select("batch_id", F.unix_seconds(F.col("_sent").cast("timestamp")).alias("_sent"))
    found = lookup(unset, "batch_id", sent, "batch_id", "_sent", "_of_batch", heavy(unset, F.col("batch_id"), sent, "batch_id", "_sent"))
    return timed.where(F.col(into).isNotNull()).unionByName(found.withColumn(into, F.col("_of_batch")).drop("_of_batch"))
