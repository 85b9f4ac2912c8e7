"""Results per key where a few keys hold most rows, by value-frequency compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrill.session import cut, partitions


def compress(rows: DataFrame, key: str, value: str, weight: str = "weight") -> DataFrame:
    """(key, value, weight): how often each value stands with each key.

    Grouped by both, so a hot key spreads over its values, and combined before the shuffle, so equal pairs cost one row
    per task. Null keys and values are groups of their own. Other columns are left out, whatever their names.
    """
    return rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias(weight))


def rekeyed(pairs: DataFrame, key: str = "key") -> DataFrame:
    """Compressed pairs whose keys became others, several of which may be one: equal pairs are added up."""
    return pairs.groupBy(F.col(key).alias("key"), "value").agg(F.sum("weight").alias("weight"))


def totals(pairs: DataFrame) -> DataFrame:
    """(key, rows) from compressed pairs: the sum of the weights, of as many rows as a key has values."""
    return pairs.groupBy("key").agg(F.sum("weight").alias("rows"))


def counts(pairs: DataFrame) -> DataFrame:
    """(key, rows, distinct_values, mode) from compressed pairs.

    ``rows`` counts rows with null values too, ``distinct_values`` and ``mode`` take only values that are not null. Of
    equally frequent values the least is the mode; a key with null values only has none.
    """
    per = F.when(F.col("value").isNotNull(), F.col("weight"))
    most = pairs.groupBy("key").agg(
        F.sum("weight").alias("rows"),
        F.count("value").alias("distinct_values"),
        F.max(per).alias("_most"),
    )
    best = pairs.where(F.col("value").isNotNull()).groupBy("key", "weight").agg(F.min("value").alias("mode"))
    return (
        most.join(best.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_most") == F.col("weight")), "left")
        .select("key", "rows", "distinct_values", "mode")
    )


def percentiles(pairs: DataFrame, at: dict[str, float]) -> DataFrame:
    """(key, *at): exact discrete percentiles from compressed pairs.

    The percentile p of a key is its least value such that at least p of its rows (and one row) have no greater value; null
    values do not count, keys with null values only do not appear. The pairs are sorted over all tasks by key and value,
    each task adds up its part of a key, and the parts before a task are added to its running sums. So no task holds more
    than its range of pairs, however many values a key has.
    """
    spark = pairs.sparkSession
    pairs = pairs.where(F.col("value").isNotNull()).repartitionByRange(partitions(spark), "key", "value")
    pairs = cut(pairs.withColumn("part", F.spark_partition_id()))
    parts = pairs.groupBy("key", "part").agg(F.sum("weight").alias("of_part"))
    parts = parts.select(
        F.col("key").alias("_key"), F.col("part").alias("_part"),
        F.coalesce(F.sum("of_part").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("of_part").over(Window.partitionBy("key")).alias("total"),
    )
    up_to = F.col("before") + F.sum("weight").over(Window.partitionBy("part", "key").orderBy("value"))
    ranked = pairs.join(parts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))).withColumn("up_to", up_to)
    rank = {name: F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))) for name, p in at.items()}
    return ranked.groupBy("key").agg(*[F.min(F.when(F.col("up_to") >= rank[name], F.col("value"))).alias(name) for name in at])


def profile(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """counts and percentiles of ``value`` for each ``key``, in one table. An empty table gives an empty one."""
    return profile_of(compress(rows, key, value), at)


def profile_of(pairs: DataFrame, at: dict[str, float]) -> DataFrame:
    """profile, from compressed pairs."""
    pairs = cut(pairs)
    p = percentiles(pairs, at).withColumnRenamed("key", "_key")
    return counts(pairs).join(p, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
