"""Graphs over the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.plans import table

#: Types of event edges, in the order of their numbers.
EVENTS = ["view", "click", "purchase", "signup", "error"]


def held(spark: SparkSession, d: str) -> Graph:
    """The edges before the first batch, with the vertices and names."""
    return Graph(table(spark, d, "edges").select("etype", "src", "dst", "weight", "time_first", "time_recent"), table(spark, d, "vertices").select("id", "name", "vtype", "weight"), table(spark, d, "name_map").select("kind", "id", "name"))


def held_edges(spark: SparkSession, d: str) -> Graph:
    """The same edges; vertices are only those with an edge."""
    return Graph.of(held(spark, d).edges)


def flow(spark: SparkSession, d: str) -> Graph:
    """Users one after the other in events of a type and hour: (type, user, next user) with counts and first and last time."""
    e = table(spark, d, "events")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    etype = F.coalesce(*[F.when(F.col("event_type") == n, i) for i, n in enumerate(EVENTS)])
    # The order is within a type and hour, so no task gets all events.
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    rows = e.select(etype.cast("bigint").alias("etype"), F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), seconds.alias("t")).where("dst IS NOT NULL AND src <> dst")
    return Graph.of(rows.groupBy("etype", "src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min("t").alias("time_first"), F.max("t").alias("time_recent")))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, etype, weight, t): customers, suppliers (from 1,000,000 on), the return flag, quantities and days."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    etype = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias("src"), (F.col("l_suppkey") + 1_000_000).cast("bigint").alias("dst"), etype.cast("bigint").alias("etype"), F.col("l_quantity").cast("bigint").alias("weight"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)").alias("t"),
    )


FLOW = (
    "flow AS MATERIALIZED (SELECT etype, src, dst, count(*) AS weight, min(t) AS time_first, max(t) AS time_recent FROM (SELECT CASE event_type "
    + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(EVENTS))
    + " END::BIGINT AS etype, user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst, floor(epoch(ts))::BIGINT AS t FROM events) "
    "WHERE dst IS NOT NULL AND src <> dst GROUP BY etype, src, dst)"
)


def unrolled(first: str, step: str, rounds: int, name: str = "s") -> str:
    """Tables name0 to name<rounds>: ``first``, and each by ``step`` from the one before, which is {p} there."""
    return ", ".join([f"{name}0 AS MATERIALIZED ({first})"] + [f"{name}{i + 1} AS MATERIALIZED ({step.replace('{p}', f'{name}{i}').replace('{k}', str(i + 1))})" for i in range(rounds)])
