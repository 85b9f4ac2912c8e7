"""Requests over a per-vertex column: ranges, top-k, sets, strides and samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators.traverse import of_vtypes, with_names
from graphrill.session import cut, partitions


def positions(rows: DataFrame, order: list, into: str = "pos") -> DataFrame:
    """``rows`` with their position (from 0) in the order, counted over sorted parts: no task gets all rows.

    The rows are sorted over all tasks and held; the counts of the parts before (one row a part) are added to the position
    within a part.
    """
    spark = rows.sparkSession
    held = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    held = cut(held.withColumn("_part", F.spark_partition_id()))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    starts = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.join(F.broadcast(starts), "_part").withColumn(into, within + F.col("_before")).drop("_part", "_before")


def _sampled(rows: DataFrame, count: int | None, stride: int, samples: int, log: bool) -> DataFrame:
    """Rows at the positions that stride, samples or log choose; ``rows`` has pos from 0."""
    if log:
        n = count if count is not None else rows.agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).head()[0]
        return rows.where(F.col("pos").isin(log_positions(n, samples or 32)))
    if samples and count is None:
        count = rows.agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).head()[0]
    if samples:
        stride = max(1, math.ceil(count / samples))
    return rows.where(F.col("pos") % stride == 0) if stride > 1 else rows


def log_positions(n: int, samples: int) -> list[int]:
    """At most ``samples`` positions below n in geometric steps, 0 first."""
    if n <= 0:
        return []
    step = max(n, 2) ** (1 / max(1, samples - 1))
    return sorted({0} | {min(n - 1, round(step**i)) for i in range(samples)})


def _shown(rows: DataFrame, g: Graph | None, strings: bool, vtypes: list[int] | None, keep: list[str]) -> DataFrame:
    """Vertex types are filtered after the positions are chosen, so fewer rows than asked for may remain."""
    if vtypes:
        rows = of_vtypes(rows, g, vtypes)
    rows = rows.select("id", *keep)
    return with_names(rows, g.names, "id", into="name") if strings else rows


def data_array(rows: DataFrame, value: str, g: Graph | None = None, stride: int = 1, samples: int = 0, log: bool = False, strings: bool = False, vtypes: list[int] | None = None) -> DataFrame:
    """All values by id, or those at the positions that stride, samples or log choose."""
    rows = rows.select("id", value)
    if stride > 1 or samples or log:
        rows = _sampled(positions(rows, [F.col("id")]), None, stride, samples, log)
    return _shown(rows, g, strings, vtypes, [value])


def data_range(rows: DataFrame, value: str, offset: int, count: int, g: Graph | None = None, strings: bool = False, vtypes: list[int] | None = None, stride: int = 1, samples: int = 0, log: bool = False) -> DataFrame:
    """Values of the ids from ``offset`` on, ``count`` of them; an offset beyond the last id is an error, the end is clamped."""
    rows = rows.select("id", value).where((F.col("id") >= offset) & (F.col("id") < offset + count)).withColumn("pos", F.col("id") - offset)
    return _shown(_sampled(rows, count, stride, samples, log), g, strings, vtypes, [value])


def sorted_range(rows: DataFrame, value: str, offset: int, count: int, order: str = "DESC", g: Graph | None = None, strings: bool = False, vtypes: list[int] | None = None, stride: int = 1, samples: int = 0, log: bool = False) -> DataFrame:
    """(id, value, pos): the ``count`` rows from ``offset`` on in the order of the value; ties in the order of ids.

    Spark takes the first offset + count of each task, so the sort moves few rows.
    """
    by = F.desc_nulls_last(value) if order.upper() == "DESC" else F.asc_nulls_last(value)
    top = rows.select("id", value).orderBy(by, "id").limit(offset + count)
    ranked = top.withColumn("pos", F.row_number().over(Window.orderBy(by, "id")) - 1)  # at most offset + count rows
    page = ranked.where(F.col("pos") >= offset).withColumn("pos", F.col("pos") - offset)
    return _shown(_sampled(page, count, stride, samples, log), g, strings, vtypes, [value, "pos"])


def data_set(rows: DataFrame, value: str, ids: list, g: Graph, strings: bool = False, vtypes: list[int] | None = None) -> DataFrame:
    """Values of the ids or names given; what names no vertex is left out without a word."""
    numbers = [i for i in ids if isinstance(i, int)]
    names = [i for i in ids if isinstance(i, str)]
    kept = F.col("id").isin(numbers)
    if names:
        found = g.names.where((F.col("kind") == "vertex") & F.col("name").isin(names)).select("id")
        picked = rows.join(F.broadcast(found), "id", "left_semi").select("id", value).union(rows.where(kept).select("id", value)).distinct()
    else:
        picked = rows.where(kept).select("id", value)
    return _shown(picked, g, strings, vtypes, [value])


def argmax(rows: DataFrame, value: str) -> DataFrame:
    """One row (id, value): the greatest value and the least id that has it."""
    best = rows.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("id")).alias("i"))).alias("b"))
    return best.select((-F.col("b.i")).alias("id"), F.col("b.v").alias(value))
