"""Groups of records that pairs link directly or indirectly, on a grid of block pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.operators.lookups import heavy, lookup
from graphrill.session import FEW_ROWS, broadcast_if_few, cut, partitions

#: A cell of the grid holds about this many links; a cell with more, as a hub's row, is split.
CELL = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the links (a, b) and the least vertex that each is linked with."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return ids, ids[parent]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _cell(table: pa.Table) -> pa.Table:
    ids, least = union_find(*(table[c].to_numpy() for c in ("a", "b")))
    moved = ids != least
    return pa.table({"v": ids[moved], "rep": least[moved]})


def _cells(links: DataFrame, count: int, least: int = 1) -> DataFrame:
    """``links`` with the grid cell of each: its ends' blocks, and a part where the cell has more than CELL links. There are at
    least ``least`` cells."""
    blocks = math.ceil(math.sqrt(max(count / CELL, least)))
    at = links.select("a", "b", *[F.pmod(F.xxhash64(c), F.lit(blocks)).alias(f"block_{c}") for c in ("a", "b")])
    if blocks == 1:
        return at.withColumn("part", F.lit(0).cast("bigint"))
    sizes = at.groupBy("block_a", "block_b").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    full = sizes.where(F.col("parts") > 1)  # fewer than count / CELL rows
    at = at.join(broadcast_if_few(full) if count / CELL > FEW_ROWS else F.broadcast(full), ["block_a", "block_b"], "left")
    return at.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a", "b"), F.col("parts"))).otherwise(F.lit(0).cast("bigint")))


def group(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group_id): every id that stands in a pair with another id, and the least id of all it is linked with.

    Ids are bigint. Pairs with a null and pairs of an id with itself link nothing; repeated pairs and either order are one
    link. Other columns play no part. No pairs give an empty table.

    A round runs a union-find in every grid cell and then gives each vertex the least of its representatives in the cells
    of its row and column. Its other representatives are linked with that one. A vertex that represents no other leaves with
    its parent; the others stay, linked with theirs, until no link is left. Links fall by a third a round at least on random
    ids, and what fits into one cell ends in one more round. The first round has a cell for each task at least. Each round is
    held in the shared folder.
    """
    spark = pairs.sparkSession
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    links = cut(pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    left: list[DataFrame] = []
    least = partitions(spark)
    while count := links.count():
        cells = _cells(links, count, least if not left else 1).groupBy("block_a", "block_b", "part")
        stars = cells.applyInArrow(_cell, "v bigint, rep bigint")
        # A vertex has at most one representative in each cell of its row and column.
        parents = cut(stars.groupBy("v").agg(F.collect_set("rep").alias("reps")).withColumn("p", F.array_min("reps")))
        reps = parents.select(F.explode("reps").alias("rep")).distinct()
        left.append(cut(parents.join(reps, F.col("v") == F.col("rep"), "left_anti").select("v", "p")))
        stay = parents.join(reps, F.col("v") == F.col("rep"), "left_semi").select(F.col("p").alias("a"), F.col("v").alias("b"))
        other = parents.select(F.col("p").alias("a"), F.explode("reps").alias("b")).where("a <> b")
        links = cut(stay.union(other).distinct())
    found = spark.createDataFrame([], "id bigint, group_id bigint")
    for step in reversed(left):
        if step is not left[-1]:
            # One parent may have a third of all vertices.
            step = lookup(step, "p", found, "id", "group_id", "g", heavy(step, F.col("p"), found, "id", "group_id"))
            step = step.select(F.col("v").alias("id"), F.coalesce("g", "p").alias("group_id"))
        else:
            step = step.select(F.col("v").alias("id"), F.col("p").alias("group_id"))
        found = cut(found.union(step))
    return found.union(found.select(F.col("group_id").alias("id"), "group_id").distinct())
