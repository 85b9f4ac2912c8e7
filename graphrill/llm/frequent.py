"""The most frequent items of columns with very many distinct values, in three phases between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrill.session import broadcast_if_small, cut, partitions


def local_counts(rows: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, int]:
    """(node, field, item, n): how often each node has each item of each column, and the number of nodes.

    ``rows`` with the same ``key`` are one row; of such that differ the greatest counts. Nodes are tasks; rows go to them by
    a hash of the key, once, and items do not move. Null and empty items are left out.
    """
    nodes = partitions(rows.sparkSession)
    rows = rows.select(*key, *columns).withColumn("node", F.pmod(F.xxhash64(*key), F.lit(nodes)).cast("int"))
    rows = rows.repartitionById(nodes, F.col("node"))
    rows = rows.groupBy("node", *key).agg(F.max(F.struct(*columns)).alias("_row"))
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_row.{c}").cast("string").alias("item")) for c in columns])
    items = rows.select("node", F.explode(items).alias("_i")).select("node", "_i.field", "_i.item").where(F.length("item") > 0)
    return items.groupBy("node", "field", "item").agg(F.count(F.lit(1)).alias("n")), nodes


def most_frequent(rows: DataFrame, key: list[str], columns: list[str], k: int, share: float = 0.0) -> DataFrame:
    """(field, item, n, total): the ``k`` most frequent items of each column with exact counts, and the rows that have one.

    Of equally frequent items the lesser comes first. Only items in at least ``share`` of the rows that have an item come
    out; the least count for this is a lower bound from the start. An empty table gives an empty one.

    Phase 1: each node sends its k most frequent items; the k-th of their sums is a lower bound of the k-th count. Phase 2:
    each node sends all items with at least a node's share of the bound; their sums raise the bound, and an item stays only
    if its sum, with just under the share for every node that did not send it, reaches the bound. Phase 3: the nodes send
    their counts of the items that stay. Only leaders and candidates move.
    """
    local, nodes = local_counts(rows, key, columns)
    local = cut(local)
    totals = local.groupBy("field").agg(F.sum("n").alias("total"))
    rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item"))
    leaders = local.withColumn("r", rank(["node", "field"])).where(F.col("r") <= k)
    leaders = leaders.groupBy("field", "item").agg(F.sum("n").alias("n"))

    def kth(sums: DataFrame) -> DataFrame:
        """The k-th greatest sum of each field, or 1 if there are fewer, and the least count for the share."""
        top = sums.withColumn("r", rank(["field"])).where(F.col("r") <= k).groupBy("field").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
        needed = F.ceil(F.col("total") * F.lit(share))
        return totals.join(top, "field", "left").select("field", F.greatest(F.when(F.col("c") == k, F.col("least")).otherwise(1), needed).alias("bound"), "total", needed.alias("needed"))

    # One row per column: as many as there are columns.
    first = F.broadcast(kth(leaders).select("field", F.ceil(F.col("bound") / nodes).alias("least")))
    sent = local.join(first, "field").where(F.col("n") >= F.col("least"))
    sums = cut(sent.groupBy("field", "item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("senders"), F.max("least").alias("least")))
    second = F.broadcast(kth(sums).select("field", "bound"))
    upper = F.col("n") + (nodes - F.col("senders")) * (F.col("least") - 1)
    candidates = sums.join(second, "field").where(upper >= F.col("bound")).select("field", "item")
    exact = local.join(broadcast_if_small(candidates), ["field", "item"], "left_semi").groupBy("field", "item").agg(F.sum("n").alias("n"))
    last = F.broadcast(totals.select("field", "total"))
    return exact.withColumn("r", rank(["field"])).where(F.col("r") <= k).join(last, "field").where(F.col("n") >= F.ceil(F.col("total") * F.lit(share))).select("field", "item", "n", "total")
