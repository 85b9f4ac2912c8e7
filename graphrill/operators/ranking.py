"""PageRank, HITS and products of the adjacency matrix with vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators.extract import induced
from graphrill.session import cut, cut_and_measure

def _rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int, epsilon: float | None) -> DataFrame:
    """Applies ``step`` (id, rank, ...) -> with old, until the L1 change of rank is within epsilon or ``most`` rounds are done.

    A round reads its state more than once, so each is held in the shared folder; the same job gives the change.
    """
    for _ in range(most):
        state, seen = cut_and_measure(step(state), change=F.sum(F.abs(F.col("rank") - F.col("old"))))
        state = state.drop("old")
        if epsilon is not None and seen["change"] <= epsilon:
            break
    return state


def pagerank(g: Graph, etype: int | None = None, damping: float = 0.85, epsilon: float | None = 1e-8, most: int = 20, dangling_receives: bool = False, start: DataFrame | None = None) -> DataFrame:
    """(id, rank) of all vertices. Edges of different types count apart; weights do not count.

    The rank of vertices without out edges is spread over all. By default such a vertex takes nothing over its own in edges,
    as users of this rule expect; ``dangling_receives`` gives the textbook rule. ``epsilon`` None runs all
    ``most`` rounds. ``start`` (id, rank) is a rank to start from, for warm starts.

    A round is one join of the edges with the ranks by source and one sum by destination, combined before the shuffle; the
    sum of the ranks without out edges is one row.
    """
    e = cut(g.of_type(etype).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")))
    out = e.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("out"))
    ids = g.ids()
    n = ids.count()
    if not n:
        return g.spark.createDataFrame([], "id bigint, rank double")
    first = F.lit(1.0 / n).alias("rank")
    state = ids.join(out, "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out"), first)
    if start is not None:
        state = state.drop("rank").join(start.select("id", "rank"), "id", "left").fillna(0.0, ["rank"])
    state = cut(state)

    def step(s: DataFrame) -> DataFrame:
        given = e.join(s.where("out > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("x")), "src")
        taken = given.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("c")).alias("taken"))
        lost = s.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = F.coalesce("taken", F.lit(0.0))
        if not dangling_receives:
            got = F.when(F.col("out") > 0, got).otherwise(F.lit(0.0))
        rank = damping * (got + F.col("lost") / n) + (1 - damping) / n
        return s.withColumnRenamed("rank", "old").join(taken, "id", "left").crossJoin(F.broadcast(lost)).select("id", "out", rank.alias("rank"), "old")  # lost is one row

    return _rounds(state, step, most, epsilon).select("id", "rank")


def subset_pagerank(g: Graph, vertices: DataFrame, damping: float = 0.85, epsilon: float | None = 1e-8, most: int = 20) -> DataFrame:
    """PageRank on the graph induced by ``vertices`` (id); vertices without out edges take over in edges as others do."""
    kept = vertices.select("id").distinct()
    sub = induced(g, kept)
    only = kept.select("id", F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("vtype"), F.lit(0).cast("bigint").alias("weight"))
    return pagerank(sub.with_(vertices=only), None, damping, epsilon, most, dangling_receives=True)


def hits(g: Graph, rounds: int = 10) -> DataFrame:
    """(id, hub, authority) of all vertices after ``rounds`` of authorities and then hubs, each in L2 norm; 0 if the norm is."""
    e = cut(g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")))
    ids = cut(g.ids())
    hub = ids.withColumn("x", F.lit(1.0))
    authority = hub

    def normed(s: DataFrame) -> DataFrame:
        norm = s.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))  # one row
        return s.crossJoin(F.broadcast(norm)).select("id", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))

    for _ in range(rounds):
        sums = e.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("c")).alias("x"))
        authority = cut(normed(sums))
        sums = e.join(authority.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("c")).alias("x"))
        hub = cut(normed(sums))
    both = ids.join(hub.withColumnRenamed("x", "hub"), "id", "left").join(authority.withColumnRenamed("x", "authority"), "id", "left")
    return both.fillna(0.0, ["hub", "authority"])


PLUS: dict[str, Callable[[Column], Column]] = {"+": F.sum, "max": F.max, "min": F.min, "or": F.bool_or, "and": F.bool_and}
TIMES: dict[str, Callable[[Column, Column], Column]] = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "min": F.least, "max": F.greatest, "and": lambda a, b: (a != 0) & b.cast("boolean"), "or": lambda a, b: (a != 0) | b.cast("boolean")}


def matvec(g: Graph, x: DataFrame, plus: str | Callable = "+", times: str | Callable = "*", empty=None, etype: int | None = None) -> DataFrame:
    """(id, value): for each source v the ``plus`` over its out edges of weight ``times`` x[dst], from x (id, value).

    plus and times are names of PLUS and TIMES or functions of columns. Vertices of x without a product have ``empty`` if
    that is given, else no row.
    """
    plus, times = PLUS.get(plus, plus), TIMES.get(times, times)
    rows = g.of_type(etype).join(x.select(F.col("id").alias("dst"), F.col("value").alias("_x")), "dst")
    y = rows.groupBy(F.col("src").alias("id")).agg(plus(times(F.col("weight"), F.col("_x"))).alias("value"))
    return y if empty is None else x.select("id").join(y, "id", "left").withColumn("value", F.coalesce("value", F.lit(empty)))


def transposed_matvec(g: Graph, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None, unit: bool = True, by_degree: bool = False, below: float | None = None) -> DataFrame:
    """(id, value): alpha * A^T x + beta * y, for sparse x and y (id, value).

    ``unit``: edges count 1, else their weight; ``by_degree``: x is divided by the out-degree (edges) first; ``below``:
    entries of x whose absolute value is less are held back.
    """
    if below is not None:
        x = x.where(F.abs("value") >= below)
    x = x.select(F.col("id").alias("src"), F.col("value").alias("_x"))
    if by_degree:
        x = x.join(g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d")), "src").select("src", (F.col("_x") / F.col("_d")).alias("_x"))
    w = F.lit(1) if unit else F.col("weight")
    product = g.edges.join(x, "src").groupBy(F.col("dst").alias("id")).agg((F.sum(w * F.col("_x")) * alpha).alias("value"))
    if y is None or not beta:
        return product
    return product.union(y.select("id", F.col("value") * beta)).groupBy("id").agg(F.sum("value").alias("value"))


def power_rank(g: Graph, alpha: float = 0.15, epsilon: float = 2.2e-16, most: int = 100, v: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """(id, value): x = v + alpha A^T D^-1 x by iteration, in L1 norm; v is 1 everywhere by default.

    It ends when the L1 change over the L1 norm is below n * sqrt(epsilon) / 8, or after ``most`` rounds; ``fixed`` runs all.
    """
    v = cut(g.ids().withColumn("value", F.lit(1.0)) if v is None else v)
    limit = v.count() * math.sqrt(epsilon) / 8
    x = v
    for _ in range(most):
        new = cut(transposed_matvec(g, x, alpha, 1.0, v, by_degree=True))
        if not fixed:
            both = new.join(x.withColumnRenamed("value", "old"), "id", "full").fillna(0.0, ["value", "old"])
            delta, norm = both.agg(F.sum(F.abs(F.col("value") - F.col("old"))), F.sum(F.abs("value"))).head()
            if not norm or delta / norm < limit:
                x = new
                break
        x = new
    total = x.agg(F.sum(F.abs("value")).alias("n"))
    return x.crossJoin(F.broadcast(total)).select("id", F.when(F.col("n") > 0, F.col("value") / F.col("n")).otherwise(0.0).alias("value"))  # one row
