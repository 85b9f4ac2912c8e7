"""Scans, neighbours, predicates and lookups of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import KEY, Graph
from graphrill.session import broadcast_if_small

META = ["weight", "time_first", "time_recent"]


def edges_of(g: Graph, v: int, direction: str = "out", etype: int | None = None) -> DataFrame:
    """The edges of a vertex: 'out' and 'in' as edges, 'both' as incident slots. Filters reach the scan."""
    if direction == "out":
        return g.of_type(etype).where(F.col("src") == v)
    if direction == "in":
        return g.of_type(etype).where(F.col("dst") == v)
    near = g.with_(edges=g.of_type(etype).where((F.col("src") == v) | (F.col("dst") == v)))
    return near.incident().where(F.col("id") == v)


def edges_of_type(g: Graph, etype: int | None = None) -> DataFrame:
    return g.of_type(etype)


def gather(g: Graph, vertices: DataFrame, direction: str = "out", etype: int | None = None) -> DataFrame:
    """(id, etype, nbr, weight, time_first, time_recent) of the vertices (id) given: successors, predecessors or both.

    The vertices are broadcast if their checked size allows, else both sides move by vertex.
    """
    e = g.of_type(etype)
    if direction == "out":
        rows = e.select(F.col("src").alias("id"), "etype", F.col("dst").alias("nbr"), *META)
    elif direction == "in":
        rows = e.select(F.col("dst").alias("id"), "etype", F.col("src").alias("nbr"), *META)
    else:
        rows = g.incident(etype).select("id", "etype", "nbr", *META)
    return rows.join(broadcast_if_small(vertices.select("id").distinct()), "id", "left_semi")


def has_edge(g: Graph, pairs: DataFrame, direction: str = "out", etype: int | None = None) -> DataFrame:
    """``pairs`` (id, nbr) with the flag found: is nbr a successor ('out'), predecessor ('in') or neighbour ('both')?"""
    e = g.of_type(etype)
    out = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    into = e.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))
    known = {"out": out, "in": into, "both": out.union(into)}[direction].distinct().withColumn("_is", F.lit(True))
    joined = pairs.join(known, (F.col("id") == F.col("_a")) & (F.col("nbr") == F.col("_b")), "left")
    return joined.withColumn("found", F.coalesce("_is", F.lit(False))).drop("_a", "_b", "_is")


def edge_values(g: Graph, keys: DataFrame) -> DataFrame:
    """``keys`` (etype, src, dst) with weight (0 if there is no such edge), time_first and time_recent (-1)."""
    found = keys.select(*KEY).join(g.edges, KEY, "left")
    return found.select(*KEY, F.coalesce("weight", F.lit(0)).alias("weight"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in META[1:]])


def two_hops(g: Graph, vertices: DataFrame) -> DataFrame:
    """(id, candidate): the neighbours of neighbours of the vertices given, less themselves and their neighbours."""
    n = g.both_ways()
    near = n.join(broadcast_if_small(vertices.select("id").distinct()), "id", "left_semi")
    far = near.join(n.select(F.col("id").alias("nbr"), F.col("nbr").alias("candidate")), "nbr").select("id", "candidate").distinct()
    return far.where("id <> candidate").join(near.withColumnRenamed("nbr", "candidate"), ["id", "candidate"], "left_anti")


def common_neighbours(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the number of their common neighbours.

    Each pair is spread over the neighbours of its end of lower degree and looked up at the other, so a hub's neighbours are
    never listed for each of its links: linked pairs cost at most links^1.5 rows.
    """
    n = g.both_ways()
    deg = n.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    at = lambda end: deg.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}"))
    sized = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b")
    low = F.col("d_a") <= F.col("d_b")
    sized = sized.select("a", "b", F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    spread = sized.join(n.select(F.col("id").alias("x"), F.col("nbr").alias("z")), "x")
    shared = spread.join(n.select(F.col("id").alias("y"), F.col("nbr").alias("z")), ["y", "z"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(shared, ["a", "b"], "left").withColumn("common", F.coalesce("n", F.lit(0))).drop("n")


def label_edges(g: Graph, labels: DataFrame, label: str = "label") -> DataFrame:
    """The edges whose ends have the same label; labels is (id, label)."""
    by = lambda end: labels.select(F.col("id").alias(end), F.col(label).alias(f"_{end}"))
    return g.edges.join(by("src"), "src").join(by("dst"), "dst").where("_src = _dst").drop("_src", "_dst").select(*g.edges.columns)


def with_names(rows: DataFrame, names: DataFrame, column: str, kind: str = "vertex", into: str | None = None) -> DataFrame:
    """``rows`` with the name of the id in ``column``; an id without a name has ''."""
    known = names.where(F.col("kind") == kind).select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    joined = rows.join(broadcast_if_small(known), F.col(column) == F.col("_id"), "left")
    return joined.withColumn(into or f"{column}_name", F.coalesce("_name", F.lit(""))).drop("_id", "_name")


def of_vtypes(rows: DataFrame, g: Graph, vtypes: list[int], column: str = "id") -> DataFrame:
    """The rows whose vertex has one of the types."""
    kept = g.vertices.where(F.col("vtype").isin(vtypes)).select(F.col("id").alias(column))
    return rows.join(kept, column, "left_semi")


def affected(g: Graph, batch: DataFrame) -> DataFrame:
    """(id): the ends of a batch's edges (src, dst) and the successors of those."""
    ends = batch.select(F.col("src").alias("id")).union(batch.select("dst")).distinct()
    return ends.union(g.edges.join(broadcast_if_small(ends), F.col("src") == F.col("id"), "left_semi").select("dst")).distinct()
