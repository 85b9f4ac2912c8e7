"""SQL over the graph: the views vertices and edges, and a view for each result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators.stats import degrees


def vertex_view(g: Graph) -> DataFrame:
    """(id, name, type, weight, indegree, outdegree) of the vertices with an edge."""
    v = g.vertices.select("id", "name", F.col("vtype").alias("type"), "weight")
    rows = degrees(g).join(v, "id", "left")
    return rows.select("id", "name", F.coalesce("type", F.lit(0)).alias("type"), F.coalesce("weight", F.lit(0)).alias("weight"), "indegree", "outdegree")


def edge_view(g: Graph) -> DataFrame:
    """(id, source_vertex, target_vertex, type, weight, first, last); the id is a hash of the key, the same in every run."""
    return g.edges.select(F.xxhash64("etype", "src", "dst").alias("id"), F.col("src").alias("source_vertex"), F.col("dst").alias("target_vertex"), F.col("etype").alias("type"), "weight", F.col("time_first").alias("first"), F.col("time_recent").alias("last"))


def built_in(g: Graph) -> DataFrame:
    """The columns that every graph has: vertex_outdegree, vertex_indegree, vertex_weight, vertex_type_num, vertex_type_name."""
    types = g.names.where("kind = 'vtype'").select(F.col("id").alias("vertex_type_num"), F.col("name").alias("vertex_type_name"))
    v = g.vertices.select("id", F.col("weight").alias("vertex_weight"), F.col("vtype").alias("vertex_type_num"))
    d = degrees(g).select("id", F.col("outdegree").alias("vertex_outdegree"), F.col("indegree").alias("vertex_indegree"))
    return v.join(d, "id", "full").join(types, "vertex_type_num", "left").fillna(0, ["vertex_outdegree", "vertex_indegree"]).select("id", "vertex_outdegree", "vertex_indegree", "vertex_weight", "vertex_type_num", "vertex_type_name")


def register(g: Graph) -> None:
    """Replaces the session's views by those of ``g``."""
    vertex_view(g).createOrReplaceTempView("vertices")
    edge_view(g).createOrReplaceTempView("edges")
    for name, rows in g.results.items():
        rows.createOrReplaceTempView(f"alg_{name}")


def sql(g: Graph, query: str) -> DataFrame:
    """A query over the views of ``g``; all of Spark's SQL, with order, limit and offset."""
    register(g)
    return g.spark.sql(query)
