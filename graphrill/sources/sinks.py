"""Graphs and results to files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators.extract import egonet
from graphrill.operators.stats import histogram, size_histogram
from graphrill.session import broadcast_if_small


def dump_edges(g: Graph, path: str) -> None:
    """Text files with lines ``src dst type weight first recent``."""
    g.edges.select("src", "dst", "etype", "weight", "time_first", "time_recent").write.csv(path, sep=" ")


def write_history(results: dict[str, DataFrame], batch_id: int, path: str, keep: int | None = None) -> None:
    """Writes each result under ``path``/name/batch=id, over what a replay of the batch wrote before, and drops all but the
    last ``keep`` batches."""
    for name, rows in results.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if keep is not None:
            _retain(rows.sparkSession, f"{path}/{name}", keep)


def _retain(spark: SparkSession, folder: str, keep: int) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")), key=lambda x: x[0])
    for _, old in found[: max(0, len(found) - keep)]:
        fs.delete(old, True)


def history(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All kept batches of a result, with the column batch."""
    return spark.read.parquet(f"{path}/{name}")


def history_value(spark: SparkSession, path: str, name: str, batch_id: int, vertex: int, column: str) -> DataFrame:
    """One value of one batch; only that batch's folder and the column are read."""
    return history(spark, path, name).where((F.col("batch") == batch_id) & (F.col("id") == vertex)).select(column)


def lookup_names(g: Graph, ids: list[int] | None = None, names: list[str] | None = None, kind: str = "vertex") -> DataFrame:
    """(id, name) of the ids or names given."""
    return g.names.where((F.col("kind") == kind) & (F.col("id").isin(ids or []) | F.col("name").isin(names or []))).select("id", "name")


def documents(rows: DataFrame, time: int) -> DataFrame:
    """(value): one JSON text per vertex with time, vtx and the columns of a result."""
    return rows.select(F.to_json(F.struct(F.lit(time).alias("time"), F.col("id").alias("vtx"), *[c for c in rows.columns if c != "id"])).alias("value"))


def egonet_json(g: Graph, sources: list[int]) -> DataFrame:
    """(value): one JSON text per vertex of the union of egonets, with its edges there; never one text for all."""
    e = egonet(g, sources, incident=True)
    per = e.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(F.struct("dst", "etype", "weight"))).alias("edges"))
    return per.select(F.to_json(F.struct("vertex", "edges")).alias("value"))


def subgraph_json(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(value): one JSON text per edge (source, target, type, weight and the labels of its ends)."""
    by = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    e = edges.join(by("src"), "src", "left").join(by("dst"), "dst", "left")
    return e.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("etype").alias("type"), "weight", "src_label", "dst_label")).alias("value"))


def typed_values(g: Graph, rows: DataFrame, value: str) -> DataFrame:
    """(id, name, type, typeid, value) of the vertices whose type is not 0."""
    v = g.vertices.where(F.col("vtype") != 0).select("id", "name", F.col("vtype").alias("typeid"))
    types = g.names.where("kind = 'vtype'").select(F.col("id").alias("typeid"), F.col("name").alias("type"))
    joined = rows.select("id", F.col(value).alias("value")).join(v, "id").join(broadcast_if_small(types), "typeid", "left")
    return joined.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", F.lit("")).alias("type"), "typeid", "value")


def write_values(g: Graph, rows: DataFrame, value: str, path: str) -> None:
    typed_values(g, rows, value).write.csv(path)


def write_histogram(g: Graph, rows: DataFrame, value: str, path: str, labels: bool = False) -> None:
    """Bins of the values, or sizes of the labels, of the vertices whose type is not 0."""
    typed = typed_values(g, rows, value)
    (size_histogram(typed, "value") if labels else histogram(typed, "value")).write.csv(path)
