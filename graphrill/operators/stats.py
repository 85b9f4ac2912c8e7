"""Degrees, counts, reductions, histograms and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.model import KEY, Graph


def degrees(g: Graph, etype: int | None = None) -> DataFrame:
    """(id, outdegree, indegree, degree) of the vertices with an edge; degree counts slots (type and neighbour).

    One shuffle by pair of vertices and one by vertex; both are combined before, so hubs do not load one task.
    """
    up = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").eqNullSafe(F.col("dst")))
    down = F.coalesce(F.col("src") >= F.col("dst"), F.lit(True))
    e = g.of_type(etype).select("etype", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), up.alias("up"), down.alias("down"))
    pairs = e.groupBy("etype", "a", "b").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    # A self loop is up and down, and one slot.
    slot = lambda at, o, i: F.struct(F.col(at).alias("id"), F.col(o).cast("int").alias("o"), F.col(i).cast("int").alias("i"))
    ends = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(slot("a", "up", "down"))).otherwise(F.array(slot("a", "up", "down"), slot("b", "down", "up")))
    long = lambda c: F.sum(c).cast("bigint")
    return pairs.select(F.inline(ends)).groupBy("id").agg(long("o").alias("outdegree"), long("i").alias("indegree"), F.count(F.lit(1)).alias("degree"))


def out_degrees(g: Graph, etype: int | None = None) -> DataFrame:
    return g.of_type(etype).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outdegree"))


def in_degrees(g: Graph, etype: int | None = None) -> DataFrame:
    return g.of_type(etype).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indegree"))


def totals(g: Graph, up_to: int | None = None) -> DataFrame:
    """One row: total_edges, edges_up_to (of sources below ``up_to``), active_vertices, max_active_vertex, max_time."""
    below = F.lit(True) if up_to is None else F.col("src") < up_to
    counts = g.edges.agg(F.count(F.lit(1)).alias("total_edges"), F.count_if(below).alias("edges_up_to"), F.max("time_recent").alias("max_time"))
    return counts.crossJoin(g.active().agg(F.count(F.lit(1)).alias("active_vertices"), F.max("id").alias("max_active_vertex")))  # two single rows


def graph_stats(g: Graph) -> DataFrame:
    """One row: vertices (names of vertices), edges, max_time, edge_types, vertex_types."""
    kinds = lambda k: F.count_if(F.col("kind") == k)
    of_names = g.names.agg(kinds("vertex").alias("vertices"), kinds("etype").alias("edge_types"), kinds("vtype").alias("vertex_types"))
    return of_names.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"), F.max("time_recent").alias("max_time")))  # two single rows


def check(g: Graph) -> DataFrame:
    """(problem, n): violations of each invariant; all are 0 in a sound graph."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    e = g.edges
    parts = [
        one("null key", e.where(F.col("etype").isNull() | F.col("src").isNull() | F.col("dst").isNull())),
        one("key not unique", e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where("c > 1")),
        one("recent before first", e.where("time_recent < time_first")),
        one("vertex not unique", g.vertices.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")),
        one("name not unique", g.names.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("c")).where("c > 1")),
    ]
    sums = degrees(g).agg(F.sum("outdegree").alias("o"), F.sum("indegree").alias("i"))
    parts.append(one("degree sums differ", sums.where("o <> i")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reduce_positive(rows: DataFrame, columns: list[str], op: str = "sum_positive") -> DataFrame:
    """(field, value): for each column the sum of its positive values ('sum_positive') or of all ('sum')."""
    value = {"sum_positive": lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0)), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0))}[op]
    sums = rows.agg(*[F.coalesce(value(c), F.lit(0)).cast("double").alias(c) for c in columns])
    return sums.unpivot([], columns, "field", "value")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(bin, n): rows for each value, of floating columns for each value cut to a whole number; null values count nowhere."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def label_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, size)."""
    return labels.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("size"))


def size_histogram(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, labels): how many labels have each number of members."""
    return label_sizes(labels, label).groupBy("size").agg(F.count(F.lit(1)).alias("labels"))


def label_stats(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: components, min_size, max_size, avg_size."""
    return label_sizes(labels, label).agg(F.count(F.lit(1)).alias("components"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("avg_size"))


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: created (labels that are new), joined (labels that are gone)."""
    a, b = before.select("label").distinct(), after.select("label").distinct()
    new = b.join(a, "label", "left_anti").agg(F.count(F.lit(1)).alias("created"))
    return new.crossJoin(a.join(b, "label", "left_anti").agg(F.count(F.lit(1)).alias("joined")))  # two single rows


def l1(a: DataFrame, b: DataFrame | None = None, value: str = "value") -> DataFrame:
    """One row ``l1``: the sum of the absolute values of ``a`` (id, value), or of its differences from ``b``; a missing id is 0."""
    if b is not None:
        a = a.select("id", F.col(value).alias("x")).join(b.select("id", F.col(value).alias("y")), "id", "full")
        return a.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))), F.lit(0.0)).alias("l1"))
    return a.agg(F.coalesce(F.sum(F.abs(value)), F.lit(0.0)).alias("l1"))


def normalised(a: DataFrame, value: str = "value") -> DataFrame:
    """``a`` with the value divided by the L1 norm; unchanged if that is 0."""
    norm = F.broadcast(l1(a, value=value))
    return a.crossJoin(norm).withColumn(value, F.when(F.col("l1") > 0, F.col(value) / F.col("l1")).otherwise(F.col(value))).drop("l1")  # one row


def quality(g: Graph, labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: coverage, modularity, conductance (mean over communities) and mirror_coverage of communities.

    Edges count by weight, in their direction; a vertex without a label is a community of its own. Coverage is the share of
    weight inside communities, mirror coverage the share of that weight whose opposite edge exists too.
    """
    by = lambda end: labels.select(F.col("id").alias(end), F.col(label).alias(f"_{end}"))
    e = g.edges.join(by("src"), "src", "left").join(by("dst"), "dst", "left")
    e = e.select(F.coalesce("_src", "src").alias("a"), F.coalesce("_dst", "dst").alias("b"), "src", "dst", "weight")
    flows = e.groupBy("a", "b").agg(F.sum("weight").alias("w"))
    ends = flows.select(F.col("a").alias("c"), F.col("w").alias("out"), F.lit(0).alias("in"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0).alias("inside"))
    ends = ends.union(flows.select("b", F.lit(0), "w", F.lit(0))).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("out", "in", "inside")])
    total = F.broadcast(flows.agg(F.sum("w").alias("m")))
    per = ends.crossJoin(total)  # one row
    volume = F.col("out") + F.col("in")
    cut = volume - 2 * F.col("inside")
    smaller = F.least(volume, 2 * F.col("m") - volume)
    result = per.agg(
        (F.sum("inside") / F.max("m")).alias("coverage"),
        F.sum(F.col("inside") / F.col("m") - F.col("out") * F.col("in") / (F.col("m") * F.col("m"))).alias("modularity"),
        F.avg(F.when(smaller > 0, cut / smaller).otherwise(0.0)).alias("conductance"),
    )
    inside = e.where("a = b")
    mirrored = inside.join(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_semi")
    share = mirrored.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("x")).crossJoin(inside.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("y")))  # single rows
    return result.crossJoin(share.select(F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(0.0).alias("mirror_coverage")))


def storage(df: DataFrame) -> DataFrame:
    """One row about the files behind a DataFrame: files, rows."""
    files = df.inputFiles()
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("files", F.lit(len(files)).cast("bigint"))


def compare(column: Column, op: str, value: int) -> Column:
    return {"=": column == value, "!=": column != value, "<>": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]
