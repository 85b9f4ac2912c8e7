"""The graph: edges, vertices and names as DataFrames, and the views that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"
VERTICES = "id bigint, name string, vtype bigint, weight bigint"
NAMES = "kind string, id bigint, name string"
EDGE = ["etype", "src", "dst", "weight", "time_first", "time_recent"]
KEY = ["etype", "src", "dst"]


@dataclass(frozen=True)
class Graph:
    """An immutable snapshot. ``edges`` are directed and unique by (etype, src, dst); operators return new snapshots."""

    edges: DataFrame
    vertices: DataFrame
    names: DataFrame
    #: Per-vertex results by name, each with a column id.
    results: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def empty(cls, spark: SparkSession, etypes: tuple[str, ...] = (), vtypes: tuple[str, ...] = ()) -> Graph:
        """A graph without edges; type 0 of both kinds is 'None', the given names follow in order."""
        rows = [(kind, i, n) for kind, given in (("etype", etypes), ("vtype", vtypes)) for i, n in enumerate(("None", *given))]
        return cls(spark.createDataFrame([], EDGES), spark.createDataFrame([], VERTICES), spark.createDataFrame(rows, NAMES))

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, names: DataFrame | None = None) -> Graph:
        """A graph over ``edges``; missing weights are 1, missing times 0, missing types 0."""
        have = set(edges.columns)
        default = {"etype": 0, "weight": 1, "time_first": 0, "time_recent": 0}
        edges = edges.select(*[(F.coalesce(F.col(c), F.lit(default[c])) if c in default and c in have else F.col(c) if c in have else F.lit(default[c])).cast("bigint").alias(c) for c in EDGE])
        none = cls.empty(edges.sparkSession)
        if vertices is None:
            ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
            vertices = ids.select("id", F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("vtype"), F.lit(0).cast("bigint").alias("weight"))
        return cls(edges, vertices, none.names if names is None else names)

    def with_(self, **parts) -> Graph:
        return replace(self, **parts)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def of_type(self, etype: int | None) -> DataFrame:
        """The edges of a type, or all; the filter reaches the scan and prunes partitions by etype."""
        return self.edges if etype is None else self.edges.where(F.col("etype") == etype)

    def incident(self, etype: int | None = None) -> DataFrame:
        """(etype, id, nbr, is_out, is_in, weight, time_first, time_recent): one slot for each neighbour and type of a vertex.

        A pair of opposite edges is one slot with both flags, a self loop too. The values are those of the out edge where
        there is one, else of the in edge.
        """
        e = self.of_type(etype)
        rest = ["weight", "time_first", "time_recent"]
        out = e.select("etype", F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(True).alias("is_out"), F.lit(False).alias("is_in"), *rest)
        into = e.select("etype", F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(False).alias("is_out"), F.lit(True).alias("is_in"), *rest)
        values = [F.coalesce(F.max(F.when(F.col("is_out"), F.col(c))), F.max(c)).alias(c) for c in rest]
        return out.union(into).groupBy("etype", "id", "nbr").agg(F.max("is_out").alias("is_out"), F.max("is_in").alias("is_in"), *values)

    def slots(self, etype: int | None = None) -> DataFrame:
        """(etype, id, nbr), each once."""
        e = self.of_type(etype)
        return e.select("etype", F.col("src").alias("id"), F.col("dst").alias("nbr")).union(e.select("etype", "dst", "src")).distinct()

    def links(self, etype: int | None = None) -> DataFrame:
        """(a, b) with a < b: linked vertices, each pair once, whatever types and directions."""
        e = self.of_type(etype)
        return e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def both_ways(self, etype: int | None = None) -> DataFrame:
        """(id, nbr): each link in both directions, without self loops."""
        pairs = self.links(etype)
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(pairs.select("b", "a"))

    def ids(self) -> DataFrame:
        """(id): all vertices, those that only edges name included."""
        e = self.edges
        return self.vertices.select("id").union(e.select("src")).union(e.select("dst")).distinct()

    def active(self) -> DataFrame:
        """(id): the vertices with an edge in or out."""
        return self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
