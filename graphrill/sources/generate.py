"""Generated graphs and hand-made batches. Random values are hashes of the row and a seed, so any partitioning gives the same."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.session import fresh_path

FEED = "batch_id bigint, seq bigint, op string, etype bigint, etype_str string, src bigint, src_str string, dst bigint, dst_str string, weight bigint, time bigint, vtype_str string, set_weight bigint, incr_weight bigint, metadata string"
#: Quadrant weights of the recursive generator; fixed values, used in proportion.
QUADRANTS = (0.55, 0.15, 0.15, 0.25)


def uniform(row: Column, *salt: int | Column) -> Column:
    """A number in [0, 1) for each row and salt."""
    return F.shiftrightunsigned(F.xxhash64(row, *[s if isinstance(s, Column) else F.lit(s) for s in salt]), 11) / F.lit(float(1 << 53))


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 0, quadrants: tuple[float, ...] = QUADRANTS, noise: float = 0.05) -> DataFrame:
    """(src, dst, weight, time) of about ``edges`` edges on 2^scale vertices by recursive choice of quadrants, whose weights
    vary by ``noise`` at each level; self loops are left out; time counts the edges from 1."""
    i = F.col("id")

    def choose(level: Column) -> Column:
        """The quadrant, 0 to 3, of an edge at a level."""
        q = [F.lit(w) * (1 - noise + 2 * noise * uniform(i, seed, level, k)) for k, w in enumerate(quadrants)]
        u = uniform(i, seed, level, 9) * (q[0] + q[1] + q[2] + q[3])
        return F.when(u < q[0], 0).when(u < q[0] + q[1], 1).when(u < q[0] + q[1] + q[2], 2).otherwise(3).cast("bigint")

    quadrant = F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), choose)
    bits = lambda bit: F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a * 2 + bit(x))
    rows = spark.range(edges).select("id", quadrant.alias("q"))
    rows = rows.select(bits(lambda x: F.shiftright(x, 1)).alias("src"), bits(lambda x: x % 2).alias("dst"), F.lit(1).cast("bigint").alias("weight"), (i + 1).alias("time"))
    return rows.where("src <> dst")


def random_edges(spark: SparkSession, vertices: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst, weight, time): uniform pairs of different vertices (at least two), weight 1, time counts from 1."""
    i = F.col("id")
    src = F.floor(uniform(i, seed, 1) * vertices)
    dst = (src + 1 + F.floor(uniform(i, seed, 2) * (vertices - 1))) % vertices
    return spark.range(edges).select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(1).cast("bigint").alias("weight"), (i + 1).alias("time"))


def vertex_names(rows: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` with a name for each id."""
    return rows.withColumn("name", F.concat(F.lit("v"), F.col(column)))


def clique(spark: SparkSession, n: int) -> Graph:
    """All ordered pairs of n vertices. The result has n * (n - 1) edges, as asked."""
    rows = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst")).where("src <> dst")
    return Graph.of(rows)


def core(spark: SparkSession, n: int, k: int) -> Graph:
    """n vertices in a ring, each linked both ways with the next ceil(k / 2) ones, so that all lie in a k-core."""
    half = (k + 1) // 2
    rows = spark.range(n * half).select(F.floor(F.col("id") / half).alias("src"), ((F.floor(F.col("id") / half) + 1 + F.col("id") % half) % n).alias("dst")).where("src <> dst")
    return Graph.of(rows.union(rows.select("dst", "src")).distinct())


def fresh_batch_id() -> int:
    """A random number below 2^62, from which a writer counts its batches, so that no two writers use the same."""
    return secrets.randbits(62)


class StreamBuffer:
    """Collects updates and writes them as one batch: by hand, when ``size`` is reached, at once, or ``every`` so many
    seconds, which add_*, tick and insert_json look at.

    Batches are files of the feed's schema in ``folder``, where a stream or reader of the feed finds them. (batch_id, seq)
    tells rows apart for good, also those of other buffers; within a buffer batch_id rises by one from ``batch_id``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, size: int = 0, strings: bool = True, every: float | None = None, batch_id: int | None = None, clock=time.monotonic):
        self.spark, self.size, self.strings, self.every, self.clock = spark, size, strings, every, clock
        self.folder = folder or fresh_path(spark, "feed")
        self.batch_id, self.rows, self.sent = fresh_batch_id() if batch_id is None else batch_id, [], clock()

    def _end(self, x) -> tuple:
        return (None, str(x)) if self.strings or isinstance(x, str) else (int(x), None)

    def _add(self, op: str, source=None, destination=None, etype=None, weight=None, time=None, vtype=None, set_weight=None, incr_weight=None) -> None:
        s, d = (self._end(x) if x is not None else (None, None) for x in (source, destination))
        e = (None, etype) if isinstance(etype, str) else (etype, None)
        self.rows.append((self.batch_id, len(self.rows), op, *e, *s, *d, weight, time, vtype, set_weight, incr_weight, None))
        if self.size and len(self.rows) > self.size:
            self.send_batch()
        self.tick()

    def tick(self) -> int:
        """Sends what was added if the time for it has come; the number of rows."""
        return self.send_batch() if self.every is not None and self.clock() - self.sent >= self.every else 0

    def add_insert(self, source, destination, etype=0, weight: int = 1, time: int = 1) -> None:
        self._add("insert", source, destination, etype, weight, time)

    def add_delete(self, source, destination, etype=0) -> None:
        self._add("delete", source, destination, etype)

    def add_vertex_update(self, vertex, vtype: str | None = None, set_weight: int | None = None, incr_weight: int | None = None) -> None:
        self._add("vertex", vertex, vtype=vtype, set_weight=set_weight, incr_weight=incr_weight)

    def insert_json(self, message: dict) -> None:
        """A message {edges: [{src, dest, type, weight, time}], vertices: [{vertex, type, set_weight, incr_weight}], immediate,
        strings}; edges that lack an end and vertex updates without a vertex are left out."""
        kept, self.strings = self.strings, message.get("strings", True)
        for v in message.get("vertices", []):
            if v.get("vertex") is not None:
                self.add_vertex_update(v["vertex"], v.get("type"), v.get("set_weight"), v.get("incr_weight"))
        for e in message.get("edges", []):
            if e.get("src") is not None and e.get("dest") is not None:
                self.add_insert(e["src"], e["dest"], e.get("type", 0), int(e.get("weight", 0)), int(e.get("time", 0)))
        self.strings = kept
        if message.get("immediate"):
            self.send_batch()

    def send_batch(self) -> int:
        """Writes what was added, if anything; the number of rows."""
        n = len(self.rows)
        if n:
            self.spark.createDataFrame(self.rows, FEED).coalesce(1).write.mode("append").parquet(self.folder)
            self.rows, self.batch_id = [], self.batch_id + 1
        self.sent = self.clock()
        return n

    flush = send_batch
