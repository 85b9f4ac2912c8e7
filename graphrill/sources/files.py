"""Graphs and updates from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphrill.functions.scalar import flow_time, host, port
from graphrill.model import Graph
from graphrill.operators import mutate
from graphrill.operators.columns import positions
from graphrill.session import cut, partitions

TEXT = "_line string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): the lines of text files; ord rises within a file from line to line, also over splits."""
    rows = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i"))
    return rows.select("value", at.alias("ord"))


def csv_graph(spark: SparkSession, path: str, numeric: bool = False, separator: str = ",") -> Graph:
    """A graph from lines ``src,dst,weight[,time[,etype]]``: no quoting, no trimming; lines with fewer fields are left out.

    Ends are names, or with ``numeric`` ids; of repeated edges the last in the order of time has the weight.
    """
    parts = F.split("value", f"\\Q{separator}\\E", -1)
    get = lambda i: F.try_element_at(parts, F.lit(i))
    ord_ = positions(lines(spark, path).where(F.size(parts) >= 3), [F.col("ord")]).select("value", F.col("pos").alias("ord"))
    rows = ord_.select(get(1).alias("s"), get(2).alias("d"), get(3).try_cast("bigint").alias("weight"), get(4).try_cast("bigint").alias("time"), get(5).alias("e"), "ord")
    rows = rows.where("weight IS NOT NULL").withColumn("time", F.coalesce("time", F.lit(0)))
    return _from_strings(spark, rows, numeric)


def _from_strings(spark: SparkSession, rows: DataFrame, numeric: bool = False) -> Graph:
    """A graph of ``rows`` (s, d, weight, time, e, ord): weights are set; names get ids in the order of ord."""
    g = Graph.empty(spark)
    if numeric:
        rows = rows.withColumns({"src": F.col("s").try_cast("bigint"), "dst": F.col("d").try_cast("bigint")}).dropna(subset=["src", "dst"])
    name = lambda kind, c, k: rows.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), F.struct("ord", F.lit(k).alias("k")).alias("ord"))
    wanted = name("etype", "e", 0)
    if not numeric:
        wanted = wanted.union(name("vertex", "s", 0)).union(name("vertex", "d", 1))
    g = mutate.new_names(g, wanted)
    zero = F.lit(None).cast("bigint")
    rows = mutate.resolve(g.names, rows.withColumn("etype", zero), "etype", "e", "etype", 0)
    if not numeric:
        for end, c in (("src", "s"), ("dst", "d")):
            rows = mutate.resolve(g.names, rows.withColumn(end, zero), "vertex", c, end, 0)
    g = mutate.insert(g, rows.select("etype", "src", "dst", "weight", "time", "ord"), "set")
    of = Graph.of(g.edges)
    vertices = of.vertices.drop("name").join(g.names.where("kind = 'vertex'").select("id", "name"), "id", "left").select("id", "name", "vtype", "weight")
    return g.with_(vertices=vertices)


def dimacs_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from ``p <name> NV NE`` and ``a src dst weight`` lines. Ids that run from 1 to NV are shifted to begin at 0."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(parts.alias("t"))
    number = lambda i: F.try_element_at("t", F.lit(i)).try_cast("bigint")
    arcs = rows.where(F.col("t")[0] == "a").select(number(2).alias("src"), number(3).alias("dst"), number(4).alias("weight")).dropna()
    size = rows.where(F.col("t")[0] == "p").agg(F.max(number(3)).alias("nv"))
    least = arcs.agg(F.least(F.min("src"), F.min("dst")).alias("lo"), F.greatest(F.max("src"), F.max("dst")).alias("hi"))
    shift = F.broadcast(size.crossJoin(least).select(F.when((F.col("lo") > 0) & (F.col("hi") == F.col("nv")), 1).otherwise(0).alias("s")))  # one row
    arcs = arcs.crossJoin(shift).select(F.lit(0).cast("bigint").alias("etype"), F.col("src") - F.col("s"), F.col("dst") - F.col("s"), "weight").toDF("etype", "src", "dst", "weight")
    return Graph.of(mutate.insert(Graph.empty(spark), arcs.withColumn("time", F.lit(0)), "set").edges)


def metis_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from adjacency lines: a head ``nv ne [fmt [ncon]]``, then a line of neighbours (from 1) for each vertex.

    Lines that begin with % are comments; ncon numbers at the front of a line are skipped; with the last digit of fmt set a
    weight follows each neighbour. Vertices (from 0) are named by their numbers.
    """
    rows = positions(lines(spark, path).where(~F.col("value").startswith("%")), [F.col("ord")])
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    rows = rows.select("pos", numbers.alias("n"))
    head = rows.where("pos = 0").select(F.coalesce(F.try_element_at("n", F.lit(3)), F.lit(0)).alias("fmt"), F.coalesce(F.try_element_at("n", F.lit(4)), F.lit(0)).alias("ncon"), F.col("n")[0].alias("nv"))
    rows = rows.where("pos > 0").crossJoin(F.broadcast(head)).where("pos <= nv")  # one row
    rest = F.slice("n", F.col("ncon").cast("int") + 1, F.greatest(F.size("n") - F.col("ncon").cast("int"), F.lit(0)))
    rows = rows.select("pos", "fmt", F.posexplode(rest).alias("k", "v"), rest.alias("rest"))
    weighted = F.col("fmt") % 10 != 0
    rows = rows.where(~weighted | (F.col("k") % 2 == 0)).where("v > 0")
    w = F.when(weighted, F.try_element_at("rest", F.col("k") + 2)).otherwise(1)
    named = rows.select((F.col("pos") - 1).cast("string").alias("s"), (F.col("v") - 1).cast("string").alias("d"), F.coalesce(w, F.lit(1)).alias("weight"), F.lit(0).cast("bigint").alias("time"), F.lit(None).cast("string").alias("e"), F.struct("pos", "k").alias("ord"))
    return _from_strings(spark, named)


def json_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from one document ``{vertices: [{id or name, weight, type}], edges: [{source, target, weight, time, type}]}``.

    Ends that are not numbers are names. Types are names or numbers.
    """
    schema = "vertices array<struct<id:string,name:string,weight:bigint,type:string>>, edges array<struct<source:string,target:string,src:string,dest:string,weight:bigint,time:bigint,type:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    e = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.coalesce("e.source", "e.src").alias("s"), F.coalesce("e.target", "e.dest").alias("d"), F.coalesce("e.weight", F.lit(1)).alias("weight"), F.coalesce("e.time", F.lit(0)).alias("time"), F.col("e.type").alias("e"), F.col("ord").cast("bigint"))
    g = _from_strings(spark, e)
    v = doc.select(F.posexplode("vertices").alias("ord", "v")).select(F.coalesce("v.name", "v.id").alias("name"), F.col("v.weight").alias("set_weight"), F.col("v.type").alias("t"), F.col("ord").cast("bigint"))
    g = mutate.new_names(g, v.select(F.lit("vertex").alias("kind"), "name", "ord").union(v.select(F.lit("vtype"), "t", "ord")))
    zero = F.lit(None).cast("bigint")
    v = mutate.resolve(g.names, v.withColumns({"id": zero, "vtype": zero}), "vertex", "name", "id", -1)
    v = mutate.resolve(g.names, v, "vtype", "t", "vtype", 0)
    g = mutate.update_vertices(g, v.select("id", "vtype", "set_weight", F.lit(0).cast("bigint").alias("incr_weight"), "ord"))
    names = g.names.where("kind = 'vertex'").select("id", F.col("name").alias("n"))
    return g.with_(vertices=g.vertices.join(names, "id", "left").select("id", F.coalesce("name", "n").alias("name"), "vtype", "weight"))


FLOW_COLUMNS = "src_str string, src_port string, dst_str string, dst_port string, etype_str string, weight bigint, time bigint, duration double, packets bigint"


def flows(rows: DataFrame, line: str = "value") -> DataFrame:
    """The columns of FLOW_COLUMNS from text lines ``date time duration protocol src:port -> dst:port packets bytes``.

    Lines that do not begin with a digit are heads. Works on batch and streaming frames.
    """
    t = F.filter(F.split(F.col(line), r"\s+"), lambda x: x != "")
    rows = rows.where(F.col(line).rlike(r"\A[0-9]")).select(t.alias("t")).where(F.size("t") >= 9)
    c = F.col("t")
    return rows.select(
        host(c[4]).alias("src_str"), port(c[4]).alias("src_port"), host(c[6]).alias("dst_str"), port(c[6]).alias("dst_port"), c[3].alias("etype_str"),
        c[8].try_cast("bigint").alias("weight"), flow_time(c[0], c[1]).alias("time"), c[2].try_cast("double").alias("duration"), c[7].try_cast("bigint").alias("packets"),
    )


def csr_graph(spark: SparkSession, offsets: list[int], targets: list[int], weights: list[int] | None = None, etype: int = 0) -> Graph:
    """A graph of one type from compressed rows: the targets of source i are targets[offsets[i]:offsets[i + 1]]."""
    rows = [(etype, i, targets[k], weights[k] if weights else 1) for i in range(len(offsets) - 1) for k in range(offsets[i], offsets[i + 1])]
    return Graph.of(spark.createDataFrame(rows, "etype bigint, src bigint, dst bigint, weight bigint"))


def csr_frames(offsets: DataFrame, targets: DataFrame, etype: int = 0) -> Graph:
    """csr_graph from tables of any size: (pos, offset), one row more than sources, and (pos, target[, weight]).

    Each target belongs to the last source whose offset is not beyond it; sources of equal offsets have none, but the last. The
    two are merged in the order of positions over sorted parts, so no task gets all.
    """
    spark = offsets.sparkSession
    weight = F.col("weight") if "weight" in targets.columns else F.lit(1)
    none = F.lit(None).cast("bigint")
    rows = offsets.select(F.col("offset").alias("at"), F.col("pos").cast("bigint").alias("src"), none.alias("dst"), none.alias("weight"))
    rows = rows.union(targets.select("pos", none, F.col("target").cast("bigint"), weight.cast("bigint")))
    # A source comes before the targets at its offset.
    order = [F.col("at"), F.col("src").asc_nulls_last()]
    held = cut(rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    last = held.groupBy("part").agg(F.max("src").alias("m")).select("part", F.max("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one row a part
    own = F.max("src").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    e = held.withColumn("own", own).join(F.broadcast(last), "part").where("dst IS NOT NULL")
    return Graph.of(e.select(F.lit(etype).alias("etype"), F.coalesce("own", "before").alias("src"), "dst", "weight"))


def save(g: Graph, path: str) -> None:
    """Writes edges by type, vertices, names and results under ``path``."""
    g.edges.write.partitionBy("etype").parquet(f"{path}/edges")
    g.vertices.write.parquet(f"{path}/vertices")
    g.names.write.parquet(f"{path}/names")
    for name, rows in g.results.items():
        rows.write.parquet(f"{path}/results/{name}")


def open_saved(spark: SparkSession, path: str) -> Graph:
    """The graph that save wrote; a filter on etype reads only its folders."""
    from graphrill.model import EDGE, EDGES, NAMES, VERTICES

    edges = spark.read.schema(EDGES).parquet(f"{path}/edges").select(*EDGE)
    return Graph(edges, spark.read.schema(VERTICES).parquet(f"{path}/vertices"), spark.read.schema(NAMES).parquet(f"{path}/names"))
