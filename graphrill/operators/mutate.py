"""Changes of a graph: pure functions from a snapshot and rows to the next snapshot, with the result of each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphrill.model import EDGE, KEY, Graph
from graphrill.operators.columns import positions
from graphrill.operators.lookups import heavy
from graphrill.operators.naming import once_in_place
from graphrill.session import FEW_ROWS, broadcast_if_small, cut, is_small, partitions, stored

#: Columns of a batch of edges: KEY, weight, time, and ord, of any type with an order, which breaks ties of time.
BATCH = [*KEY, "weight", "time", "ord"]
#: What unset fields of an update mean; fixed values of the message format.
DEFAULTS = {"etype": 0, "src": 0, "dst": 1, "weight": 1, "time": 1}


def batch(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of BATCH: unset fields have DEFAULTS; without ord, rows of equal key and time are equal."""
    have = set(rows.columns)
    value = {c: (F.coalesce(F.col(c), F.lit(DEFAULTS[c])) if c in have else F.lit(DEFAULTS[c])) for c in BATCH[:-1]}
    return rows.select(*[value[c].cast("bigint").alias(c) for c in BATCH[:-1]], (F.col("ord") if "ord" in have else F.lit(0).cast("bigint")).alias("ord"))


def mirrored(rows: DataFrame) -> DataFrame:
    """``rows`` and the same with src and dst exchanged; a self loop stays one row."""
    turned = {"src": "dst", "dst": "src"}
    return rows.union(rows.where("src <> dst").select(*[F.col(turned.get(c, c)).alias(c) for c in rows.columns]))


def insert(g: Graph, rows: DataFrame, how: str = "set", pairs: bool = False) -> Graph:
    """``g`` with the edges of ``rows`` (see batch) inserted or updated.

    'set': the weight is that of the last row in the order (time, ord); 'incr': the sum, added to that of an existing edge.
    A new edge has time_first from its first row; time_recent is that of the last row, even if it is older than before. The
    rows are aggregated by key, combined before the shuffle. If what is left of them is estimated to be small, it is
    broadcast and the edges stay where they are; else edges and rows meet by key.
    """
    rows = batch(rows)
    if pairs:
        rows = mirrored(rows)
    new = rows.groupBy(*KEY).agg(F.min("time").alias("_first"), *(
        [F.sum("weight").alias("_w"), F.max("time").alias("_last")] if how == "incr"
        else [F.max(F.struct("time", "ord", "weight")).alias("_end")]
    ))
    if how == "set":
        new = new.select(*KEY, "_first", F.col("_end.weight").alias("_w"), F.col("_end.time").alias("_last"))
    weight = F.coalesce("_w", "weight") if how == "set" else F.coalesce(F.col("weight") + F.col("_w"), "_w", "weight")
    values = [weight.alias("weight"), F.coalesce("time_first", "_first").alias("time_first"), F.coalesce("_last", "time_recent").alias("time_recent")]
    if not is_small(new):
        return g.with_(edges=g.edges.join(new, KEY, "full").select(*KEY, *values))
    updated = g.edges.join(F.broadcast(new), KEY, "left").select(*KEY, *values)
    there = g.edges.select(*KEY).join(F.broadcast(new.select(*KEY)), KEY, "left_semi")  # no more rows than new
    created = new.join(F.broadcast(there), KEY, "left_anti").select(*KEY, F.col("_w").alias("weight"), F.col("_first").alias("time_first"), F.col("_last").alias("time_recent"))
    return g.with_(edges=updated.unionByName(created))


def insert_results(g: Graph, rows: DataFrame) -> DataFrame:
    """(BATCH, result): 1 for the row that creates its edge, the first in the order (time, ord), else 0.

    Rows that are equal in all columns share the result 1 of the first only if ord tells them apart.
    """
    rows = batch(rows)
    first = rows.join(g.edges.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("time", "ord")).alias("_f"))
    joined = rows.join(first, KEY, "left")
    made = (F.col("time") == F.col("_f.time")) & (F.col("ord") == F.col("_f.ord"))
    return joined.select(*BATCH, F.coalesce(made.cast("int"), F.lit(0)).alias("result"))


def pair_insert_results(g: Graph, rows: DataFrame) -> DataFrame:
    """(etype, src, dst, result) of each distinct pair: 1 if src to dst is new, plus 2 if dst to src is."""
    keys = batch(rows).select(*KEY).distinct()
    have = g.edges.select(*KEY)
    there = keys.join(have.withColumn("_a", F.lit(1)), KEY, "left")
    back = have.select("etype", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_b"))
    both = there.join(back, KEY, "left")
    return both.select(*KEY, (F.when(F.col("_a").isNull(), 1).otherwise(0) + F.when(F.col("_b").isNull() & (F.col("src") != F.col("dst")), 2).otherwise(0)).alias("result"))


def _keys(rows: DataFrame) -> DataFrame:
    return broadcast_if_small(rows.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).cast("bigint").alias(c) for c in KEY]).distinct())


def remove(g: Graph, rows: DataFrame, pairs: bool = False) -> Graph:
    """``g`` without the edges of ``rows`` (KEY)."""
    keys = rows.select(*KEY)
    return g.with_(edges=g.edges.join(_keys(mirrored(keys) if pairs else keys), KEY, "left_anti").select(*EDGE))


def increment_and_remove(g: Graph, rows: DataFrame, pairs: bool = False) -> Graph:
    """``g`` after insert with 'incr' of the rows with op insert, then remove of those with op delete (KEY, op, weight, time).

    Edges and rows move once, by key, and are combined before.
    """
    gone = F.col("op") == "delete"
    fresh = batch(rows.where(~gone))
    fresh, lost = fresh.select(*KEY, "weight", "time", F.lit(False).alias("gone")), rows.where(gone).select(*KEY, F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("bigint").alias("time"), F.lit(True).alias("gone"))
    rows = fresh.union(lost)
    if pairs:
        rows = mirrored(rows)
    no = F.lit(None).cast("bigint")
    rows = rows.select(*KEY, no.alias("weight"), no.alias("time_first"), no.alias("time_recent"), F.col("weight").alias("_w"), F.col("time").alias("_t"), "gone")
    both = g.edges.select(*EDGE, no.alias("_w"), no.alias("_t"), F.lit(False).alias("gone")).union(rows)
    one = [F.max(c).alias(c) for c in ("weight", "time_first", "time_recent")]
    both = both.groupBy(*KEY).agg(*one, F.sum("_w").alias("_w"), F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("gone").alias("gone")).where(~F.col("gone"))
    weight = F.coalesce(F.col("weight") + F.col("_w"), "_w", "weight")
    return g.with_(edges=both.select(*KEY, weight.alias("weight"), F.coalesce("time_first", "_first").alias("time_first"), F.coalesce("_last", "time_recent").alias("time_recent")))


def remove_results(g: Graph, rows: DataFrame, pairs: bool = False) -> DataFrame:
    """(KEY, result) of each distinct row: 1 if the edge is removed, -1 if there is none; of pairs 1 + 2 if both directions
    are removed, -1 if either is missing (the other is removed all the same)."""
    keys = rows.select(*KEY).distinct()
    have = g.edges.select(*KEY)
    there = keys.join(have.withColumn("_a", F.lit(True)), KEY, "left")
    if not pairs:
        return there.select(*KEY, F.when(F.col("_a"), 1).otherwise(-1).alias("result"))
    back = have.select("etype", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_b"))
    return there.join(back, KEY, "left").select(*KEY, F.when(F.col("_a") & F.col("_b"), 3).otherwise(-1).alias("result"))


def remove_type(g: Graph, etype: int) -> Graph:
    return g.with_(edges=g.edges.where(F.col("etype") != etype))


def remove_vertices(g: Graph, vertices: DataFrame) -> Graph:
    """``g`` without the vertices (id), their edges in both directions and their names."""
    gone = broadcast_if_small(vertices.select("id").distinct())
    edges = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    names = g.names.where("kind <> 'vertex'").unionByName(g.names.where("kind = 'vertex'").join(gone, "id", "left_anti").select("kind", "id", "name"))
    return g.with_(edges=edges.select(*EDGE), vertices=g.vertices.join(gone, "id", "left_anti"), names=names)


def set_weights(g: Graph, rows: DataFrame) -> Graph:
    """``g`` with the weights of ``rows`` (KEY, weight), one row a key; keys without an edge change nothing."""
    new = rows.select(*KEY, F.col("weight").alias("_w"))
    return g.with_(edges=g.edges.join(new, KEY, "left").withColumn("weight", F.coalesce("_w", "weight")).select(*EDGE))


def touch(g: Graph, rows: DataFrame) -> Graph:
    """``g`` with time_recent of ``rows`` (KEY, time), one row a key; keys without an edge change nothing."""
    new = rows.select(*KEY, F.col("time").alias("_t"))
    return g.with_(edges=g.edges.join(new, KEY, "left").withColumn("time_recent", F.coalesce("_t", "time_recent")).select(*EDGE))


def found(g: Graph, rows: DataFrame) -> DataFrame:
    """(KEY, result): 1 if there is such an edge, else 0; the result of set_weights and touch."""
    return rows.select(*KEY).distinct().join(g.edges.select(*KEY, F.lit(1).alias("_f")), KEY, "left").select(*KEY, F.coalesce("_f", F.lit(0)).alias("result"))


def new_names(g: Graph, rows: DataFrame) -> Graph:
    """``g`` with names for ``rows`` (kind, name, ord) that it lacks: ids follow the greatest of their kind in the order of
    the first ord of each name, then the name. Null and empty names are left out. The order is counted over sorted parts."""
    rows = rows.where(F.length("name") > 0).groupBy("kind", "name").agg(F.min("ord").alias("ord"))
    missing = rows.join(g.names.select("kind", "name"), ["kind", "name"], "left_anti")
    top = F.broadcast(g.names.groupBy("kind").agg(F.max("id").alias("top")))  # one row a kind
    numbered = positions(missing, [F.col("kind"), F.col("ord"), F.col("name")])
    first = F.broadcast(numbered.groupBy("kind").agg(F.min("pos").alias("first")))  # one row a kind
    numbered = numbered.join(first, "kind").join(top, "kind", "left")
    new = numbered.select("kind", (F.coalesce("top", F.lit(-1)) + 1 + F.col("pos") - F.col("first")).cast("bigint").alias("id"), "name")
    # Read from a file the names have a known size.
    return g.with_(names=g.names.select("kind", "id", "name").union(stored(new, "names")))


def resolve(names: DataFrame, rows: DataFrame, kind: str, string: str, number: str, default: int, source: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``number`` replaced by the id of ``string`` where that is set, else the number, else the default; null if
    the string is no name.

    Names of a small size are broadcast, and those of types if they are few. Else rows without a string or with a frequent
    one stay where they are, and the others meet the names. The frequent ones are counted in ``source``: ``rows``, or what
    they were before other lookups, which then need not run for the count.
    """
    known = names.where(F.col("kind") == kind).select(F.col("name").alias("_name"), F.col("id").alias("_id"))
    spelled = F.coalesce(F.length(string) > 0, F.lit(False))
    value = lambda found: F.when(spelled, F.col(found)).otherwise(F.coalesce(number, F.lit(default)))
    if is_small(known) or (kind != "vertex" and known.limit(FEW_ROWS + 1).count() <= FEW_ROWS):
        return rows.join(F.broadcast(known), F.col(string) == F.col("_name"), "left").withColumn(number, value("_id")).drop("_name", "_id")
    frequent = cut(heavy(rows if source is None else source, F.when(spelled, F.col(string)), known, "_name", "_id"))
    tried = rows.join(F.broadcast(frequent), F.col(string) == F.col("_heavy"), "left")
    rest = spelled & F.col("_heavy").isNull()
    done = tried.where(~rest).withColumn(number, value("_heavy_value")).drop("_heavy", "_heavy_value")
    # Through coalesce no condition on the string reaches the names, whose shuffle other lookups then use again.
    met = tried.where(rest).drop("_heavy", "_heavy_value").join(known, F.coalesce(string, F.lit("")) == F.col("_name"), "left")
    return done.unionByName(met.withColumn(number, F.col("_id")).drop("_name", "_id"))


def update_vertices(g: Graph, rows: DataFrame) -> Graph:
    """``g`` with ``rows`` (id, vtype, set_weight, incr_weight, ord): the type of the last row that has one, the weight of the
    last set_weight plus all increments. Vertices that are new begin with type 0 and weight 0. If what is left of ``rows`` is
    estimated to be small, it is broadcast and the vertices stay where they are."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c]
    new = rows.groupBy("id").agg(last("vtype").alias("_t"), last("set_weight").alias("_s"), F.coalesce(F.sum("incr_weight"), F.lit(0)).alias("_i"))
    weight = F.coalesce("_s", "weight", F.lit(0)) + F.coalesce("_i", F.lit(0))
    values = ["id", "name", F.coalesce("_t", "vtype", F.lit(0)).alias("vtype"), F.when(F.col("_i").isNull(), F.col("weight")).otherwise(weight).alias("weight")]
    if not is_small(new):
        return g.with_(vertices=g.vertices.join(new, "id", "full").select(*values))
    updated = g.vertices.join(F.broadcast(new), "id", "left").select(*values)
    there = g.vertices.select("id").join(F.broadcast(new.select("id")), "id", "left_semi")  # no more rows than new
    created = new.join(F.broadcast(there), "id", "left_anti").withColumns({"name": F.lit(None).cast("string"), "vtype": F.lit(None).cast("bigint"), "weight": F.lit(None).cast("bigint")})
    return g.with_(vertices=updated.unionByName(created.select(*values)))


def apply_batch(g: Graph, updates: DataFrame, directed: bool = True, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Graph:
    """``g`` after a batch of updates (the schema of the feed): insertions, which always add weights, then deletions, then
    vertex updates. New names get ids in the order of (batch_id, seq); rows sent again count once. Undirected batches insert
    and delete both directions. An edge that a batch both inserts and deletes is gone. ``hold`` may write what is read several
    times, repeated rows, edges and vertices, and give back what it wrote."""
    cols = [c for c in updates.columns if c != "metadata"]
    rows = once_in_place(updates, ["batch_id", "seq"], cols, hold)
    rows = rows.withColumn("ord", F.struct("batch_id", "seq"))
    # Without ord, as sums of weights need no order.
    edges = unnamed = rows.where(F.col("op").isin("insert", "delete")).select("op", "etype", "etype_str", "src", "src_str", "dst", "dst_str", "weight", "time")
    given = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("name"), "ord")
    wanted = given(rows.where("op = 'insert'"), "vertex", "src_str").union(given(rows.where("op = 'insert'"), "vertex", "dst_str"))
    wanted = wanted.union(given(rows.where("op = 'insert'"), "etype", "etype_str")).union(given(rows.where("op = 'vertex'"), "vertex", "src_str")).union(given(rows.where("op = 'vertex'"), "vtype", "vtype_str"))
    g = new_names(g, wanted)
    for kind, side in (("etype", "etype"), ("vertex", "src"), ("vertex", "dst")):
        edges = resolve(g.names, edges, kind, f"{side}_str", side, DEFAULTS[side], unnamed)
    edges = hold(edges.dropna(subset=KEY).select(*KEY, "op", "weight", "time"), "rows_of_edges")
    if is_small(edges):
        g = insert(g, edges.where("op = 'insert'"), "incr", pairs=not directed)
        g = remove(g, edges.where("op = 'delete'"), pairs=not directed)
    else:
        g = increment_and_remove(g, edges, pairs=not directed)
    v = hold(rows.where("op = 'vertex'").select("src", "src_str", "vtype_str", "set_weight", "incr_weight", "ord"), "rows_of_vertices")
    names = g.names
    if is_small(v):
        # Few names remain, which are broadcast.
        names = hold(names.where("kind = 'vertex'").join(F.broadcast(v.select(F.col("src_str").alias("name")).distinct()), "name", "left_semi").select("kind", "id", "name"), "names_of_vertices")
    v = resolve(names, v, "vertex", "src_str", "src", DEFAULTS["src"]).dropna(subset=["src"])
    v = resolve(g.names, v.withColumn("vtype", F.lit(None).cast("bigint")), "vtype", "vtype_str", "vtype", -1)
    v = v.select(F.col("src").alias("id"), F.when(F.col("vtype") >= 0, F.col("vtype")).alias("vtype"), "set_weight", "incr_weight", "ord")
    return update_vertices(g, hold(v, "vertices"))


def sort_actions(insertions: DataFrame, deletions: DataFrame) -> DataFrame:
    """(src, is_del, dst), both directions and without self loops, each once, in the order of the vertex with deletions first."""
    rows = insertions.select("src", F.lit(False).alias("is_del"), "dst").union(deletions.select("src", F.lit(True), "dst"))
    return mirrored(rows.where("src <> dst")).distinct().orderBy("src", F.desc("is_del"), "dst")


def remove_and_insert(g: Graph, insertions: DataFrame, deletions: DataFrame, time: int) -> Graph:
    """``g`` after the deletions (KEY), then the insertions (KEY, weight) at one time."""
    return insert(remove(g, deletions), insertions.withColumn("time", F.lit(time)), "set")


def adjacency(g: Graph) -> DataFrame:
    """(src, offset, edges): how many edges each source has, and how many those before it have, in the order of sources.

    Counted over sorted parts: no task gets all sources.
    """
    per = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("edges"))
    held = cut(per.repartitionByRange(partitions(g.spark), "src").withColumn("part", F.spark_partition_id()))
    parts = held.groupBy("part").agg(F.sum("edges").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    inside = F.sum("edges").over(Window.partitionBy("part").orderBy("src")) - F.col("edges")
    return held.join(F.broadcast(parts.select("part", ahead.alias("ahead"))), "part").select("src", (inside + F.col("ahead")).alias("offset"), "edges")
