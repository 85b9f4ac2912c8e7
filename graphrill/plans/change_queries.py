"""Queries of mutation, sources, sinks, scalar functions, streaming, SQL and requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.functions import scalar
from graphrill.functions.rpc import Rpc, RpcError
from graphrill.functions.sql import built_in, sql
from graphrill.model import EDGE, KEY, Graph
from graphrill.operators import mutate, ranking, stats, structure
from graphrill.operators.columns import positions
from graphrill.operators.cowstore import EdgeStore
from graphrill.operators.feed import ROW, edge_changes
from graphrill.operators.naming import once
from graphrill.plans import data_queries, table
from graphrill.plans.graph_queries import hub, hubs
from graphrill.plans.graphs import held, held_edges, trade
from graphrill.session import fresh_path, stored
from graphrill.sources import files, generate, sinks, templates
from graphrill.streaming import analytics, runtime, sessions
from graphrill.streaming.changes import follow

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql_text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql_text is not None:
            SQL[name] = sql_text
        return f

    return add


_EDGE = "etype, src, dst, weight, time_first, time_recent"
_TRADE = """trade AS MATERIALIZED (SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS etype, l_quantity::BIGINT AS weight, floor(epoch(l_shipdate))::BIGINT AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_HUB = "hub AS MATERIALIZED (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_HUBS = "hubs AS MATERIALIZED (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 5)"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """All insertions of the feed as a batch of edges, each row once, named and unset fields resolved by the reading rules."""
    changes = edge_changes(table(spark, d, "updates"), table(spark, d, "batches"), table(spark, d, "name_map"), identity=True)
    return changes.where("op = 'insert'").select(*KEY, "weight", F.col("at").alias("time"), F.struct(*ROW).alias("ord"))


_BATCH = data_queries._EDGES.split(",\ndel AS")[0][5:] + """, b AS MATERIALIZED (SELECT batch_id, seq, etype, src, dst, weight, coalesce(ts, 1) AS time FROM r2 WHERE op = 'insert')"""
_MERGE = """SELECT etype, src, dst, {0}::BIGINT AS weight, coalesce(e.time_first, n.f) AS time_first, coalesce(n.l, e.time_recent) AS time_recent FROM edges e FULL JOIN n USING (etype, src, dst)"""
_NEW = "n AS (SELECT etype, src, dst, sum(weight) AS s, min(time) AS f, max(time) AS l, arg_max(weight, (time, batch_id, seq)) AS w FROM {0} GROUP BY etype, src, dst)"


@query("c01_insert_set", f"WITH {_BATCH}, {_NEW.format('b')} {_MERGE.format('coalesce(n.w, e.weight)')}")
def c01_insert_set(spark, d):
    return mutate.insert(held(spark, d), _batch(spark, d), "set").edges


@query("c02_insert_incr", f"WITH {_BATCH}, {_NEW.format('b')} {_MERGE.format('coalesce(e.weight, 0) + coalesce(n.s, 0)')}")
def c02_insert_incr(spark, d):
    return mutate.insert(held(spark, d), _batch(spark, d), "incr").edges


@query("c03_insert_pairs", f"WITH {_BATCH}, p AS (SELECT * FROM b UNION ALL SELECT batch_id, seq, etype, dst, src, weight, time FROM b WHERE src <> dst), {_NEW.format('p')} {_MERGE.format('coalesce(e.weight, 0) + coalesce(n.s, 0)')}")
def c03_insert_pairs(spark, d):
    return mutate.insert(held(spark, d), _batch(spark, d), "incr", pairs=True).edges


@query("c03_pair_results", f"WITH {_BATCH}, k AS (SELECT DISTINCT etype, src, dst FROM b) SELECT k.*, ((e.src IS NULL)::INT + CASE WHEN r.src IS NULL AND k.src <> k.dst THEN 2 ELSE 0 END)::INT AS result FROM k LEFT JOIN edges e USING (etype, src, dst) LEFT JOIN edges r ON r.etype = k.etype AND r.src = k.dst AND r.dst = k.src")
def c03_pair_results(spark, d):
    return mutate.pair_insert_results(held(spark, d), _batch(spark, d))


def _deleted(spark, d):
    """All edges that the deletions of the feed name, and their reverses."""
    changes = edge_changes(table(spark, d, "updates"), table(spark, d, "batches"), table(spark, d, "name_map"))
    e = changes.where("op = 'delete'").select(*KEY)
    return e.union(e.select("etype", F.col("dst").alias("src"), F.col("src").alias("dst")))


_DELETED = data_queries._EDGES.split(",\ndel AS")[0][5:] + ", y AS (SELECT etype, src, dst FROM r2 WHERE op = 'delete'), x AS MATERIALIZED (SELECT etype, src, dst FROM y UNION SELECT etype, dst, src FROM y)"


@query("c04_remove", f"WITH {_DELETED} SELECT {_EDGE} FROM edges e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.etype = e.etype AND x.src = e.src AND x.dst = e.dst)")
def c04_remove(spark, d):
    return mutate.remove(held(spark, d), _deleted(spark, d)).edges


@query("c04_remove_results", f"WITH {_DELETED} SELECT x.*, CASE WHEN e.src IS NULL THEN -1 ELSE 1 END::INT AS result FROM x LEFT JOIN edges e USING (etype, src, dst)")
def c04_remove_results(spark, d):
    return mutate.remove_results(held(spark, d), _deleted(spark, d))


@query("c05_remove_pair_results", f"WITH {_DELETED} SELECT x.*, CASE WHEN e.src IS NULL OR r.src IS NULL THEN -1 ELSE 3 END::INT AS result FROM x LEFT JOIN edges e USING (etype, src, dst) LEFT JOIN edges r ON r.etype = x.etype AND r.src = x.dst AND r.dst = x.src")
def c05_remove_pair_results(spark, d):
    return mutate.remove_results(held(spark, d), _deleted(spark, d), pairs=True)


@query("c06_remove_type", f"SELECT {_EDGE} FROM edges WHERE etype <> 3")
def c06_remove_type(spark, d):
    return mutate.remove_type(held(spark, d), 3).edges


@query("c07_remove_vertices", f"WITH {_HUBS} SELECT {_EDGE} FROM edges WHERE src NOT IN (SELECT id FROM hubs) AND dst NOT IN (SELECT id FROM hubs)")
def c07_remove_vertices(spark, d):
    g = held(spark, d)
    return mutate.remove_vertices(g, hubs(g, 5)).edges


@query("c08_set_weights", "SELECT etype, src, dst, CASE WHEN etype = 1 THEN weight * 10 ELSE weight END AS weight, time_first, CASE WHEN etype = 2 THEN time_recent + 5 ELSE time_recent END AS time_recent FROM edges")
def c08_set_weights(spark, d):
    g = held(spark, d)
    e = g.edges
    g = mutate.set_weights(g, e.where("etype = 1").select(*KEY, (F.col("weight") * 10).alias("weight")))
    return mutate.touch(g, e.where("etype = 2").select(*KEY, (F.col("time_recent") + 5).alias("time"))).edges


@query("c09_batch_results", f"WITH {_BATCH}, f AS (SELECT etype, src, dst, min((time, batch_id, seq)) AS m FROM b ANTI JOIN edges USING (etype, src, dst) GROUP BY etype, src, dst) SELECT b.etype, b.src, b.dst, b.weight, b.time, b.batch_id, b.seq, coalesce((b.time, b.batch_id, b.seq) = f.m, false)::INT AS result FROM b LEFT JOIN f USING (etype, src, dst)")
def c09_batch_results(spark, d):
    return mutate.insert_results(held(spark, d), _batch(spark, d)).select(*KEY, "weight", "time", "ord.batch_id", "ord.seq", "result")


_ID = "CASE WHEN length(u.{0}_str) > 0 THEN {1}.id ELSE coalesce(u.{0}, {2}) END"


@query("c10_apply_batch", f"""WITH u AS (SELECT DISTINCT * EXCLUDE (metadata) FROM updates), x AS MATERIALIZED (SELECT u.op, {_ID.format('etype', 'e', 0)} AS etype,
    CASE WHEN length(u.src_str) > 0 THEN coalesce('n' || s.id, u.src_str) ELSE 'n' || coalesce(u.src, 0) END AS src, CASE WHEN length(u.dst_str) > 0 THEN coalesce('n' || d.id, u.dst_str) ELSE 'n' || coalesce(u.dst, 1) END AS dst, coalesce(u.weight, 1) AS weight, coalesce(u.time, 1) AS time
  FROM u LEFT JOIN name_map e ON e.kind = 'etype' AND e.name = u.etype_str LEFT JOIN name_map s ON s.kind = 'vertex' AND s.name = u.src_str LEFT JOIN name_map d ON d.kind = 'vertex' AND d.name = u.dst_str WHERE u.op <> 'vertex'),
n AS (SELECT etype, src, dst, sum(weight) AS w, min(time) AS f, max(time) AS l FROM x WHERE op = 'insert' GROUP BY ALL),
o AS (SELECT etype, 'n' || src AS src, 'n' || dst AS dst, weight, time_first, time_recent FROM edges),
m AS (SELECT etype, src, dst, (coalesce(o.weight, 0) + coalesce(n.w, 0))::BIGINT AS weight, coalesce(o.time_first, n.f) AS time_first, coalesce(n.l, o.time_recent) AS time_recent FROM o FULL JOIN n USING (etype, src, dst))
SELECT * FROM m ANTI JOIN (SELECT DISTINCT etype, src, dst FROM x WHERE op = 'delete') USING (etype, src, dst)""")
def c10_apply_batch(spark, d):
    """The whole feed as one batch, edge by edge; a new name's number is the engine's own, so its string stands for it."""
    g = held(spark, d)
    return _by_known_names(mutate.apply_batch(g, table(spark, d, "updates")), g)


def _by_known_names(g: Graph, before: Graph) -> DataFrame:
    """The edges of ``g`` with ends as texts: n and the id, or the name of a vertex that ``before`` does not know."""
    new = stored(g.names.where("kind = 'vertex'").join(before.names.where("kind = 'vertex'").select("id"), "id", "left_anti").select("id", "name"), "new")
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(new.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end, "left")
        e = e.withColumn(end, F.coalesce(f"{end}_name", F.concat(F.lit("n"), F.col(end)))).drop(f"{end}_name")
    return e.select(*EDGE)


@query("c11_update_vertices", """WITH u AS (SELECT DISTINCT (batch_id, seq) AS ord, src, src_str, vtype_str, set_weight, incr_weight FROM updates WHERE op = 'vertex'),
r AS (SELECT ord, CASE WHEN length(src_str) > 0 THEN m.id ELSE coalesce(src, 0) END AS id, t.id AS vtype, set_weight, incr_weight FROM u LEFT JOIN name_map m ON m.kind = 'vertex' AND m.name = src_str LEFT JOIN name_map t ON t.kind = 'vtype' AND t.name = vtype_str),
n AS (SELECT id, arg_max(vtype, ord) FILTER (vtype IS NOT NULL) AS t, arg_max(set_weight, ord) FILTER (set_weight IS NOT NULL) AS s, coalesce(sum(incr_weight), 0)::BIGINT AS i FROM r WHERE id IS NOT NULL GROUP BY id)
SELECT id, coalesce(n.t, v.vtype, 0) AS vtype, CASE WHEN n.id IS NULL THEN v.weight ELSE coalesce(n.s, v.weight, 0) + n.i END AS weight FROM vertices v FULL JOIN n USING (id)""")
def c11_update_vertices(spark, d):
    g = held(spark, d)
    rows = once(table(spark, d, "updates").where("op = 'vertex'"), ROW, ["src", "src_str", "vtype_str", "set_weight", "incr_weight"]).withColumn("ord", F.struct(*ROW))
    rows = mutate.resolve(g.names, rows, "vertex", "src_str", "src", 0).dropna(subset=["src"])
    rows = mutate.resolve(g.names, rows.withColumn("vtype", F.lit(None).cast("bigint")), "vtype", "vtype_str", "vtype", -1)
    rows = rows.select(F.col("src").alias("id"), F.when(F.col("vtype") >= 0, F.col("vtype")).alias("vtype"), "set_weight", "incr_weight", "ord")
    return mutate.update_vertices(g, rows).vertices.select("id", "vtype", "weight")


@query("c13_sort_actions", f"WITH {_BATCH}, a AS (SELECT src, dst, false AS is_del FROM b UNION ALL SELECT src, dst, true FROM r2 WHERE op = 'delete') SELECT src, is_del, dst FROM a WHERE src <> dst UNION SELECT dst, is_del, src FROM a WHERE src <> dst")
def c13_sort_actions(spark, d):
    return mutate.sort_actions(_batch(spark, d), _deleted(spark, d))


@query("c14_remove_and_insert", f"WITH {_DELETED}, z AS (SELECT DISTINCT etype, src, dst FROM y) SELECT etype, src, dst, 7::BIGINT AS weight, 99::BIGINT AS time_first, 99::BIGINT AS time_recent FROM z UNION ALL SELECT {_EDGE} FROM edges ANTI JOIN x USING (etype, src, dst) ANTI JOIN z USING (etype, src, dst)")
def c14_remove_and_insert(spark, d):
    """The edges that deletions name come back anew; their reverses go."""
    changes = edge_changes(table(spark, d, "updates"), table(spark, d, "batches"), table(spark, d, "name_map"))
    e = changes.where("op = 'delete'").select(*KEY).distinct()
    return mutate.remove_and_insert(held(spark, d), e.select(*KEY, F.lit(7).alias("weight")), _deleted(spark, d), 99).edges


@query("c15_new_names", "WITH n AS (SELECT src_str AS name, min((batch_id, seq)) AS o FROM updates WHERE length(src_str) > 0 AND NOT EXISTS (SELECT 1 FROM name_map m WHERE m.kind = 'vertex' AND m.name = src_str) GROUP BY src_str) SELECT 'vertex' AS kind, (SELECT max(id) FROM name_map WHERE kind = 'vertex') + row_number() OVER (ORDER BY o, encode(name)) AS id, name FROM n")
def c15_new_names(spark, d):
    g = held(spark, d)
    rows = table(spark, d, "updates").select(F.lit("vertex").alias("kind"), F.col("src_str").alias("name"), F.struct(*ROW).alias("ord"))
    return mutate.new_names(g, rows).names.join(g.names, ["kind", "name"], "left_anti").select("kind", "id", "name")


@query("c16_adjacency", "SELECT src, count(*) AS edges, (sum(count(*)) OVER (ORDER BY src) - count(*))::BIGINT AS offset FROM edges GROUP BY src")
def c16_adjacency(spark, d):
    return mutate.adjacency(held(spark, d))


@query("c16_trade_graph", f"WITH {_TRADE} SELECT etype, src, dst, sum(weight)::BIGINT AS weight, min(t) AS time_first, max(t) AS time_recent FROM trade GROUP BY etype, src, dst")
def c16_trade_graph(spark, d):
    rows = trade(spark, d).withColumnRenamed("t", "time")
    return mutate.insert(Graph.empty(spark), rows, "incr").edges


# Sources and sinks: what is written is read again.
@query("a01_csv_graph", "SELECT t.name AS etype_name, src, dst, weight, time_first, time_recent FROM (SELECT etype, src, dst, weight, time_recent AS time_first, time_recent FROM edges) e JOIN name_map t ON t.kind = 'etype' AND t.id = e.etype")
def a01_csv_graph(spark, d):
    g = held(spark, d)
    types = lambda n: F.broadcast(n.where("kind = 'etype'").select(F.col("id").alias("etype"), F.col("name").alias("etype_name")))
    path = fresh_path(spark, "csv")
    g.edges.join(types(g.names), "etype").select(F.concat_ws(",", "src", "dst", "weight", "time_recent", "etype_name")).write.text(path)
    back = files.csv_graph(spark, path, numeric=True)
    return back.edges.join(types(back.names), "etype").select("etype_name", "src", "dst", "weight", "time_first", "time_recent")


@query("a01_csv_named_graph", "SELECT s.name AS src_name, t.name AS dst_name, y.name AS etype_name, e.weight, e.time_recent FROM edges e JOIN name_map s ON s.kind = 'vertex' AND s.id = e.src JOIN name_map t ON t.kind = 'vertex' AND t.id = e.dst JOIN name_map y ON y.kind = 'etype' AND y.id = e.etype WHERE NOT contains(s.name, ',') AND NOT contains(t.name, ',')")
def a01_csv_named_graph(spark, d):
    g = held(spark, d)
    name = lambda c, k: g.names.where(F.col("kind") == k).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    e = g.edges.join(name("src", "vertex"), "src").join(name("dst", "vertex"), "dst").join(name("etype", "etype"), "etype").where("NOT contains(src_name, ',') AND NOT contains(dst_name, ',')")
    path = fresh_path(spark, "csv")
    e.select(F.concat_ws(",", "src_name", "dst_name", "weight", "time_recent", "etype_name")).write.text(path)
    back = files.csv_graph(spark, path)
    n = lambda c, k: back.names.where(F.col("kind") == k).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return back.edges.join(n("src", "vertex"), "src").join(n("dst", "vertex"), "dst").join(n("etype", "etype"), "etype").select("src_name", "dst_name", "etype_name", "weight", "time_recent")


_SHIFT = "m AS (SELECT max(l_orderkey) AS m FROM lineitem)"


@query("a03_dimacs_graph", f"WITH {_SHIFT} SELECT 0::BIGINT AS etype, l_orderkey AS src, m + 1 + l_partkey AS dst, max(l_quantity)::BIGINT AS weight FROM lineitem, m GROUP BY l_orderkey, l_partkey, m")
def a03_dimacs_graph(spark, d):
    """Orders and, after the last of them, parts; ids are written from 1 on, as the format wants them, and come back from 0 on."""
    path = fresh_path(spark, "dimacs")
    lines = table(spark, d, "lineitem")
    top = lines.agg(F.max("l_orderkey").alias("o"), F.max("l_partkey").alias("p"), F.count(F.lit(1)).alias("n")).head()
    rows = lines.groupBy("l_orderkey", (F.col("l_partkey") + top["o"] + 2).alias("t")).agg(F.max(F.col("l_quantity").cast("bigint")).alias("w"))
    arcs = rows.select(F.concat_ws(" ", F.lit("a"), F.col("l_orderkey") + 1, "t", "w").alias("value"))
    spark.createDataFrame([("c made from a table",), (f"p sp {top['o'] + top['p'] + 2} {top['n']}",)], "value string").union(arcs).write.text(path)
    return files.dimacs_graph(spark, path).edges.select("etype", "src", "dst", "weight")


_ADJACENT = "ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"


@query("a04_metis_graph", f"WITH {_ADJACENT} SELECT s.n::VARCHAR AS src_name, t.n::VARCHAR AS dst_name, sum(weight)::BIGINT AS weight FROM edges JOIN ids s ON s.id = src JOIN ids t ON t.id = dst GROUP BY ALL")
def a04_metis_graph(spark, d):
    """Vertices are numbered in the order of their ids; a line for each has its neighbours and weights."""
    g = held_edges(spark, d)
    ids = stored(positions(g.ids(), [F.col("id")]).select("id", "pos"), "ids")
    e = g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(ids.select(F.col("id").alias("dst"), (F.col("pos") + 1).alias("t")), "dst")
    lists = e.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "w"))), lambda x: F.concat_ws(" ", x["t"], x["w"])), " ").alias("value"))  # a line has all neighbours
    rows = ids.join(lists, F.col("id") == F.col("src"), "left").select("pos", F.coalesce("value", F.lit("")).alias("value"))
    path = fresh_path(spark, "metis")
    head = spark.createDataFrame([(-1, f"{ids.count()} {e.count()} 1")], "pos bigint, value string")
    head.union(rows).orderBy("pos").select("value").write.text(path)
    back = files.metis_graph(spark, path)
    n = lambda c: back.names.where("kind = 'vertex'").select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return back.edges.join(n("src"), "src").join(n("dst"), "dst").select("src_name", "dst_name", "weight")


@query("a05_json_graph", "SELECT s_name AS src_name, n_name AS dst_name, s_suppkey AS weight, 'of' AS etype_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def a05_json_graph(spark, d):
    """One document of all suppliers and nations."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edge = F.struct(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.col("s_suppkey").alias("weight"), F.lit("of").alias("type"))
    doc = rows.agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"), F.collect_list(F.struct(F.col("s_name").alias("name"), F.lit("supplier").alias("type"))).alias("vertices"))).alias("value"))  # the format is one document
    path = fresh_path(spark, "json")
    doc.write.text(path)
    back = files.json_graph(spark, path)
    n = lambda c, k: back.names.where(F.col("kind") == k).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return back.edges.join(n("src", "vertex"), "src").join(n("dst", "vertex"), "dst").join(n("etype", "etype"), "etype").select("src_name", "dst_name", "weight", "etype_name")


@query("a07_csr_graph", "SELECT 0::BIGINT AS etype, src, dst, weight FROM edges")
def a07_csr_graph(spark, d):
    """All edges as compressed rows and back."""
    g = held(spark, d)
    targets = positions(g.edges.select("src", "etype", "dst", "weight"), [F.col("src"), F.col("etype"), F.col("dst")]).select("pos", F.col("dst").alias("target"), "weight")
    return files.csr_frames(mutate.adjacency(g).select(F.col("src").alias("pos"), "offset"), targets).edges.select("etype", "src", "dst", "weight")


@query("a09b_ordered_template", "SELECT o_custkey AS src, o_orderkey AS dst, o_custkey + o_orderkey AS weight FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_custkey + o_orderkey FROM orders")
def a09b_ordered_template(spark, d):
    """Two sources and two destinations in a line combine by position; the one weight holds for both."""
    lines = table(spark, d, "orders").select(F.concat_ws(",", "o_custkey", "o_orderkey", "o_orderkey", "o_custkey", F.col("o_custkey") + F.col("o_orderkey")).alias("value"))
    rows = templates.csv_updates(lines, "$source1ordered,$source1ordered,$destination1ordered,$destination1ordered,$weight1ordered")
    return rows.select("src", "dst", "weight")


@query("a06_saved_graph", f"SELECT {_EDGE} FROM edges")
def a06_saved_graph(spark, d):
    path = fresh_path(spark, "saved")
    files.save(held(spark, d), path)
    return files.open_saved(spark, path).edges


@query("a08_csv_template", "SELECT c_custkey AS src, NULL::VARCHAR AS src_str, NULL::BIGINT AS dst, o_orderpriority AS dst_str, NULL::BIGINT AS etype, 'orders' AS etype_str, o_orderkey AS weight, 'customer' AS source_type FROM orders JOIN customer ON c_custkey = o_custkey")
def a08_csv_template(spark, d):
    lines = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority", F.lit("x")).alias("value"))
    rows = templates.csv_updates(lines, "$weight1|$source1|$destination_str1|na|$type_str1=orders|$source_type1=customer", separator="|")
    return rows.select("src", "src_str", "dst", "dst_str", "etype", "etype_str", "weight", "source_type")


_MENTIONS = json.dumps({"at": "$time_unix1", "user": {"name": "$source_str1"}, "entities": {"mentions": [{"name": "$destination_str1"}]}, "t": "$type_str1=mention"})


@query("a09_json_template", "SELECT o_custkey::VARCHAR AS src_str, 'p' || l_partkey AS dst_str, 'mention' AS etype_str, strftime(make_timestamp(o_orderkey * 1000000), '%Y%m%d%H%M%S')::BIGINT AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def a09_json_template(spark, d):
    """One record per order with a mention for each of its lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("p"), "l_partkey").alias("name"))).alias("mentions"))  # an order has few lines
    docs = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_json(F.struct(F.col("o_orderkey").alias("at"), F.struct(F.col("o_custkey").cast("string").alias("name")).alias("user"), F.struct("mentions").alias("entities"))).alias("value"))
    return templates.json_updates(docs, [_MENTIONS]).select("src_str", "dst_str", "etype_str", "time")


@query("a10_flows", "SELECT '10.0.0.' || user_id % 256 AS src_str, '80' AS src_port, '10.1.0.' || event_id % 256 AS dst_str, event_type AS etype_str, event_id AS weight, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS time FROM events")
def a10_flows(spark, d):
    e = table(spark, d, "events")
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    line = F.concat_ws(" ", clock, F.lit("0.5"), "event_type", F.concat(F.lit("10.0.0."), F.col("user_id") % 256, F.lit(":80")), F.lit("->"), F.concat(F.lit("10.1.0."), F.col("event_id") % 256, F.lit(":443")), F.lit("3"), "event_id")
    head = spark.createDataFrame([("Date flow start Duration Proto",)], "value string")
    return files.flows(head.union(e.select(line.alias("value")))).select("src_str", "src_port", "dst_str", "etype_str", "weight", "time")


@query("a11_rmat")
def a11_rmat(spark, d):
    return generate.rmat(spark, 12, 20_000, seed=1)


@query("a12_random_edges")
def a12_random_edges(spark, d):
    return generate.random_edges(spark, 1000, 10_000, seed=1)


@query("a13_vertex_names", "SELECT id, 'v' || id AS name FROM vertices")
def a13_vertex_names(spark, d):
    return generate.vertex_names(held(spark, d).vertices.select("id"))


@query("a17_stream_buffer", "SELECT 'insert' AS op, 'a' AS src_str, 'b' AS dst_str, 3::BIGINT AS weight UNION ALL SELECT 'delete', 'a', 'c', NULL UNION ALL SELECT 'vertex', 'a', NULL, NULL UNION ALL SELECT 'insert', '1', '2', 4")
def a17_stream_buffer(spark, d):
    b = generate.StreamBuffer(spark)
    b.add_insert("a", "b", "t", 3)
    b.add_delete("a", "c")
    b.add_vertex_update("a", "person", incr_weight=2)
    b.send_batch()
    b.insert_json({"edges": [{"src": 1, "dest": 2, "weight": 4}, {"src": 1}], "immediate": True})
    return spark.read.parquet(b.folder).select("op", "src_str", "dst_str", "weight")


@query("a18_clique", "SELECT a.range AS src, b.range AS dst FROM range(30) a, range(30) b WHERE a.range <> b.range")
def a18_clique(spark, d):
    return generate.clique(spark, 30).edges.select("src", "dst")


@query("b02_dump", "SELECT src || ' ' || dst || ' ' || etype || ' ' || weight || ' ' || time_first || ' ' || time_recent AS value FROM edges")
def b02_dump(spark, d):
    path = fresh_path(spark, "dump")
    sinks.dump_edges(held(spark, d), path)
    return spark.read.text(path)


@query("b03_history", "SELECT src AS id, count(*) AS outdegree, 3::BIGINT AS batch FROM edges GROUP BY src UNION ALL SELECT src, count(*), 2 FROM edges GROUP BY src")
def b03_history(spark, d):
    path = fresh_path(spark, "history")
    for batch in (1, 2, 3):
        sinks.write_history({"degree": stats.out_degrees(held(spark, d))}, batch, path, keep=2)
    return sinks.history(spark, path, "degree").withColumn("batch", F.col("batch").cast("bigint"))


@query("b04_history_value", "SELECT src AS id, count(*) AS outdegree FROM edges GROUP BY src ORDER BY outdegree DESC, src LIMIT 1")
def b04_history_value(spark, d):
    g = held(spark, d)
    path, v = fresh_path(spark, "history"), hub(g)
    sinks.write_history({"degree": stats.out_degrees(g)}, 7, path)
    return sinks.history_value(spark, path, "degree", 7, v, "outdegree").select(F.lit(v).cast("bigint").alias("id"), "outdegree")


@query("b05_lookup_names", f"WITH {_HUBS} SELECT m.id, m.name FROM name_map m WHERE m.kind = 'vertex' AND m.id IN (SELECT id FROM hubs)")
def b05_lookup_names(spark, d):
    """By id and by name: the names of five hubs, asked for by the one or the other."""
    g = held(spark, d)
    ids = [r["id"] for r in hubs(g, 5).collect()]  # five
    names = [r["name"] for r in sinks.lookup_names(g, ids=ids[:3]).collect()]
    return sinks.lookup_names(g, ids=ids[3:], names=names)


@query("b06_documents", "SELECT '{\"time\":5,\"vtx\":' || src || ',\"outdegree\":' || count(*) || '}' AS value FROM edges GROUP BY src")
def b06_documents(spark, d):
    return sinks.documents(stats.out_degrees(held(spark, d)), 5)


@query("b07_egonet_json")
def b07_egonet_json(spark, d):
    g = held(spark, d)
    return sinks.egonet_json(g, [hub(g)])


@query("b08_typed_values", "SELECT v.id, coalesce(v.name, '') AS name, coalesce(t.name, '') AS type, v.vtype AS typeid, n.value FROM vertices v JOIN (SELECT src AS id, count(*) AS value FROM edges GROUP BY src) n USING (id) LEFT JOIN name_map t ON t.kind = 'vtype' AND t.id = v.vtype WHERE v.vtype <> 0")
def b08_typed_values(spark, d):
    g = held(spark, d)
    return sinks.typed_values(g, stats.out_degrees(g), "outdegree")


@query("b09_histogram_file", "SELECT n.value AS bin, count(*) AS n FROM vertices v JOIN (SELECT src AS id, count(*) AS value FROM edges GROUP BY src) n USING (id) WHERE v.vtype <> 0 GROUP BY n.value")
def b09_histogram_file(spark, d):
    g = held(spark, d)
    path = fresh_path(spark, "histogram")
    sinks.write_histogram(g, stats.out_degrees(g), "outdegree", path)
    return spark.read.schema("bin bigint, n bigint").csv(path)


# Scalar functions.
@query("h08_valid_names", "SELECT id, name, regexp_full_match(name, '[A-Za-z0-9_]+') AS valid FROM name_map")
def h08_valid_names(spark, d):
    return table(spark, d, "name_map").select("id", "name", scalar.is_valid_name(F.col("name")).alias("valid"))


@query("h11_safe_division", "SELECT id, round(CASE WHEN indegree <> 0 THEN outdegree / indegree ELSE -1 END, 9) AS ratio FROM (SELECT id, sum(o) AS outdegree, sum(i) AS indegree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id)")
def h11_safe_division(spark, d):
    return stats.degrees(held(spark, d)).select("id", F.round(scalar.safe_divide(F.col("outdegree"), F.col("indegree"), -1.0), 9).alias("ratio"))


@query("h13_vectors", "SELECT src, dst, weight % 2 = 0 AS starts, src::VARCHAR || ',' || dst || ',' || weight AS joined, src AS first FROM edges")
def h13_vectors(spark, d):
    a = F.array("src", "dst")
    first = F.when(F.col("weight") % 2 == 0, F.array("src")).otherwise(F.array(F.col("src") + 1))
    return held(spark, d).edges.select("src", "dst", scalar.starts_with(a, first).alias("starts"), F.array_join(scalar.append(a, F.array("weight")), ",").alias("joined"), scalar.truncate(scalar.prepend(F.array("dst"), F.array("src")), 1, array=True)[0].alias("first"))


@query("h04_times", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS a, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS b, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS c FROM events")
def h04_times(spark, d):
    e = table(spark, d, "events")
    stamp = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    a = F.concat(F.date_format(stamp, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(stamp, "yyyy"))
    b = F.concat(F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return e.select("event_id", scalar.ttr_time(a).alias("a"), scalar.ttr_time(b).alias("b"), scalar.compact(seconds).alias("c"))


@query("h10_metadata", """SELECT batch_id, seq, json_extract_string(metadata, '$.lang') AS lang, try_cast(json_extract_string(metadata, '$.score') AS INT) AS score FROM updates WHERE metadata LIKE '{%'""")
def h10_metadata(spark, d):
    m = F.col("metadata")
    return table(spark, d, "updates").where("metadata LIKE '{%'").select("batch_id", "seq", F.get_json_object(m, "$.lang").alias("lang"), F.get_json_object(m, "$.score").try_cast("int").alias("score"))


@query("h12_text_functions", "SELECT id, left(name, 5) AS short, name || '!' AS longer, starts_with(name, 'page:') AS page, length(name) AS n FROM vertices WHERE name IS NOT NULL")
def h12_text_functions(spark, d):
    n = F.col("name")
    return held(spark, d).vertices.where("name IS NOT NULL").select("id", scalar.truncate(n, 5).alias("short"), scalar.append(n, F.lit("!")).alias("longer"), n.startswith("page:").alias("page"), F.length(n).cast("bigint").alias("n"))


# Streaming.
def _feed_parts(spark: SparkSession, d: str, parts: int) -> list[DataFrame]:
    """The feed's rows in a few parts, each with whole batches in order."""
    rows = table(spark, d, "updates")
    top = rows.agg(F.max("batch_id")).head()[0]
    own = lambda i: rows.where((F.col("batch_id") > top * i // parts) & (F.col("batch_id") <= top * (i + 1) // parts))
    return [own(i).select(*[c.split()[0] for c in generate.FEED.split(", ")]).coalesce(1) for i in range(parts)]


def _feed_folder(spark: SparkSession, d: str, parts: int) -> tuple[str, DataFrame]:
    """The parts of the feed as files, for a stream to take one by one."""
    path = fresh_path(spark, "feed")
    for own in _feed_parts(spark, d, parts):
        own.write.mode("append").parquet(path)
    return path, table(spark, d, "updates")


def _streamed(spark: SparkSession, d: str, analytics_: list, parts: int = 2) -> runtime.Engine:
    """The engine after the feed; a part is written once the stream has taken the one before, whose file goes."""
    path, offsets = fresh_path(spark, "feed"), fresh_path(spark, "offsets")
    engine = runtime.Engine(spark, fresh_path(spark, "state"), analytics_, start=held(spark, d))
    for own in _feed_parts(spark, d, parts):
        own.write.mode("overwrite").parquet(path)
        q = engine.stream(runtime.read_feed(spark, path), offsets)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    engine.store.remove(path)
    return engine


@query("i01_streamed_degrees")
def i01_streamed_degrees(spark, d):
    engine = _streamed(spark, d, [analytics.Recompute("degree", stats.degrees)])
    return engine.graph.results["degree"]


@query("i08_rate_monitor")
def i08_rate_monitor(spark, d):
    return _streamed(spark, d, [analytics.RateMonitor()]).graph.results["rate_monitor"]


@query("i09_streamed_triangles")
def i09_streamed_triangles(spark, d):
    return _streamed(spark, d, [analytics.Triangles()]).graph.results["triangles"]


@query("i10_streamed_components")
def i10_streamed_components(spark, d):
    return _streamed(spark, d, [analytics.Components()]).graph.results["components"]


@query("i14_session_changes", f"WITH {_HUB} SELECT {', '.join('e.' + c for c in EDGE)} FROM edges e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst WHERE e.etype = 2 AND a.vtype = b.vtype AND a.vtype = (SELECT vtype FROM vertices WHERE id = (SELECT id FROM hub))")
def i14_session_changes(spark, d):
    g = held(spark, d).with_(results={"types": held(spark, d).vertices.select("id", "vtype")})
    s = sessions.Subgraph(g, "types", "vtype", hub(g))
    s.request()
    after = g.with_(edges=g.edges.where("etype <> 2"))
    s.update(g, after, None)
    return s.request()["deletions"]


@query("i16_places", "SELECT DISTINCT 48.5::DOUBLE AS lat, (o_orderkey % 90)::DOUBLE AS lon FROM orders")
def i16_places(spark, d):
    docs = table(spark, d, "orders").select(F.to_json(F.struct(F.struct(F.array(F.lit(48.5), (F.col("o_orderkey") % 90).cast("double")).alias("coordinates")).alias("geo"))).alias("metadata"))
    return sessions.LatLon().places(docs)


@query("i16_located_places", "SELECT DISTINCT (o_orderkey % 90)::DOUBLE AS lat, 7.5::DOUBLE AS lon, 0.25::DOUBLE AS sentiment, 'a,b' AS categories, 'r' || o_custkey AS ref FROM orders")
def i16_located_places(spark, d):
    o = table(spark, d, "orders")
    place = F.struct((F.col("o_orderkey") % 90).alias("lat"), F.lit(7.5).alias("lng"))
    docs = o.select(F.to_json(F.struct(place.alias("location"), F.lit(0.25).alias("sent"), F.array(F.lit("a"), F.lit("b")).alias("categories"), F.concat(F.lit("r"), "o_custkey").alias("ref"))).alias("metadata"))
    return sessions.LatLon("get_latlon_gnip").places(docs)


@query("i18_decay", "SELECT src AS id, round(0.5 * count(*), 6) AS value FROM edges GROUP BY src")
def i18_decay(spark, d):
    rows = stats.out_degrees(held(spark, d)).select("id", F.col("outdegree").cast("double").alias("value"))
    return analytics.decay(rows, "value", 0.5)


@query("i19_windows", "SELECT date_trunc('hour', b.sent_at AT TIME ZONE 'UTC')::VARCHAR AS start, op, count(*) AS n FROM updates JOIN batches b USING (batch_id) GROUP BY ALL")
def i19_windows(spark, d):
    rows = table(spark, d, "updates").join(table(spark, d, "batches"), "batch_id")
    return runtime.windows(rows).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# SQL and requests.
_VERTICES = """v AS (SELECT d.id, v.name, coalesce(v.vtype, 0) AS type, coalesce(v.weight, 0) AS weight, indegree, outdegree FROM (SELECT id, sum(o)::BIGINT AS outdegree, sum(i)::BIGINT AS indegree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id) d LEFT JOIN vertices v USING (id))"""


@query("l01_vertices", f"WITH {_VERTICES} SELECT id, name, type, weight, indegree, outdegree FROM v WHERE (outdegree >= 2 AND weight > 50) OR (type = 3 AND indegree BETWEEN 2 AND 5)")
def l01_vertices(spark, d):
    return sql(held(spark, d), "SELECT id, name, type, weight, indegree, outdegree FROM vertices WHERE (outdegree >= 2 AND weight > 50) OR (type = 3 AND indegree BETWEEN 2 AND 5)")


@query("l02_edges", "SELECT src AS source_vertex, dst AS target_vertex, etype AS type, weight, time_first AS first, time_recent AS last FROM edges WHERE weight * 2 % 3 = 1")
def l02_edges(spark, d):
    return sql(held(spark, d), "SELECT source_vertex, target_vertex, type, weight, first, last FROM edges WHERE weight * 2 % 3 = 1")


@query("l05_order_limit", f"WITH {_VERTICES} SELECT id, outdegree FROM v ORDER BY outdegree DESC, id LIMIT 10 OFFSET 3")
def l05_order_limit(spark, d):
    return sql(held(spark, d), "SELECT id, outdegree FROM vertices ORDER BY outdegree DESC, id LIMIT 10 OFFSET 3")


@query("l06_built_in", "SELECT v.id, coalesce(o.n, 0) AS vertex_outdegree, coalesce(i.n, 0) AS vertex_indegree, v.weight AS vertex_weight, v.vtype AS vertex_type_num, t.name AS vertex_type_name FROM vertices v LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY src) o USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) i USING (id) LEFT JOIN name_map t ON t.kind = 'vtype' AND t.id = v.vtype UNION ALL SELECT x.id, count(*) FILTER (o), count(*) FILTER (NOT o), NULL, NULL, NULL FROM (SELECT src AS id, true AS o FROM edges UNION ALL SELECT dst, false FROM edges) x WHERE NOT EXISTS (SELECT 1 FROM vertices v WHERE v.id = x.id) GROUP BY x.id")
def l06_built_in(spark, d):
    return built_in(held(spark, d))


@query("k04_rpc_top_k", "SELECT id, n AS outdegree, coalesce(m.name, '') AS name FROM (SELECT src AS id, count(*) AS n FROM edges GROUP BY src ORDER BY n DESC, src LIMIT 10) LEFT JOIN name_map m USING (id) WHERE coalesce(m.kind, 'vertex') = 'vertex'")
def k04_rpc_top_k(spark, d):
    g = held(spark, d)
    g = g.with_(results={"degree": stats.out_degrees(g)})
    return Rpc(lambda: g).call("get_data_array_sorted_range", {"name": "degree", "data": "outdegree", "offset": 0, "count": 10, "strings": True}).drop("pos")


def _rpc(spark, d) -> Rpc:
    g = held(spark, d)
    g = g.with_(results={"degree": stats.degrees(g), "types": g.vertices.where("vtype IS NOT NULL").select("id", F.col("vtype").alias("label"))})
    return Rpc(lambda: g)


@query("k04_rpc_egonet", f"WITH {_HUB}, b AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), n AS (SELECT nbr AS id FROM b WHERE id = (SELECT id FROM hub) UNION SELECT id FROM hub) SELECT {_EDGE} FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def k04_rpc_egonet(spark, d):
    """The vertex by its name, as a client gives it."""
    g = held(spark, d)
    v = hub(g)
    name = g.names.where((F.col("kind") == "vertex") & (F.col("id") == v)).select("name").head()
    return _rpc(spark, d).call("egonet", {"source": name[0] if name else v, "incident_edges": True})


@query("k04_rpc_data_array", "SELECT id, count(*) AS outdegree FROM (SELECT src AS id FROM edges) GROUP BY id UNION ALL SELECT DISTINCT dst, 0 FROM edges WHERE dst NOT IN (SELECT src FROM edges)")
def k04_rpc_data_array(spark, d):
    return _rpc(spark, d).call("get_data_array", {"name": "degree", "data": "outdegree"})


@query("k04_rpc_reduction", "SELECT 'outdegree' AS field, count(*)::DOUBLE AS value FROM edges UNION ALL SELECT 'indegree', count(*)::DOUBLE FROM edges UNION ALL SELECT 'degree', (SELECT count(*) FROM (SELECT etype, src, dst FROM edges UNION SELECT etype, dst, src FROM edges))::DOUBLE")
def k04_rpc_reduction(spark, d):
    return _rpc(spark, d).call("get_data_array_reduction", {"name": "degree", "op": "sum"})


@query("k04_rpc_member_of_component", "SELECT id FROM vertices WHERE vtype = (SELECT vtype FROM vertices WHERE vtype IS NOT NULL ORDER BY id LIMIT 1)")
def k04_rpc_member_of_component(spark, d):
    g = held(spark, d)
    labels = g.vertices.where("vtype IS NOT NULL").select("id", F.col("vtype").alias("label"))
    first = labels.agg(F.min("id")).head()[0]
    return Rpc(lambda: g.with_(results={"components": labels})).call("get_connected_component", {"source": first})


@query("k04_rpc_algorithms", "SELECT unnest(['graph', 'degree', 'types']) AS name")
def k04_rpc_algorithms(spark, d):
    return _rpc(spark, d).call("get_algorithms")


@query("e13_health", "SELECT 'total_edges' AS name, count(*)::DOUBLE AS value FROM edges UNION ALL SELECT 'max_time', max(time_recent)::DOUBLE FROM edges UNION ALL SELECT 'active_vertices', (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges))::DOUBLE")
def e13_health(spark, d):
    """The figures of the health request that the tables decide; the others are of the clock and the machine."""
    return _rpc(spark, d).call("get_server_health").where("name IN ('total_edges', 'max_time', 'active_vertices')")


@query("k05_error_codes", "SELECT * FROM (VALUES ('no method', -32601), ('missing', -32602), ('no vertex', -32602), ('no result', -32003), ('no column', -32002), ('no session', -32000), ('beyond', -32602), ('kind', -32602)) t(what, code)")
def k05_error_codes(spark, d):
    rpc = _rpc(spark, d)
    asked = {
        "no method": ("nothing", {}), "missing": ("egonet", {}), "no vertex": ("egonet", {"source": "\u0000 no such name"}), "no result": ("get_data_description", {"name": "zz"}), "no column": ("get_data_array", {"name": "degree", "data": "zz"}),
        "no session": ("request", {"session_id": 1}), "beyond": ("get_data_array_range", {"name": "degree", "data": "degree", "offset": 1 << 60, "count": 1}), "kind": ("get_data_array_range", {"name": "degree", "data": "degree", "offset": "x", "count": 1}),
    }
    codes = []
    for what, (method, params) in asked.items():
        try:
            rpc.call(method, params)
        except RpcError as e:
            codes.append((what, e.code))
    return spark.createDataFrame(codes, "what string, code int")


@query("k07_rpc_description", "SELECT unnest(['outdegree', 'indegree', 'degree']) AS name, 'bigint' AS type")
def k07_rpc_description(spark, d):
    g = held(spark, d)
    return Rpc(lambda: g.with_(results={"degree": stats.degrees(g)})).call("get_data_description", {"name": "degree"})


_HALF = """h AS (SELECT DISTINCT * EXCLUDE (metadata) FROM updates WHERE batch_id {0} (SELECT max(batch_id) FROM updates) // 2),
x AS MATERIALIZED (SELECT u.op, {1} AS etype, CASE WHEN length(u.src_str) > 0 THEN coalesce('n' || s.id, u.src_str) ELSE 'n' || coalesce(u.src, 0) END AS src,
    CASE WHEN length(u.dst_str) > 0 THEN coalesce('n' || d.id, u.dst_str) ELSE 'n' || coalesce(u.dst, 1) END AS dst, coalesce(u.weight, 1) AS weight, coalesce(u.time, 1) AS time
  FROM h u LEFT JOIN name_map e ON e.kind = 'etype' AND e.name = u.etype_str LEFT JOIN name_map s ON s.kind = 'vertex' AND s.name = u.src_str LEFT JOIN name_map d ON d.kind = 'vertex' AND d.name = u.dst_str WHERE u.op <> 'vertex')"""
_FIRST, _SECOND = (_HALF.format(c, _ID.format("etype", "e", 0)).replace("h AS", f"h{i} AS").replace("FROM h u", f"FROM h{i} u").replace("x AS", f"x{i} AS") for i, c in ((1, "<="), (2, ">")))


@query("i06_streamed_state", f"""WITH {_FIRST}, {_SECOND},
o AS (SELECT etype, 'n' || src AS src, 'n' || dst AS dst, weight FROM edges),
m1 AS (SELECT etype, src, dst, coalesce(o.weight, 0) + coalesce(n.w, 0) AS weight FROM o FULL JOIN (SELECT etype, src, dst, sum(weight) AS w FROM x1 WHERE op = 'insert' GROUP BY ALL) n USING (etype, src, dst)),
g1 AS MATERIALIZED (SELECT * FROM m1 ANTI JOIN (SELECT DISTINCT etype, src, dst FROM x1 WHERE op = 'delete') USING (etype, src, dst)),
m2 AS (SELECT etype, src, dst, coalesce(g1.weight, 0) + coalesce(n.w, 0) AS weight FROM g1 FULL JOIN (SELECT etype, src, dst, sum(weight) AS w FROM x2 WHERE op = 'insert' GROUP BY ALL) n USING (etype, src, dst))
SELECT etype, src, dst, weight::BIGINT AS weight FROM m2 ANTI JOIN (SELECT DISTINCT etype, src, dst FROM x2 WHERE op = 'delete') USING (etype, src, dst)""")
def i06_streamed_state(spark, d):
    """The state after the feed as a stream of two micro-batches, edge by edge."""
    return _by_known_names(_streamed(spark, d, []).graph, held(spark, d)).select(*KEY, "weight")


@query("i06_streamed_store", data_queries.SQL["p6_state"])
def i06_streamed_store(spark, d):
    """The feed as a stream of three micro-batches into a store of buckets; the state is that of all changes in their order."""
    path, _ = _feed_folder(spark, d, 3)
    store = EdgeStore(spark, fresh_path(spark, "edges"), 8)
    store.load(table(spark, d, "edges"))
    q = follow(store, runtime.read_feed(spark, path), table(spark, d, "batches"), table(spark, d, "name_map"), fresh_path(spark, "offsets"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return store.edges()


@query("i10_streamed_equals_static", "SELECT 0::BIGINT AS different, true AS some")
def i10_streamed_equals_static(spark, d):
    """Incremental components and triangles against those computed anew on the last state: no vertex differs."""
    engine = _streamed(spark, d, [analytics.Components(), analytics.Triangles()])
    g = engine.graph
    labels = g.results["components"].select("id", "label").exceptAll(structure.components(g))
    counts = g.results["triangles"].exceptAll(structure.triangles(g)).select("id", "triangles")
    both = labels.union(counts).agg(F.count(F.lit(1)).alias("different"))
    return both.crossJoin(g.results["triangles"].agg((F.sum("triangles") > 0).alias("some")))  # two single rows


@query("i11_warm_pagerank")
def i11_warm_pagerank(spark, d):
    g = held_edges(spark, d)
    first = stored(ranking.pagerank(g, epsilon=1e-6), "rank")
    return ranking.pagerank(g.with_(edges=g.edges.where("etype <> 5").select(*EDGE)), epsilon=1e-6, start=first)
