"""Queries of the graph operators: scans, traversal, statistics, columns, subgraphs, analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import columns, communities, extract, paths, ranking, stats, structure, traverse
from graphrill.plans.graphs import FLOW, flow, held, held_edges, unrolled
from graphrill.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def hub(g: Graph) -> int:
    """The vertex with the most out edges, the least id of several."""
    return stats.out_degrees(g).orderBy(F.desc("outdegree"), "id").head()["id"]


def hubs(g: Graph, n: int) -> DataFrame:
    return stats.out_degrees(g).orderBy(F.desc("outdegree"), "id").limit(n).select("id")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_HUB = "hub AS MATERIALIZED (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_HUBS = "hubs AS MATERIALIZED (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 5)"
_FHUB = "hub AS MATERIALIZED (SELECT src AS id FROM flow GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_EDGE = "etype, src, dst, weight, time_first, time_recent"
_SLOTS = "slots AS (SELECT etype, src AS id, dst AS nbr FROM edges UNION SELECT etype, dst, src FROM edges)"
_INCIDENT = """inc AS (SELECT etype, id, nbr, bool_or(o) AS is_out, bool_or(NOT o) AS is_in, coalesce(max(weight) FILTER (o), max(weight)) AS weight,
  coalesce(max(time_first) FILTER (o), max(time_first)) AS time_first, coalesce(max(time_recent) FILTER (o), max(time_recent)) AS time_recent
  FROM (SELECT etype, src AS id, dst AS nbr, true AS o, weight, time_first, time_recent FROM edges UNION ALL SELECT etype, dst, src, false, weight, time_first, time_recent FROM edges) GROUP BY etype, id, nbr)"""
_BOTH = "both_ways AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"
_IDS = "ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
_FIDS = "ids AS MATERIALIZED (SELECT src AS id FROM flow UNION SELECT dst FROM flow)"
_DEG = """deg AS MATERIALIZED (SELECT id, sum(o)::BIGINT AS outdegree, sum(i)::BIGINT AS indegree, count(*) AS degree FROM (
  SELECT etype, id, nbr, max(o) AS o, max(i) AS i FROM (SELECT etype, src AS id, dst AS nbr, 1 AS o, 0 AS i FROM edges UNION ALL SELECT etype, dst, src, 0, 1 FROM edges) GROUP BY etype, id, nbr) GROUP BY id)"""


# Scans and lookups.
@query("a19_out_edges", f"WITH {_HUB} SELECT {_EDGE} FROM edges WHERE src = (SELECT id FROM hub)")
def a19_out_edges(spark, d):
    g = held(spark, d)
    return traverse.edges_of(g, hub(g))


@query("a19_in_edges_typed", "WITH h AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) SELECT etype, src, dst, weight, time_first, time_recent FROM edges WHERE dst = (SELECT id FROM h) AND etype = 1")
def a19_in_edges_typed(spark, d):
    g = held(spark, d)
    v = stats.in_degrees(g).orderBy(F.desc("indegree"), "id").head()["id"]
    return traverse.edges_of(g, v, "in", 1)


@query("a19_all_edges", f"WITH {_HUB}, {_INCIDENT} SELECT * FROM inc WHERE id = (SELECT id FROM hub)")
def a19_all_edges(spark, d):
    g = held(spark, d)
    return traverse.edges_of(g, hub(g), "both")


@query("a20_edges_of_type", f"SELECT {_EDGE} FROM edges WHERE etype = 2")
def a20_edges_of_type(spark, d):
    return traverse.edges_of_type(held(spark, d), 2)


@query("d01_successors", f"WITH {_HUBS} SELECT src AS id, etype, dst AS nbr, weight, time_first, time_recent FROM edges WHERE src IN (SELECT id FROM hubs)")
def d01_successors(spark, d):
    g = held(spark, d)
    return traverse.gather(g, hubs(g, 5))


@query("d02_predecessors", f"WITH {_HUBS} SELECT dst AS id, etype, src AS nbr, weight, time_first, time_recent FROM edges WHERE dst IN (SELECT id FROM hubs)")
def d02_predecessors(spark, d):
    g = held(spark, d)
    return traverse.gather(g, hubs(g, 5), "in")


@query("d03_neighbours", f"WITH {_HUBS}, {_INCIDENT} SELECT id, etype, nbr, weight, time_first, time_recent FROM inc WHERE id IN (SELECT id FROM hubs)")
def d03_neighbours(spark, d):
    g = held(spark, d)
    return traverse.gather(g, hubs(g, 5), "both")


@query("d04_typed_successors", f"WITH {_HUBS} SELECT src AS id, etype, dst AS nbr, weight, time_first, time_recent FROM edges WHERE src IN (SELECT id FROM hubs) AND etype = 1")
def d04_typed_successors(spark, d):
    g = held(spark, d)
    return traverse.gather(g, hubs(g, 5), "out", 1)


@query("d05_has_successor", "SELECT DISTINCT e.dst AS id, e.src AS nbr, r.src IS NOT NULL AS found FROM edges e LEFT JOIN (SELECT DISTINCT src, dst FROM edges WHERE etype = 1) r ON r.src = e.dst AND r.dst = e.src")
def d05_has_successor(spark, d):
    g = held(spark, d)
    return traverse.has_edge(g, g.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr")).distinct(), "out", 1)


@query("d06_edge_values", "SELECT k.etype, k.src, k.dst, coalesce(e.weight, 0) AS weight, coalesce(e.time_first, -1) AS time_first, coalesce(e.time_recent, -1) AS time_recent FROM (SELECT 1::BIGINT AS etype, src, dst FROM edges) k LEFT JOIN edges e USING (etype, src, dst)")
def d06_edge_values(spark, d):
    g = held(spark, d)
    return traverse.edge_values(g, g.edges.select(F.lit(1).cast("bigint").alias("etype"), "src", "dst"))


@query("d07_two_hops", f"WITH {_HUBS}, {_BOTH} SELECT DISTINCT a.id, b.nbr AS candidate FROM both_ways a JOIN both_ways b ON b.id = a.nbr WHERE a.id IN (SELECT id FROM hubs) AND b.nbr <> a.id AND NOT EXISTS (SELECT 1 FROM both_ways c WHERE c.id = a.id AND c.nbr = b.nbr)")
def d07_two_hops(spark, d):
    g = held(spark, d)
    return traverse.two_hops(g, hubs(g, 5))


@query("d08_common_neighbours", f"WITH {_BOTH} SELECT p.id AS a, p.nbr AS b, count(y.id) AS common FROM both_ways p LEFT JOIN both_ways x ON x.id = p.id LEFT JOIN both_ways y ON y.id = p.nbr AND y.nbr = x.nbr WHERE p.id < p.nbr GROUP BY p.id, p.nbr")
def d08_common_neighbours(spark, d):
    g = held(spark, d)
    return traverse.common_neighbours(g, g.links())


@query("d09_label_edges", f"SELECT {', '.join('e.' + c for c in ('etype', 'src', 'dst', 'weight', 'time_first', 'time_recent'))} FROM edges e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst WHERE a.vtype = b.vtype")
def d09_label_edges(spark, d):
    g = held(spark, d)
    return traverse.label_edges(g, g.vertices, "vtype")


@query("d10_names", "SELECT e.src, e.dst, e.etype, coalesce(s.name, '') AS src_name, coalesce(t.name, '') AS etype_name FROM edges e LEFT JOIN name_map s ON s.kind = 'vertex' AND s.id = e.src LEFT JOIN name_map t ON t.kind = 'etype' AND t.id = e.etype")
def d10_names(spark, d):
    g = held(spark, d)
    return traverse.with_names(traverse.with_names(g.edges.select("src", "dst", "etype"), g.names, "src"), g.names, "etype", "etype")


@query("d11_of_vtypes", f"WITH {_DEG} SELECT deg.* FROM deg JOIN vertices v USING (id) WHERE v.vtype IN (1, 3)")
def d11_of_vtypes(spark, d):
    g = held(spark, d)
    return traverse.of_vtypes(stats.degrees(g), g, [1, 3])


@query("d12_affected", f"WITH {_HUBS}, b AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM hubs)), e AS (SELECT src AS id FROM b UNION SELECT dst FROM b) SELECT id FROM e UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM e)")
def d12_affected(spark, d):
    g = held(spark, d)
    return traverse.affected(g, traverse.gather(g, hubs(g, 5)).select(F.col("id").alias("src"), F.col("nbr").alias("dst")))


# Statistics.
@query("e01_degrees", f"WITH {_DEG} SELECT * FROM deg")
def e01_degrees(spark, d):
    return stats.degrees(held(spark, d))


@query("e01_out_degrees", "SELECT src AS id, count(*) AS outdegree FROM edges GROUP BY src")
def e01_out_degrees(spark, d):
    return stats.out_degrees(held(spark, d))


@query("e02_typed_degrees", "WITH s AS (SELECT id, nbr, max(o) AS o, max(i) AS i FROM (SELECT src AS id, dst AS nbr, 1 AS o, 0 AS i FROM edges WHERE etype = 1 UNION ALL SELECT dst, src, 0, 1 FROM edges WHERE etype = 1) GROUP BY id, nbr) SELECT id, sum(o)::BIGINT AS outdegree, sum(i)::BIGINT AS indegree, count(*) AS degree FROM s GROUP BY id")
def e02_typed_degrees(spark, d):
    return stats.degrees(held(spark, d), 1)


@query("e03_totals", f"WITH {_IDS} SELECT (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE src < 500000) AS edges_up_to, (SELECT max(time_recent) FROM edges) AS max_time, count(*) AS active_vertices, max(id) AS max_active_vertex FROM ids")
def e03_totals(spark, d):
    return stats.totals(held(spark, d), 500_000)


@query("e06_check", "SELECT unnest(['null key', 'key not unique', 'recent before first', 'vertex not unique', 'name not unique', 'degree sums differ']) AS problem, 0::BIGINT AS n")
def e06_check(spark, d):
    return stats.check(held(spark, d))


@query("e07_reduction", f"WITH {_DEG}, s AS (SELECT sum(outdegree) FILTER (outdegree > 0) AS o, sum(indegree) FILTER (indegree > 0) AS i FROM deg) SELECT 'outdegree' AS field, o::DOUBLE AS value FROM s UNION ALL SELECT 'indegree', i::DOUBLE FROM s")
def e07_reduction(spark, d):
    return stats.reduce_positive(stats.degrees(held(spark, d)), ["outdegree", "indegree"])


@query("e08_histogram", "SELECT weight AS bin, count(*) AS n FROM vertices WHERE weight IS NOT NULL GROUP BY weight")
def e08_histogram(spark, d):
    return stats.histogram(held(spark, d).vertices, "weight")


_LINKS = "links AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM edges UNION SELECT dst, src FROM edges)"
_HOPS = 40
#: Labels that spread along links for more rounds than any component of the test tables is wide.
_COMPONENTS = f"{_IDS}, {_LINKS}, {unrolled('SELECT id, id AS label FROM ids', 'SELECT id, min(label) AS label FROM (SELECT id, label FROM {p} UNION ALL SELECT l.nbr, s.label FROM {p} s JOIN links l ON l.id = s.id) GROUP BY id', _HOPS)}, comp AS MATERIALIZED (SELECT id, label FROM s{_HOPS})"


@query("e09_size_histogram", f"WITH {_COMPONENTS} SELECT size, count(*) AS labels FROM (SELECT count(*) AS size FROM comp GROUP BY label) GROUP BY size")
def e09_size_histogram(spark, d):
    return stats.size_histogram(structure.components(held_edges(spark, d)))


@query("e10_component_sizes", f"WITH {_COMPONENTS} SELECT label, count(*) AS size FROM comp GROUP BY label")
def e10_component_sizes(spark, d):
    return stats.label_sizes(structure.components(held_edges(spark, d)))


@query("e11_component_stats", f"WITH {_COMPONENTS} SELECT count(*) AS components, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS avg_size FROM (SELECT count(*) AS size FROM comp GROUP BY label)")
def e11_component_stats(spark, d):
    return rounded(stats.label_stats(structure.components(held_edges(spark, d))), "avg_size")


@query("e11_label_changes", "WITH s AS (SELECT DISTINCT src AS id FROM edges), t AS (SELECT DISTINCT dst AS id FROM edges) SELECT (SELECT count(*) FROM t ANTI JOIN s USING (id)) AS created, (SELECT count(*) FROM s ANTI JOIN t USING (id)) AS joined")
def e11_label_changes(spark, d):
    """Labels that only sources have against labels that only destinations have."""
    e = held(spark, d).edges
    return stats.label_changes(e.select(F.col("src").alias("label")), e.select(F.col("dst").alias("label")))


@query("e12_graph_stats", "SELECT count(*) FILTER (kind = 'vertex') AS vertices, count(*) FILTER (kind = 'etype') AS edge_types, count(*) FILTER (kind = 'vtype') AS vertex_types, (SELECT count(*) FROM edges) AS edges, (SELECT max(time_recent) FROM edges) AS max_time FROM name_map")
def e12_graph_stats(spark, d):
    return stats.graph_stats(held(spark, d))


@query("e15_normalised", "WITH w AS (SELECT src AS id, sum(weight)::DOUBLE AS value FROM edges GROUP BY src) SELECT id, round(value / (SELECT sum(abs(value)) FROM w), 9) AS value FROM w")
def e15_normalised(spark, d):
    w = held(spark, d).edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").cast("double").alias("value"))
    return rounded(stats.normalised(w), "value", digits=9)


@query("e15_l1_difference", "WITH a AS (SELECT src AS id, count(*) AS x FROM edges GROUP BY src), b AS (SELECT dst AS id, count(*) AS y FROM edges GROUP BY dst) SELECT sum(abs(coalesce(x, 0) - coalesce(y, 0)))::BIGINT AS l1 FROM a FULL JOIN b USING (id)")
def e15_l1_difference(spark, d):
    g = held(spark, d)
    a, b = stats.out_degrees(g).withColumnRenamed("outdegree", "value"), stats.in_degrees(g).withColumnRenamed("indegree", "value")
    return stats.l1(a, b).select(F.col("l1").cast("bigint").alias("l1"))


@query("e16_quality", """WITH l AS (SELECT id, coalesce(vtype, -1) AS label FROM vertices),
e AS (SELECT coalesce(a.label, src) AS a, coalesce(b.label, dst) AS b, src, dst, weight FROM edges LEFT JOIN l a ON a.id = src LEFT JOIN l b ON b.id = dst),
c AS (SELECT c, sum(o) AS o, sum(i) AS i, sum(n) AS n FROM (SELECT a AS c, weight AS o, 0 AS i, CASE WHEN a = b THEN weight ELSE 0 END AS n FROM e UNION ALL SELECT b, 0, weight, 0 FROM e) GROUP BY c),
m AS (SELECT sum(weight) AS m FROM e), x AS (SELECT weight, EXISTS (SELECT 1 FROM edges r WHERE r.src = e.dst AND r.dst = e.src) AS back FROM e WHERE a = b)
SELECT round(sum(n) / any_value(m), 6) AS coverage, round(sum(n / m - o * i / (m * m)), 6) AS modularity,
  round(avg(CASE WHEN least(o + i, 2 * m - o - i) > 0 THEN (o + i - 2 * n) / least(o + i, 2 * m - o - i) ELSE 0 END), 6) AS conductance,
  (SELECT round(coalesce(sum(weight) FILTER (back), 0) / sum(weight), 6) FROM x) AS mirror_coverage FROM c, m""")
def e16_quality(spark, d):
    g = held(spark, d)
    labels = g.vertices.select("id", F.coalesce("vtype", F.lit(-1)).alias("label"))
    return rounded(stats.quality(g, labels), "coverage", "modularity", "conductance", "mirror_coverage")


# Columns.
@query("f01_data_array", f"WITH {_DEG} SELECT d.id, degree, coalesce(n.name, '') AS name FROM deg d LEFT JOIN name_map n ON n.kind = 'vertex' AND n.id = d.id")
def f01_data_array(spark, d):
    g = held(spark, d)
    return columns.data_array(stats.degrees(g), "degree", g, strings=True)


@query("f02_range", f"WITH {_DEG} SELECT id, degree FROM deg WHERE id >= 400000 AND id < 700000")
def f02_range(spark, d):
    return columns.data_range(stats.degrees(held(spark, d)), "degree", 400_000, 300_000)


@query("f03_top_k", f"WITH {_DEG} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 6 AS pos FROM deg ORDER BY degree DESC, id LIMIT 20 OFFSET 5")
def f03_top_k(spark, d):
    return columns.sorted_range(stats.degrees(held(spark, d)), "degree", 5, 20).withColumn("pos", F.col("pos").cast("bigint"))


@query("f04_set", f"WITH {_DEG}, {_HUBS}, k AS (SELECT id FROM hubs UNION SELECT n.id FROM name_map n JOIN hubs h ON h.id = n.id WHERE n.kind = 'vertex') SELECT id, degree FROM deg WHERE id IN (SELECT id FROM k)")
def f04_set(spark, d):
    g = held(spark, d)
    ids = [r["id"] for r in hubs(g, 5).collect()]  # five
    names = [r["name"] for r in g.names.where((F.col("kind") == "vertex") & F.col("id").isin(ids)).select("name").collect()]
    return columns.data_set(stats.degrees(g), "degree", [*ids, *names, "no such name", -5], g)


@query("f05_stride", f"WITH {_DEG} SELECT id, degree FROM (SELECT id, degree, row_number() OVER (ORDER BY id) - 1 AS pos FROM deg) WHERE pos % 7 = 0")
def f05_stride(spark, d):
    return columns.data_array(stats.degrees(held(spark, d)), "degree", stride=7)


@query("f06_samples", f"WITH {_DEG}, n AS (SELECT greatest(1, ceil(count(*) / 100.0))::BIGINT AS s FROM deg) SELECT id, degree FROM (SELECT id, degree, row_number() OVER (ORDER BY id) - 1 AS pos FROM deg) WHERE pos % (SELECT s FROM n) = 0")
def f06_samples(spark, d):
    return columns.data_array(stats.degrees(held(spark, d)), "degree", samples=100)


@query("f07_log_samples", f"""WITH {_DEG}, n AS (SELECT count(*) AS n FROM deg), p AS (SELECT 0::BIGINT AS pos UNION SELECT least(n - 1, round(pow(pow(n, 1.0 / 15), i.range)))::BIGINT FROM n, range(16) i)
SELECT id, degree FROM (SELECT id, degree, row_number() OVER (ORDER BY id) - 1 AS pos FROM deg) WHERE pos IN (SELECT pos FROM p)""")
def f07_log_samples(spark, d):
    return columns.data_array(stats.degrees(held(spark, d)), "degree", samples=16, log=True)


@query("f08_top_k_of_vtypes", f"WITH {_DEG}, t AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos FROM deg ORDER BY degree DESC, id LIMIT 50) SELECT t.id, degree, pos FROM t JOIN vertices v USING (id) WHERE v.vtype = 1")
def f08_top_k_of_vtypes(spark, d):
    g = held(spark, d)
    return columns.sorted_range(stats.degrees(g), "degree", 0, 50, g=g, vtypes=[1]).withColumn("pos", F.col("pos").cast("bigint"))


@query("f09_argmax", f"WITH {_DEG} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1")
def f09_argmax(spark, d):
    return columns.argmax(stats.degrees(held(spark, d)), "degree")


# Subgraphs.
_BFS = "SELECT id, 0::BIGINT AS dist FROM hub"
_BFS_STEP = "SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM {p} UNION ALL SELECT e.dst, s.dist + 1 FROM {p} s JOIN edges e ON e.src = s.id) GROUP BY id"


def _far(g: Graph, v: int) -> int:
    """The farthest vertex from v by hops, the least id of several."""
    r = paths.distances(g, g.spark.createDataFrame([(v,)], "id bigint"), unweighted=True).orderBy(F.desc("dist"), "id").head()
    return r["id"]


@query("g01_path_edges", f"""WITH {_HUB}, {unrolled(_BFS, _BFS_STEP, _HOPS)}, far AS (SELECT id, dist FROM s{_HOPS} ORDER BY dist DESC, id LIMIT 1),
{unrolled("SELECT id, 0::BIGINT AS dist FROM far", "SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM {p} UNION ALL SELECT e.src, b.dist + 1 FROM {p} b JOIN edges e ON e.dst = b.id) GROUP BY id", _HOPS, "b")}
SELECT DISTINCT e.src, e.dst, a.dist + 1 AS level FROM edges e JOIN s{_HOPS} a ON a.id = e.src JOIN b{_HOPS} b ON b.id = e.dst WHERE a.dist + b.dist + 1 = (SELECT dist FROM far)""")
def g01_path_edges(spark, d):
    g = held(spark, d)
    v = hub(g)
    return paths.path_edges(g, v, _far(g, v))


@query("g02_bfs_edges", f"""WITH {_HUB}, {unrolled(_BFS, _BFS_STEP.replace("e.src = s.id", "e.src = s.id AND e.etype = 1"), _HOPS)}
SELECT t.dist::INT AS level, min(e.src) AS parent, t.id FROM s{_HOPS} t JOIN edges e ON e.dst = t.id AND e.etype = 1 JOIN s{_HOPS} p ON p.id = e.src AND p.dist = t.dist - 1 GROUP BY t.dist, t.id""")
def g02_bfs_edges(spark, d):
    g = held(spark, d)
    return paths.bfs_edges(g, hub(g), 1)


@query("g03_egonet", f"WITH {_HUB}, {_BOTH}, n AS (SELECT nbr AS id FROM both_ways WHERE id = (SELECT id FROM hub)) SELECT {_EDGE} FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def g03_egonet(spark, d):
    g = held(spark, d)
    return extract.egonet(g, [hub(g)])


@query("g04_label_search", f"""WITH {_HUB}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges JOIN vertices a ON a.id = src JOIN vertices b ON b.id = dst WHERE a.vtype = b.vtype AND a.vtype = (SELECT vtype FROM vertices WHERE id = (SELECT id FROM hub))),
{unrolled("SELECT id, 0 AS level FROM hub", "SELECT id, min(level) AS level FROM (SELECT id, level FROM {p} UNION ALL SELECT e.dst, s.level + 1 FROM {p} s JOIN e ON e.src = s.id) GROUP BY id", _HOPS)} SELECT level, id FROM s{_HOPS}""")
def g04_label_search(spark, d):
    g = held(spark, d)
    return extract.label_search(g, [hub(g)], g.vertices.where("vtype IS NOT NULL"), label="vtype")


@query("g05_modular_expansion")
def g05_modular_expansion(spark, d):
    """From the hub until no vertex raises the score any more."""
    g = flow(spark, d)
    return extract.modular_expansion(g, [hub(g)])


@query("g06_component_of", f"WITH {_COMPONENTS} SELECT id FROM comp WHERE label = (SELECT label FROM comp WHERE id = (SELECT min(src) FROM edges))")
def g06_component_of(spark, d):
    g = held_edges(spark, d)
    return extract.members(structure.components(g), g.edges.agg(F.min("src")).head()[0])


@query("g07_group_egonet", f"WITH {_HUBS}, {_BOTH}, n AS (SELECT nbr AS id FROM both_ways WHERE id IN (SELECT id FROM hubs) UNION SELECT id FROM hubs) SELECT {_EDGE} FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def g07_group_egonet(spark, d):
    g = held(spark, d)
    return extract.egonet(g, [r["id"] for r in hubs(g, 5).collect()], incident=True)


@query("g09_changes", f"SELECT 'inserted' AS side, {_EDGE} FROM edges WHERE etype = 3 UNION ALL SELECT 'deleted', {_EDGE} FROM edges WHERE etype = 1")
def g09_changes(spark, d):
    e = held(spark, d).edges
    new, gone = extract.subgraph_changes(e.where("etype <> 3"), e.where("etype <> 1"))
    return new.select(F.lit("inserted").alias("side"), *e.columns).union(gone.select(F.lit("deleted"), *e.columns))


# Analytics.
def _pagerank_sql(edges: str, ids: str, rounds: int, receives: bool) -> str:
    got = "coalesce(t.taken, 0)" if receives else "CASE WHEN p.o > 0 THEN coalesce(t.taken, 0) ELSE 0 END"
    step = f"""SELECT p.id, p.o, 0.85 * ({got} + (SELECT coalesce(sum(rank) FILTER (o = 0), 0) FROM {{p}}) / (SELECT count(*) FROM ids)) + (1 - 0.85) / (SELECT count(*) FROM ids) AS rank
FROM {{p}} p LEFT JOIN (SELECT e.dst AS id, sum(q.rank / q.o) AS taken FROM {edges} e JOIN {{p}} q ON q.id = e.src GROUP BY e.dst) t ON t.id = p.id"""
    first = f"SELECT i.id, coalesce(o.o, 0) AS o, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS rank FROM ids i LEFT JOIN (SELECT src AS id, count(*) AS o FROM {edges} GROUP BY src) o ON o.id = i.id"
    return f"{ids}, {unrolled(first, step, rounds)} SELECT id, round(rank, 9) AS rank FROM s{rounds}"


@query("j01_pagerank", "WITH " + _pagerank_sql("edges", _IDS, 10, False))
def j01_pagerank(spark, d):
    return rounded(ranking.pagerank(held_edges(spark, d), epsilon=None, most=10), "rank", digits=9)


@query("j01_pagerank_default")
def j01_pagerank_default(spark, d):
    """With the stop rule and rounds that the operator has by default."""
    return ranking.pagerank(held_edges(spark, d))


@query("j01_pagerank_textbook", f"WITH {FLOW}, " + _pagerank_sql("flow", _FIDS, 10, True))
def j01_pagerank_textbook(spark, d):
    return rounded(ranking.pagerank(flow(spark, d), epsilon=None, most=10, dangling_receives=True), "rank", digits=9)


@query("j02_typed_pagerank", "WITH e1 AS MATERIALIZED (SELECT src, dst FROM edges WHERE etype = 1), " + _pagerank_sql("e1", _IDS, 10, False))
def j02_typed_pagerank(spark, d):
    return rounded(ranking.pagerank(held_edges(spark, d), 1, epsilon=None, most=10), "rank", digits=9)


@query("j03_subset_pagerank", f"WITH {_HUBS}, {_BOTH}, ids AS MATERIALIZED (SELECT DISTINCT nbr AS id FROM both_ways WHERE id IN (SELECT id FROM hubs)), sub AS MATERIALIZED (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)), " + _pagerank_sql("sub", "dummy AS (SELECT 1)", 10, True))
def j03_subset_pagerank(spark, d):
    g = held_edges(spark, d)
    near = g.both_ways().join(hubs(g, 5), "id", "left_semi").select(F.col("nbr").alias("id")).distinct()
    return rounded(ranking.subset_pagerank(g, near, epsilon=None, most=10), "rank", digits=9)


@query("j05_min_reachable", f"WITH {_IDS}, {unrolled('SELECT id, id AS label FROM ids', 'SELECT id, min(label) AS label FROM (SELECT id, label FROM {p} UNION ALL SELECT e.src, s.label FROM {p} s JOIN edges e ON e.dst = s.id) GROUP BY id', _HOPS)} SELECT id, label FROM s{_HOPS}")
def j05_min_reachable(spark, d):
    return structure.min_reachable(held_edges(spark, d))


@query("j06_components", f"WITH {_COMPONENTS} SELECT id, label FROM comp")
def j06_components(spark, d):
    return structure.components(held_edges(spark, d))


@query("j06_typed_components", f"WITH {_IDS}, {unrolled('SELECT id, id AS label FROM ids', 'SELECT id, min(label) AS label FROM (SELECT id, label FROM {p} UNION ALL SELECT l.nbr, s.label FROM {p} s JOIN (SELECT src AS id, dst AS nbr FROM edges WHERE etype = 5 UNION SELECT dst, src FROM edges WHERE etype = 5) l ON l.id = s.id) GROUP BY id', _HOPS)} SELECT id, label FROM s{_HOPS}")
def j06_typed_components(spark, d):
    return structure.components(held_edges(spark, d), 5)


_CORE = """SELECT p.id, CASE WHEN p.label = {k} AND coalesce(b.n, 0) > {k} THEN {k} + 1 ELSE p.label END AS label, coalesce(a.n, p.count) AS count FROM {p} p
LEFT JOIN (SELECT x.id, count(*) AS n FROM {p} x JOIN flow e ON e.src = x.id JOIN {p} y ON y.id = e.dst WHERE x.label = {k} AND y.label >= {k} GROUP BY x.id HAVING count(*) > {k}) a ON a.id = p.id
LEFT JOIN (SELECT x.id, count(*) AS n FROM {p} x JOIN flow e ON e.src = x.id JOIN {p} y ON y.id = e.dst
  LEFT JOIN (SELECT x.id, count(*) AS n FROM {p} x JOIN flow e ON e.src = x.id JOIN {p} y ON y.id = e.dst WHERE x.label = {k} AND y.label >= {k} GROUP BY x.id HAVING count(*) > {k}) c ON c.id = y.id
  WHERE x.label = {k} AND y.label >= {k} AND coalesce(c.n, y.count) > {k} GROUP BY x.id) b ON b.id = p.id"""


@query("j07_kcore", f"WITH {FLOW}, {_FIDS}, {unrolled('SELECT id, (EXISTS (SELECT 1 FROM flow WHERE src = id))::INT AS label, 0::BIGINT AS count FROM ids', _CORE, 90)} SELECT id, label, count FROM s90")
def j07_kcore(spark, d):
    return structure.kcore(flow(spark, d))


@query("j07_kcore_exact", f"""WITH {_IDS}, {_BOTH}, {unrolled("SELECT i.id, count(b.nbr) AS core FROM ids i LEFT JOIN both_ways b ON b.id = i.id GROUP BY i.id", "SELECT id, coalesce(max(least(v, n)), 0) AS core FROM (SELECT b.id, s.core AS v, row_number() OVER (PARTITION BY b.id ORDER BY s.core DESC) AS n FROM both_ways b JOIN {p} s ON s.id = b.nbr) GROUP BY id", _HOPS)} SELECT id, core FROM s{_HOPS}""")
def j07_kcore_exact(spark, d):
    return structure.kcore_exact(held_edges(spark, d))


@query("j08_triangles", f"WITH {FLOW}, {_FIDS}, l AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flow), t AS (SELECT x.a, x.b, y.b AS c FROM l x JOIN l y ON y.a = x.b JOIN l z ON z.a = x.a AND z.b = y.b), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id) SELECT ids.id, coalesce(n.n, 0) AS triangles FROM ids LEFT JOIN n USING (id)")
def j08_triangles(spark, d):
    return structure.triangles(flow(spark, d))


@query("j08_clustering", f"""WITH {FLOW}, {_FIDS}, o AS (SELECT src AS id, count(*) AS outdegree FROM flow GROUP BY src),
n AS (SELECT a.src AS id, count(*) AS ntri FROM flow a JOIN flow b ON b.src = a.dst JOIN flow c ON c.src = a.src AND c.dst = b.dst AND c.etype = 0 WHERE b.dst <> a.src GROUP BY a.src)
SELECT ids.id, coalesce(ntri, 0)::BIGINT AS ntri, coalesce(outdegree, 0) AS outdegree, round(CASE WHEN outdegree > 1 THEN coalesce(ntri, 0) / (outdegree * (outdegree - 1)) ELSE 0 END, 9) AS cc FROM ids LEFT JOIN n USING (id) LEFT JOIN o USING (id)""")
def j08_clustering(spark, d):
    return rounded(structure.clustering(flow(spark, d)), "cc", digits=9)


_LEVELS = 6
_ARCS = "arcs AS MATERIALIZED (SELECT src, dst, count(*) AS c FROM flow GROUP BY src, dst)"
_FORWARD = unrolled(
    "SELECT id AS s, id, 1.0::DOUBLE AS sigma, 0 AS l FROM ids",
    "SELECT * FROM {p} UNION ALL SELECT p.s, a.dst, sum(p.sigma * a.c), {k} FROM {p} p JOIN arcs a ON a.src = p.id WHERE p.l = {k} - 1 AND NOT EXISTS (SELECT 1 FROM {p} q WHERE q.s = p.s AND q.id = a.dst) GROUP BY p.s, a.dst",
    _LEVELS, "f",
)
_BACKWARD = ", ".join(
    [f"b{_LEVELS} AS MATERIALIZED (SELECT s, id, 0.0::DOUBLE AS delta FROM f{_LEVELS} WHERE l = {_LEVELS})"]
    + [
        f"b{i} AS MATERIALIZED (SELECT p.s, p.id, coalesce(sum(p.sigma * a.c / q.sigma * (1 + b.delta)), 0) AS delta FROM f{_LEVELS} p LEFT JOIN (arcs a JOIN f{_LEVELS} q ON q.id = a.dst AND q.l = {i + 1} JOIN b{i + 1} b ON b.s = q.s AND b.id = q.id) ON a.src = p.id AND q.s = p.s WHERE p.l = {i} GROUP BY p.s, p.id)"
        for i in range(_LEVELS - 1, 0, -1)
    ]
)


@query("j09_betweenness", f"WITH {FLOW}, {_FIDS}, {_ARCS}, {_FORWARD}, {_BACKWARD}, d AS ({' UNION ALL '.join(f'SELECT * FROM b{i}' for i in range(1, _LEVELS + 1))}) SELECT ids.id, round(coalesce(sum(delta), 0), 6) AS bc, count(delta) AS times_found FROM ids LEFT JOIN d USING (id) GROUP BY ids.id")
def j09_betweenness(spark, d):
    """All sources of the event graph."""
    return rounded(structure.betweenness(flow(spark, d)), "bc")


@query("j09_betweenness_sampled")
def j09_betweenness_sampled(spark, d):
    return structure.betweenness(held_edges(spark, d), 256, seed=1)


@query("j10_adamic_adar", f"""WITH {_HUB}, {_SLOTS}, dg AS (SELECT id, count(*) AS d FROM slots GROUP BY id), n AS (SELECT DISTINCT nbr AS z FROM slots WHERE id = (SELECT id FROM hub) AND nbr <> (SELECT id FROM hub)),
p AS (SELECT DISTINCT s.id AS z, s.nbr AS id FROM slots s JOIN n ON n.z = s.id) SELECT p.id, round(sum(1 / ln(d)), 6) AS score FROM p JOIN dg ON dg.id = p.z WHERE d > 1 AND p.id <> (SELECT id FROM hub) AND p.id NOT IN (SELECT z FROM n) GROUP BY p.id""")
def j10_adamic_adar(spark, d):
    g = held(spark, d)
    return rounded(structure.adamic_adar(g, hub(g)), "score")


_HITS = """SELECT p.id, coalesce(h.x, 0) AS hub, coalesce(a.x, 0) AS authority FROM {p} p
LEFT JOIN (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT e.dst AS id, sum(q.hub) AS x FROM edges e JOIN {p} q ON q.id = e.src GROUP BY e.dst)) a ON a.id = p.id
LEFT JOIN (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT e.src AS id, sum(b.x) AS x FROM edges e JOIN (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT e.dst AS id, sum(q.hub) AS x FROM edges e JOIN {p} q ON q.id = e.src GROUP BY e.dst)) b ON b.id = e.dst GROUP BY e.src)) h ON h.id = p.id"""


@query("j11_hits", f"WITH {_IDS}, {unrolled('SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM ids', _HITS, 4)} SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM s4")
def j11_hits(spark, d):
    return rounded(ranking.hits(held_edges(spark, d), 4), "hub", "authority", digits=9)


@query("j11_hits_default")
def j11_hits_default(spark, d):
    return ranking.hits(held_edges(spark, d))


@query("j12_hops", f"WITH {_HUB}, {_IDS}, {unrolled(_BFS, _BFS_STEP, _HOPS)} SELECT ids.id, dist FROM ids LEFT JOIN s{_HOPS} USING (id)")
def j12_hops(spark, d):
    g = held_edges(spark, d)
    return paths.shortest_paths(g, hub(g), unweighted=True)


_WEIGHTED = f"WITH {_HUB}, {_IDS}, {unrolled(_BFS, _BFS_STEP.replace('s.dist + 1', 's.dist + e.weight'), _HOPS)} "


@query("j12_weighted_paths", _WEIGHTED + f"SELECT ids.id, dist::BIGINT AS dist FROM ids LEFT JOIN s{_HOPS} USING (id)")
def j12_weighted_paths(spark, d):
    g = held_edges(spark, d)
    return paths.shortest_paths(g, hub(g))


@query("j13_point_to_point", _WEIGHTED + f"SELECT (SELECT id FROM hub) AS source, max(id) AS target, max_by(dist, id)::BIGINT AS dist FROM s{_HOPS}")
def j13_point_to_point(spark, d):
    g = held_edges(spark, d)
    v = hub(g)
    last = paths.distances(g, spark.createDataFrame([(v,)], "id bigint"), unweighted=True).agg(F.max("id")).head()[0]
    return paths.point_to_point(g, v, last)


_REACH = 12
_ALL = f"WITH {FLOW}, {_FIDS}, arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM flow), {unrolled('SELECT id AS s, id, 0::BIGINT AS dist FROM ids', 'SELECT s, id, min(dist) AS dist FROM (SELECT s, id, dist FROM {p} UNION ALL SELECT p.s, a.dst, p.dist + 1 FROM {p} p JOIN arcs a ON a.src = p.id WHERE p.dist = {k} - 1) GROUP BY s, id', _REACH)}, m AS (SELECT * FROM s{_REACH}) "


@query("j14_mean_path", _ALL + "SELECT round(avg(dist), 6) AS mean FROM m WHERE s <> id")
def j14_mean_path(spark, d):
    """All pairs of users in the graph of all events."""
    return rounded(paths.mean_path(flow(spark, d), unweighted=True), "mean")


@query("j15_exact_diameter", _ALL + "SELECT max(dist) AS diameter FROM m")
def j15_exact_diameter(spark, d):
    return paths.exact_diameter(flow(spark, d), unweighted=True)


@query("j15_pseudo_diameter")
def j15_pseudo_diameter(spark, d):
    g = held_edges(spark, d)
    return paths.pseudo_diameter(g, hub(g), unweighted=True)


_MOD = "md AS MATERIALIZED (SELECT w.src, w.dst, w.w / m.m - o.k * i.k / (m.m * m.m) AS modularity FROM (SELECT src, dst, sum(weight) AS w FROM {0} GROUP BY src, dst) w JOIN (SELECT src, sum(weight) AS k FROM {0} GROUP BY src) o USING (src) JOIN (SELECT dst, sum(weight) AS k FROM {0} GROUP BY dst) i USING (dst), (SELECT sum(weight)::DOUBLE AS m FROM {0}) m)"


@query("j16_pair_modularity", f"WITH {_MOD.format('edges')} SELECT src, dst, round(modularity, 9) AS modularity FROM md")
def j16_pair_modularity(spark, d):
    return rounded(communities.pair_modularity(held(spark, d)), "modularity", digits=9)


@query("j17_adopt_labels", f"WITH {_IDS}, {_MOD.format('edges')}, best AS MATERIALIZED (SELECT src AS id, dst AS f FROM md QUALIFY row_number() OVER (PARTITION BY src ORDER BY modularity DESC, dst) = 1), {unrolled('SELECT id, id AS label FROM ids', 'SELECT p.id, coalesce(q.label, p.label) AS label FROM {p} p LEFT JOIN best b ON b.id = p.id LEFT JOIN {p} q ON q.id = b.f', 5)} SELECT id, label FROM s5")
def j17_adopt_labels(spark, d):
    return communities.adopt_labels(held_edges(spark, d), 5)


@query("j18_agglomerate")
def j18_agglomerate(spark, d):
    return communities.agglomerate(flow(spark, d), both=True)


@query("j19_partition")
def j19_partition(spark, d):
    g = held_edges(spark, d)
    return communities.partition(g, 4, g.ids().count() / 4 * 1.1)


@query("j20_independent_set")
def j20_independent_set(spark, d):
    return structure.independent_set(held_edges(spark, d), seed=7)


@query("j20_independence", "SELECT 0::BIGINT AS linked, 0::BIGINT AS missing")
def j20_independence(spark, d):
    """Links within the set, and vertices outside without a neighbour in it: none."""
    g = held_edges(spark, d)
    chosen = stored(structure.independent_set(g, seed=7), "chosen")
    other = chosen.withColumnRenamed("id", "nbr")
    near = g.both_ways().join(other, "nbr", "left_semi").select("id")
    linked = near.join(chosen, "id", "left_semi").agg(F.count(F.lit(1)).alias("linked"))
    missing = g.ids().join(chosen, "id", "left_anti").join(near, "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return linked.crossJoin(missing)  # two single rows


@query("j19_part_sizes", "WITH ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT count(*) AS vertices, 4::BIGINT AS parts, true AS within FROM ids")
def j19_part_sizes(spark, d):
    """All vertices are placed, in four parts within the capacity."""
    g = held_edges(spark, d)
    capacity = g.ids().count() / 4 * 1.1
    sizes = communities.partition(g, 4, capacity).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("vertices"), F.count(F.lit(1)).alias("parts"), (F.max("n") <= capacity + 1).alias("within"))


@query("j18_tree_communities")
def j18_tree_communities(spark, d):
    return communities.agglomerate(held_edges(spark, d), trees=True)


@query("j18_contraction", f"WITH {FLOW}, {_FIDS} SELECT (SELECT count(*) FROM ids) AS vertices, (SELECT sum(weight)::BIGINT FROM flow) AS weight, true AS better")
def j18_contraction(spark, d):
    """Communities cover all vertices, keep the weight, and are more modular than single vertices."""
    g = flow(spark, d)
    labels = stored(communities.agglomerate(g, both=True), "labels")
    alone = g.ids().withColumn("label", F.col("id"))
    better = stats.quality(g, labels).select(F.col("modularity").alias("a")).crossJoin(stats.quality(g, alone).select(F.col("modularity").alias("b")))  # single rows
    n = labels.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(g.edges.agg(F.sum("weight").alias("weight")))  # single rows
    return n.crossJoin(better.select((F.col("a") > F.col("b")).alias("better")))


@query("j21_matvec_min_plus", f"WITH {_DEG} SELECT e.src AS id, min(e.weight + d.degree) AS value FROM edges e JOIN deg d ON d.id = e.dst GROUP BY e.src")
def j21_matvec_min_plus(spark, d):
    g = held(spark, d)
    return ranking.matvec(g, stats.degrees(g).select("id", F.col("degree").alias("value")), "min", "+")


@query("j22_transposed_matvec", "WITH o AS (SELECT src AS id, count(*) AS d FROM edges GROUP BY src), x AS (SELECT id, (id % 100)::DOUBLE AS value FROM o WHERE id % 100 >= 3) SELECT e.dst AS id, round(0.5 * sum(e.weight * x.value / o.d), 6) AS value FROM edges e JOIN x ON x.id = e.src JOIN o ON o.id = e.src GROUP BY e.dst")
def j22_transposed_matvec(spark, d):
    g = held(spark, d)
    x = stats.out_degrees(g).select("id", (F.col("id") % 100).cast("double").alias("value"))
    return rounded(ranking.transposed_matvec(g, x, 0.5, unit=False, by_degree=True, below=3.0), "value")


@query("j23_power_rank_default")
def j23_power_rank_default(spark, d):
    return ranking.power_rank(held_edges(spark, d))


@query("j23_power_rank", f"WITH {_IDS}, o AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM edges GROUP BY src), {unrolled('SELECT id, 1.0::DOUBLE AS value FROM ids', 'SELECT ids.id, 1 + 0.15 * coalesce(t.v, 0) AS value FROM ids LEFT JOIN (SELECT e.dst AS id, sum(p.value / o.d) AS v FROM edges e JOIN {p} p ON p.id = e.src JOIN o ON o.id = e.src GROUP BY e.dst) t USING (id)', 6)} SELECT id, round(value / (SELECT sum(value) FROM s6), 9) AS value FROM s6")
def j23_power_rank(spark, d):
    return rounded(ranking.power_rank(held_edges(spark, d), most=6, fixed=True), "value", digits=9)
