import time
from pathlib import Path

import pytest
from hand import column, graph, rows
from pyspark.sql import functions as F

from graphrill.functions.rpc import BAD_PARAMS, INVALID, NO_COLUMN, NO_METHOD, NO_RESULT, Rpc, RpcError
from graphrill.functions.sql import sql
from graphrill.model import Graph
from graphrill.operators import columns, ranking, stats, structure
from graphrill.session import fresh_path
from graphrill.sources.generate import FEED, StreamBuffer
from graphrill.streaming import analytics, runtime, sessions

CC9 = "0-1 1-2 1-3 1-4 2-8 3-5 3-6 4-5 5-6 5-7 7-8"
DUMBBELL = "0-1 0-2 0-3 1-2 1-3 2-3 3-4 4-5 4-6 4-7 5-6 5-7"


def batch(spark, *ops, batch_id=0):
    """Rows such as '+1>2', '-1>2' with numbers."""
    out = []
    for i, x in enumerate(ops):
        a, b = x[1:].split(">")
        out.append((batch_id, i, "insert" if x[0] == "+" else "delete", 0, None, int(a), None, int(b), None, 1, 10, None, None, None, None))
    return spark.createDataFrame(out, FEED)


def engine(spark, text, *a, **k):
    return runtime.Engine(spark, fresh_path(spark, "state"), list(a), start=graph(spark, text) if text else None, **k)


@pytest.mark.parametrize("text, ops", [(CC9, ["+3>8", "-1>2"]), (DUMBBELL, ["+6>7", "-3>4"])])
def test_incremental_equals_static(spark, text, ops):
    e = engine(spark, text, analytics.Components(), analytics.Triangles(), directed=False)
    for i, op in enumerate(ops):
        e.apply(batch(spark, op), i)
        g = e.graph
        assert column(g.results["components"], "label") == column(structure.components(g), "label")
        assert column(g.results["triangles"], "triangles") == column(structure.triangles(g), "triangles")
    if text == DUMBBELL:
        assert set(column(g.results["components"], "component_size").values()) == {4}


def test_inserted_and_deleted_at_once(spark):
    e = engine(spark, "0-1 2-3", analytics.Components(), analytics.Triangles(), directed=False)
    e.apply(batch(spark, "+1>2", "-1>2", "+0>4", "+0>1"), 0)
    assert column(e.graph.results["components"], "label") == column(structure.components(e.graph), "label") == {0: 0, 1: 0, 4: 0, 2: 2, 3: 2}
    half = [(1, 0, "insert", 0, None, None, None, None, None, 1, 10, None, None, None, None)]
    e.apply(spark.createDataFrame(half, FEED), 1)
    assert column(e.graph.results["components"], "label") == column(structure.components(e.graph), "label")


def test_replay_and_restart(spark):
    e = engine(spark, "0>1", analytics.RateMonitor())
    b = batch(spark, "+0>1", "+1>2")
    e.apply(b, 0)
    first = rows(e.graph.edges)
    e.apply(b, 0)
    assert rows(e.graph.edges) == first and (0, 0, 1, 2, 0, 10) in first
    again = runtime.Engine(spark, e.path, [analytics.RateMonitor()])
    assert rows(again.graph.edges) == first
    again.apply(b, 0)
    assert rows(again.graph.edges) == first
    again.apply(batch(spark, "-0>1"), 1)
    assert len(rows(again.graph.edges)) == 1 and spark.table("edges").count() == 1


def test_rate_monitor(spark):
    e = engine(spark, None, analytics.RateMonitor())
    k, v, a = 0.333, 0.0, 0.0
    for i, n in enumerate([2, 0, 1]):
        e.apply(batch(spark, *(["+7>8"] * n or ["+1>2"])), i)
        a, v = k * a + (1 - k) * (n - v), k * v + (1 - k) * n
    r = e.graph.results["rate_monitor"].where("id = 7").head()
    assert abs(r["velocity"] - v) < 1e-12 and abs(r["acceleration"] - a) < 1e-12


def test_ranks_follow_the_graph(spark):
    e = engine(spark, "0>1 1>2 2>0 2>3 3>0", analytics.PageRank(most=60), analytics.DeltaRank(), analytics.DeltaRank(held=True), analytics.Communities(), analytics.Betweenness(4))
    e.apply(batch(spark, "+3>1", "+0>4", "+4>2", "-2>3"), 0)
    g = e.graph
    cold = column(ranking.power_rank(g), "value")
    for name in ("dpr", "dpr_held"):
        warm = column(g.results[name], "value")
        assert warm.keys() == cold.keys() and max(abs(warm[i] - cold[i]) for i in cold) < 1e-5
    cold, warm = column(ranking.pagerank(g, most=200), "rank"), column(g.results["pagerank"], "rank")
    assert max(abs(warm[i] - cold[i]) for i in cold) < 1e-3
    assert g.results["communities"].count() == 5 and g.results["betweenness"].count() == 5


def test_levels():
    a, b, c = analytics.Recompute("a", None), analytics.Recompute("b", None, ("a",)), analytics.Recompute("c", None, ("b", "a"))
    assert [[x.name for x in level] for level in runtime.levels([c, b, a])] == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="not registered"):
        runtime.levels([b])
    with pytest.raises(ValueError, match="needs itself"):
        runtime.levels([analytics.Recompute("x", None, ("x",))])


def test_needs_and_history(spark):
    path = fresh_path(spark, "history")
    twice = analytics.Recompute("twice", lambda g: g.results["degree"].withColumn("degree", F.col("degree") * 2), ("degree",))
    e = engine(spark, "0>1", twice, analytics.Recompute("degree", stats.degrees), history=path, keep_history=1)
    e.apply(batch(spark, "+0>2"), 0)
    e.apply(batch(spark, "+0>3"), 1)
    assert column(e.graph.results["twice"], "degree")[0] == 6
    assert {r["batch"] for r in spark.read.parquet(f"{path}/degree").collect()} == {1}


def test_stream_from_a_buffer(spark):
    b = StreamBuffer(spark, size=1)
    e = engine(spark, None)
    for x in ("b", "c", "d", "e"):
        b.add_insert("a", x, "t", 2)
    b.flush()
    q = e.stream(runtime.read_feed(spark, b.folder), fresh_path(spark, "offsets"))
    q.processAllAvailable()
    q.stop()
    assert e.graph.edges.count() == 4 and e.counts["inserted"] == 4
    assert e.graph.names.where("kind = 'vertex'").count() == 5


def test_sessions(spark):
    clock = [0.0]
    e = engine(spark, "0-1 1-2 3-4", analytics.Components(), directed=False)
    s = sessions.Sessions(e, lambda: clock[0])
    sub = s.register("subgraph", name="components", data="label", source=0)
    watch = s.register("vertex_event_notifier", set=[3])
    places = s.register("get_latlon")
    assert s.request(sub)["subgraph"].count() == 4
    e.apply(batch(spark, "+2>5", "-1>0", "+3>9").withColumn("metadata", F.lit('{"geo":{"coordinates":[1,2]}}')), 0)
    d = s.request(sub)
    # Without 1-0 the vertex is alone; the edges it was with are gone from its component.
    assert d["insertions"].count() == 0 and d["deletions"].count() == 4
    assert rows(s.request(watch)["insertions"]) == [(3, 9)] and s.request(watch) == {}
    assert rows(s.request(places)["coordinates"]) == [(1.0, 2.0)]
    clock[0] = 31.0
    with pytest.raises(KeyError):
        s.request(sub)
    for _ in range(sessions.MOST):
        s.register("get_latlon_gnip")
    with pytest.raises(RuntimeError):
        s.register("get_latlon")


def named_graph(spark):
    g = graph(spark, "0>1:3 1>2:1 2>0:9 2>3:2")
    names = spark.createDataFrame([("vertex", i, n) for i, n in enumerate("abcd")] + [("vtype", 0, "None")], "kind string, id bigint, name string")
    g = g.with_(names=names, vertices=g.vertices.withColumn("vtype", F.col("id") % 2))
    return g.with_(results={"degree": stats.degrees(g), "components": structure.components(g)})


def test_rpc(spark):
    g = named_graph(spark)
    rpc = Rpc(lambda: g)
    top = rpc.call("get_data_array_sorted_range", {"name": "degree", "data": "degree", "offset": 0, "count": 2, "strings": True})
    assert [(r["id"], r["name"]) for r in top.orderBy("pos").collect()] == [(2, "c"), (0, "a")]
    assert column(rpc.call("single_source_shortest_path", {"source": "a", "ignore_weights": False}), "dist") == {0: 0, 1: 3, 2: 4, 3: 6}
    assert rpc.call("get_data_array_set", {"name": "degree", "data": "degree", "set": ["a", 1, "zz", -4]}).count() == 2
    assert rpc.call("egonet", {"source": "c", "incident_edges": True, "strings": True}).count() == 4
    for method, params in (("adamic_adar", {"source": 0}), ("bfs_edges", {"source": 0}), ("breadth_first_search", {"source": 0, "target": 3}), ("community_on_demand", {}), ("exact_diameter", {}), ("get_connected_component", {"source": 0}), ("get_data_array", {"name": "graph", "data": "vertex_outdegree"}), ("get_data_array_range", {"name": "degree", "data": "degree", "offset": 0, "count": 9}), ("get_data_array_reduction", {"name": "degree", "op": "x"}), ("get_algorithms", {}), ("get_graph_stats", {}), ("get_server_health", {}), ("get_server_info", {}), ("pagerank_subgraph", {"vertices": [0, 1]}), ("label_breadth_first_search", {"source": [0], "name": "components", "data": "label"}), ("label_mod_expand", {"source": [0], "name": "components", "data": "label", "limit": 2})):
        assert rpc.call(method, params).count() > 0, method
    for code, method, params in ((NO_METHOD, "nothing", {}), (BAD_PARAMS, "egonet", {}), (BAD_PARAMS, "egonet", {"source": "zz"}), (NO_RESULT, "get_data_description", {"name": "zz"}), (NO_COLUMN, "get_data_array", {"name": "degree", "data": "zz"}), (BAD_PARAMS, "get_data_array_range", {"name": "degree", "data": "degree", "offset": 99, "count": 1})):
        with pytest.raises(RpcError) as e:
            rpc.call(method, params)
        assert e.value.code == code
    answer = rpc.respond({"jsonrpc": "2.0", "id": 4, "method": "get_graph_stats"})
    assert answer["id"] == 4 and answer["result"]["edges"] == [4] and "millis" in answer["result"]
    assert rpc.respond({"method": "x"})["error"]["code"] == INVALID and rpc.respond({"jsonrpc": "2.0", "id": 1, "method": "x"})["error"]["code"] == NO_METHOD


def test_sql_views(spark):
    g = named_graph(spark)
    assert rows(sql(g, "SELECT id FROM vertices WHERE outdegree = 2 OR (indegree >= 1 AND type = 1) ORDER BY id LIMIT 2 OFFSET 1")) == [(2,), (3,)]
    assert rows(sql(g, "SELECT source_vertex, weight FROM edges WHERE weight BETWEEN 2 AND 4 ORDER BY 1")) == [(0, 3), (2, 2)]
    assert sql(g, "SELECT * FROM vertices LIMIT 0").count() == 0 and sql(g, "SELECT count(DISTINCT label) AS n FROM alg_components").head()["n"] == 1


def test_column_requests(spark):
    g = named_graph(spark)
    v = spark.createDataFrame([(i, i * 7 % 10) for i in range(10)], "id bigint, x bigint")
    at = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert at(columns.data_array(v, "x", stride=3)) == [0, 3, 6, 9] and at(columns.data_array(v, "x", samples=4)) == [0, 3, 6, 9]
    assert at(columns.data_range(v, "x", 8, 5)) == [8, 9]
    assert [r["x"] for r in columns.sorted_range(v, "x", 0, 3).orderBy("pos").collect()] == [9, 8, 7]
    assert [r["x"] for r in columns.sorted_range(v, "x", 1, 2, "ASC").orderBy("pos").collect()] == [1, 2]
    assert at(columns.sorted_range(v, "x", 0, 9, stride=4)) == sorted(r["id"] for r in columns.sorted_range(v, "x", 0, 9).where("pos % 4 = 0").collect())
    assert columns.argmax(v, "x").head()["id"] == 7 and columns.argmax(v.limit(0), "x").head()["id"] is None
    assert columns.log_positions(0, 5) == [] and columns.log_positions(100, 3) == [0, 1, 10, 99]
    assert columns.sorted_range(stats.degrees(g), "degree", 0, 4, g=g, vtypes=[1]).count() == 2
    assert columns.data_array(v.limit(0), "x", samples=3).count() == 0
    got = columns.positions(v.unionAll(v), [F.col("x"), F.col("id")])
    assert sorted(r["pos"] for r in got.collect()) == list(range(20))
    assert Graph.empty(spark).edges.count() == 0


def test_windows(spark):
    df = spark.sql("SELECT timestamp_seconds(x) AS sent_at, 'insert' AS op FROM VALUES (0), (10), (4000) AS t(x)")
    assert sorted(r["n"] for r in runtime.windows(df).collect()) == [1, 2]


def test_a_batch_leaves_nothing_on_disk(spark, tmp_path):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(p) for d in local.localDirs() for p in Path(d.getPath()).rglob("shuffle*.data")}
    e = runtime.Engine(spark, str(tmp_path / "state"), [analytics.RateMonitor()], start=graph(spark, "0>1 1>2"))
    before = shuffled()
    e.apply(batch(spark, *[f"+{i}>{i + 1}" for i in range(300)], "-0>1"), 0)
    time.sleep(2)
    assert not shuffled() - before
    assert not list((tmp_path / "state").glob("_held*")) and not spark.sparkContext._jsc.getPersistentRDDs()
    assert e.graph.edges.count() == 299 and e.graph.results["rate_monitor"].count() == 301
