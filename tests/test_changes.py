import json
import random

import pytest
from hand import column, edges, graph, rows
from pyspark.sql import functions as F

from graphrill.functions import scalar
from graphrill.model import KEY, Graph
from graphrill.operators import cowstore, mutate, stats, traverse
from graphrill.operators.cowstore import EdgeStore
from graphrill.session import fresh_path
from graphrill.sources import files, generate, sinks, templates

BATCH = "etype bigint, src bigint, dst bigint, weight bigint, time bigint, ord bigint"


def test_clique_pairs(spark):
    pairs = [(0, i, j, 1, i + 1, 0) for i in range(20) for j in range(i + 1, 20)]
    b = spark.createDataFrame(pairs, BATCH)
    g = Graph.empty(spark)
    assert {r["result"] for r in mutate.pair_insert_results(g, b).collect()} == {3}
    g = mutate.insert(g, b, "set", pairs=True)
    assert {r["result"] for r in mutate.pair_insert_results(g, b).collect()} == {0}
    one = Graph.of(spark.createDataFrame([(0, 1, 2)], "etype bigint, src bigint, dst bigint"))
    assert mutate.pair_insert_results(one, spark.createDataFrame([(0, 1, 2, 1, 1, 0)], BATCH)).head()["result"] == 2
    again = mutate.insert(g, b.withColumn("time", F.col("src") + 2), "set", pairs=True)
    path = fresh_path(spark, "t")
    files.save(again, path)
    for r in files.open_saved(spark, path).edges.collect():
        low = min(r["src"], r["dst"])
        assert (r["time_first"], r["time_recent"]) == (low + 1, low + 2)
    assert sum(r["n"] for r in stats.check(again).collect()) == 0


def test_delete_pair(spark):
    g = graph(spark, "300-301")
    assert column(stats.degrees(g), "degree") == {300: 1, 301: 1}
    k = spark.createDataFrame([(0, 300, 301)], "etype bigint, src bigint, dst bigint")
    assert mutate.remove_results(g, k, pairs=True).head()["result"] == 3
    gone = mutate.remove(g, k, pairs=True)
    assert gone.edges.count() == 0 and mutate.remove_results(gone, k, pairs=True).head()["result"] == -1
    half = graph(spark, "300>301")
    assert mutate.remove_results(half, k, pairs=True).head()["result"] == -1 and mutate.remove(half, k, pairs=True).edges.count() == 0


def test_batch_duplicates(spark):
    b = spark.createDataFrame([(0, i, j, d, d, d) for i in range(10) for j in range(i + 1, 10) for d in range(10)], BATCH)
    g = Graph.empty(spark)
    results = mutate.insert_results(g, b).groupBy(*KEY).agg(F.sum("result").alias("s"), F.count("*").alias("c")).collect()
    assert all((r["s"], r["c"]) == (1, 10) for r in results)
    g = mutate.insert(g, b, "incr")
    assert {r["weight"] for r in g.edges.collect()} == {45}
    assert column(stats.out_degrees(g), "outdegree") == {i: 9 - i for i in range(9)}
    assert {(r["weight"], r["time_first"], r["time_recent"]) for r in mutate.insert(Graph.empty(spark), b, "set").edges.collect()} == {(9, 0, 9)}


def test_insert_with_and_without_broadcast(spark, monkeypatch):
    r = random.Random(2)
    b = spark.createDataFrame([(0, r.randrange(6), r.randrange(6), r.randrange(9), r.randrange(50), i) for i in range(80)], BATCH)
    g = graph(spark, "0>1:3 1>2:4 5>5:2")
    for how in ("set", "incr"):
        got = []
        for small in (True, False):
            monkeypatch.setattr(mutate, "is_small", lambda df, small=small: small)
            got.append(rows(mutate.insert(g, b, how).edges))
        assert got[0] == got[1] and len(got[0]) > 20


def test_defaults_and_older_time(spark):
    g = mutate.insert(Graph.empty(spark), spark.createDataFrame([(None, None, None, None, None, 0)], BATCH), "incr")
    assert rows(g.edges) == [(0, 0, 1, 1, 1, 1)]
    late = mutate.insert(graph(spark, "0>1").with_(edges=graph(spark, "0>1").edges.withColumn("time_recent", F.lit(9).cast("bigint"))), spark.createDataFrame([(0, 0, 1, 2, 5, 0)], BATCH), "incr")
    assert late.edges.head()["time_recent"] == 5 and late.edges.head()["weight"] == 3


def test_apply_batch_order_and_names(spark):
    feed = [
        (0, 0, "insert", None, "t", None, "a", None, "b", 2, 7, None, None, None, None),
        (0, 0, "insert", None, "t", None, "a", None, "b", 2, 7, None, None, None, "again"),
        (0, 1, "delete", None, "t", None, "a", None, "c", None, None, None, None, None, None),
        (0, 2, "insert", None, "t", None, "a", None, "c", 2, 7, None, None, None, None),
        (0, 3, "vertex", None, None, None, "a", None, None, None, None, "person", 5, None, None),
        (0, 4, "vertex", None, None, None, "a", None, None, None, None, None, None, 2, None),
        (0, 5, "delete", None, "t", None, "nobody", None, "c", None, None, None, None, None, None),
    ]
    g = mutate.apply_batch(Graph.empty(spark), spark.createDataFrame(feed, generate.FEED))
    assert [(r["src"], r["dst"], r["weight"]) for r in g.edges.collect()] == [(0, 1, 2)]
    assert {(r["kind"], r["name"]): r["id"] for r in g.names.collect()} == {("etype", "None"): 0, ("vtype", "None"): 0, ("etype", "t"): 1, ("vtype", "person"): 1, ("vertex", "a"): 0, ("vertex", "b"): 1, ("vertex", "c"): 2}
    assert [(r["id"], r["vtype"], r["weight"]) for r in g.vertices.collect()] == [(0, 1, 7)]
    both = mutate.apply_batch(Graph.empty(spark), spark.createDataFrame(feed[:1], generate.FEED), directed=False)
    assert {(r["src"], r["dst"]) for r in both.edges.collect()} == {(0, 1), (1, 0)}


def test_remove_vertex_and_type(spark):
    g = graph(spark, "0-1 1>2", edges("0>2", 1))
    assert {(r["src"], r["dst"]) for r in mutate.remove_vertices(g, spark.createDataFrame([(1,)], "id bigint")).edges.collect()} == {(0, 2)}
    assert mutate.remove_type(g, 0).edges.count() == 1


def test_traversal_directions(spark):
    g = graph(spark, "0-1 2>0 0>0", edges("0>3", 1))
    one = spark.createDataFrame([(0,)], "id bigint")
    near = lambda way, t=None: sorted(r["nbr"] for r in traverse.gather(g, one, way, t).collect())
    assert near("out") == [0, 1, 3] and near("in") == [0, 1, 2] and near("both") == [0, 1, 2, 3] and near("out", 1) == [3]
    inc = {r["nbr"]: (r["is_out"], r["is_in"]) for r in traverse.edges_of(g, 0, "both").collect()}
    assert inc == {0: (True, True), 1: (True, True), 2: (False, True), 3: (True, False)}
    keys = spark.createDataFrame([(0, 0, 1), (0, 5, 6)], "etype bigint, src bigint, dst bigint")
    assert rows(traverse.edge_values(g, keys)) == [(0, 0, 1, 1, 0, 0), (0, 5, 6, 0, -1, -1)]


CHANGES = "op string, etype bigint, src bigint, dst bigint, weight bigint, at bigint"


def brute_state(base, changes):
    state = {}
    events = [(t, 0, k, w, f) for k, (w, f, t) in base.items()]
    events += [(at, op == "delete", (e, s, d), 1 if w is None else w, at) for op, e, s, d, w, at in changes if None not in (e, s, d)]
    for at, deleted, key, w, first in sorted(events, key=lambda x: (x[0], x[1])):
        if deleted:
            state.pop(key, None)
        elif key in state:
            state[key] = (state[key][0] + w, min(state[key][1], first), at)
        else:
            state[key] = (w, first, at)
    return state


def test_store_against_replay(spark):
    r = random.Random(3)
    base = {(0, i, i + 1): (1, 5, r.randrange(5, 30)) for i in range(10)}
    changes = [(r.choice(["insert", "insert", "delete"]), 0, i := r.randrange(12), i + 1, r.choice([None, 1, -2, 3]), r.randrange(40)) for _ in range(300)]
    changes += [("insert", None, 1, 2, 1, 1), ("delete", 0, None, 2, None, 1), ("delete", 9, 9, 9, None, 1)]
    e = spark.createDataFrame([(*k, w, f, t) for k, (w, f, t) in base.items()], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint")
    store = EdgeStore(spark, fresh_path(spark, "s"), 4)
    store.load(e)
    first = store.manifest()["files"]
    c = spark.createDataFrame(changes, CHANGES).withColumn("etype ", F.lit("clash"))
    store.apply(c, "one")
    got = {(x["etype"], x["src"], x["dst"]): (x["weight"], x["time_first"], x["time_recent"]) for x in store.edges().collect()}
    assert got == brute_state(base, changes)
    assert store.apply(c, "one") == [] and store.manifest()["version"] == 2
    # A change of one bucket leaves the files of the others.
    before = store.manifest()["files"]
    touched = store.apply(spark.createDataFrame([("insert", 0, 0, 1, 1, 99)], CHANGES), "two")
    after = store.manifest()["files"]
    assert len(touched) == 1 and [b for b in after if after[b] != before.get(b)] == [str(touched[0])] and first != before
    # A late insertion does not bring back what a later deletion removed.
    store.apply(spark.createDataFrame([("delete", 0, 0, 1, None, 200)], CHANGES), "three")
    store.apply(spark.createDataFrame([("insert", 0, 0, 1, 1, 150)], CHANGES), "four")
    assert store.edges().where("src = 0 AND dst = 1").count() == 0
    store.drop_old()
    assert store.edges().count() > 0


def test_store_over_several_sets(spark):
    """Late and repeated changes in later sets give the same as all at once."""
    r = random.Random(8)
    changes = [(r.choice(["insert", "insert", "delete"]), 0, i := r.randrange(6), i + 1, r.choice([None, 1, 4]), r.randrange(60), b, n) for b in range(12) for n in range(25)]
    df = spark.createDataFrame(changes, CHANGES + ", batch_id bigint, seq bigint")
    store = EdgeStore(spark, fresh_path(spark, "s"), 3)
    store.load(spark.createDataFrame([(0, 0, 1, 5, 1, 30)], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"))
    order = list(range(12))
    r.shuffle(order)
    for i in range(0, 12, 3):
        # Each set repeats a batch of the one before.
        store.apply(df.where(F.col("batch_id").isin(order[max(0, i - 1) : i + 3])), f"set {i}", ["batch_id", "seq"])
    got = {(x["etype"], x["src"], x["dst"]): (x["weight"], x["time_first"], x["time_recent"]) for x in store.edges().collect()}
    want = brute_state({(0, 0, 1): (5, 1, 30)}, [c[:6] for c in changes])
    assert got == want
    deleted = {c[1:4] for c in changes if c[0] == "delete"}
    assert {tuple(x) for x in store.revived().collect()} == deleted & want.keys()


def test_empty_store(spark):
    store = EdgeStore(spark, fresh_path(spark, "s"), 4)
    store.load(spark.createDataFrame([], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"))
    assert store.apply(spark.createDataFrame([], CHANGES), "x") == [] and store.edges().count() == 0


def test_csv_template_modes(spark):
    lines = spark.createDataFrame([("1,2,3,4,10",), ("x,2,3,4,10",)], "value string")
    every = templates.csv_updates(lines, "$source1,$source1,$destination1,$destination1,$weight1")
    assert {(r["src"], r["dst"], r["weight"]) for r in every.collect()} == {(1, 3, 10), (1, 4, 10), (2, 3, 10), (2, 4, 10)}
    zipped = templates.csv_updates(lines, "$source1ordered,$source1ordered,$destination1ordered,$destination1ordered,$weight1ordered")
    assert sorted((r["src"], r["dst"], r["weight"]) for r in zipped.collect()) == [(1, 3, 10), (2, 3, 10), (2, 4, 10)]
    groups = templates.csv_updates(lines.limit(1), "$source1,$destination1,$source2,$destination2,na,$type_str1=a,$type2=7")
    assert {(r["src"], r["dst"], r["etype"], r["etype_str"]) for r in groups.collect()} == {(1, 2, None, "a"), (3, 4, 7, None)}
    words = spark.createDataFrame([("na,a@x,na,b@x,77,5",)], "value string")
    mail = templates.csv_updates(words, "na,$source_str1,na,$destination_str1,$time1,$weight1, $source_type1=email, $destination_type1=email")
    r = mail.head()
    assert (r["src_str"], r["dst_str"], r["time"], r["weight"], r["source_type"]) == ("a@x", "b@x", 77, 5, "email")
    feed = templates.feed_rows(mail)
    assert sorted(r["op"] for r in feed.collect()) == ["insert", "vertex", "vertex"] and feed.columns == [c.split()[0] for c in generate.FEED.split(", ")]


def test_json_template(spark):
    t = {"user": {"screen_name": "$source_str1"}, "entities": {"user_mentions": [{"screen_name": "$destination_str1"}]}, "a": "$source_type=user", "b": "$source_type1=user", "t": "$type_str1=mention", "created_at": "$time_ttr1"}
    doc = {"user": {"screen_name": "u"}, "entities": {"user_mentions": [{"screen_name": "v"}, {"screen_name": "w"}]}, "created_at": "Mon Sep 24 03:35:21 +0000 2012"}
    rows_ = spark.createDataFrame([(json.dumps(doc),), ("broken {",), (None,), ("{}",)], "value string")
    del t["a"]
    got = templates.json_updates(rows_, [json.dumps(t)]).collect()
    assert sorted((r["src_str"], r["dst_str"], r["etype_str"], r["time"], r["source_type"]) for r in got) == [("u", "v", "mention", 20120924033521, "user"), ("u", "w", "mention", 20120924033521, "user")]


def test_file_graphs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("% note\n3 2 1\n2 5 3 7\n1 5\n1 7\n")
    g = files.metis_graph(spark, str(tmp_path / "m.txt"))
    names = {r["id"]: r["name"] for r in g.names.where("kind = 'vertex'").collect()}
    assert {(names[r["src"]], names[r["dst"]], r["weight"]) for r in g.edges.collect()} == {("0", "1", 5), ("0", "2", 7), ("1", "0", 5), ("2", "0", 7)}
    (tmp_path / "d.txt").write_text("c x\np sp 3 2\na 1 2 4\na 2 3 5\n")
    assert {(r["src"], r["dst"], r["weight"]) for r in files.dimacs_graph(spark, str(tmp_path / "d.txt")).edges.collect()} == {(0, 1, 4), (1, 2, 5)}
    (tmp_path / "g.json").write_text(json.dumps({"vertices": [{"name": "a", "weight": 3, "type": "p"}], "edges": [{"source": "a", "target": "b", "weight": 2, "type": "knows"}]}))
    g = files.json_graph(spark, str(tmp_path / "g.json"))
    assert g.edges.count() == 1 and g.vertices.where("name = 'a'").head()["weight"] == 3
    (tmp_path / "c.csv").write_text('a,"b",2\na,"b",3\nshort,1\nx, y,1,9,t\n')
    g = files.csv_graph(spark, str(tmp_path / "c.csv"))
    names = {r["id"]: r["name"] for r in g.names.where("kind = 'vertex'").collect()}
    assert {(names[r["src"]], names[r["dst"]], r["weight"], r["etype"]) for r in g.edges.collect()} == {("a", '"b"', 3, 0), ("x", " y", 1, 1)}
    assert files.csr_graph(spark, [0, 2, 3], [1, 2, 0]).edges.count() == 3
    flow = files.flows(spark.createDataFrame([("Date head",), ("2012-10-28 17:32:08.5 0.1 TCP 1.2.3.4:80 -> 5.6.7.8:443 3 120",)], "value string")).head()
    assert (flow["src_str"], flow["src_port"], flow["dst_str"], flow["etype_str"], flow["weight"], flow["time"]) == ("1.2.3.4", "80", "5.6.7.8", "TCP", 120, 20121028173208)


def test_generators_and_sinks(spark):
    e = generate.rmat(spark, 8, 1000, 3)
    assert rows(e.repartition(7)) == rows(generate.rmat(spark, 8, 1000, 3)) and e.agg(F.max("src")).head()[0] < 256
    assert generate.random_edges(spark, 5, 500).where("src = dst").count() == 0
    assert generate.core(spark, 10, 4).edges.count() == 40
    g = graph(spark, "0-1 1>2")
    v = g.with_(vertices=g.vertices.withColumn("vtype", F.col("id")))
    assert {r["id"] for r in sinks.typed_values(v, stats.out_degrees(g), "outdegree").collect()} == {1}
    path = fresh_path(spark, "h")
    for b in range(4):
        sinks.write_history({"d": stats.out_degrees(g)}, b, path, keep=2)
    assert {r["batch"] for r in sinks.history(spark, path, "d").collect()} == {2, 3}
    assert sinks.history_value(spark, path, "d", 3, 1, "outdegree").head()[0] == 2
    assert sinks.egonet_json(g, [1]).count() == 2


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).head()[0]
    assert get(scalar.ttr_time(F.lit("Sun, 28 Oct 2012 17:32:08 +0000"))) == 20121028173208
    assert get(scalar.ttr_time(F.lit("yesterday"))) is None and get(scalar.compact(F.lit(0))) == 19700101000000
    assert get(scalar.compact(F.lit(-1))) == 19691231235959
    assert get(scalar.host(F.lit("a:1"))) == "a" and get(scalar.port(F.lit("a:1"))) == "1" and get(scalar.port(F.lit("a"))) is None
    assert scalar.valid_name("a_1") and not scalar.valid_name("a b") and get(scalar.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert tuple(get(scalar.coordinates(F.lit('{"geo": {"coordinates": [1.5, 2]}}')))) == (1.5, 2.0)
    assert get(scalar.coordinates(F.lit('{"geo": null}'))) is None and get(scalar.coordinates(F.lit(None).cast("string"))) is None
    assert get(scalar.located(F.lit('{"location": {"lat": 1, "lng": 2}, "sent": 0.5, "categories": ["a", "b"]}'))).categories == "a,b"
    assert get(scalar.starts_with(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) is True


def test_store_of_hot_keys(spark, monkeypatch):
    """A key becomes hot in the second set, when its deletion lies in its one bucket already, and is folded and gathered later."""
    monkeypatch.setattr(cowstore, "HOT_ROWS", 20)
    r = random.Random(4)
    hot = [("delete" if r.random() < 0.02 else "insert", 0, 1, 2, 1, r.randrange(100), 1, n) for n in range(200)]
    cold = [(r.choice(["insert", "delete"]), 0, i := r.randrange(2, 9), i + 1, 2, r.randrange(100), 2, n) for n in range(60)]
    first, second = [("delete", 0, 1, 2, None, 40, 0, 0)], hot + cold + hot[:30]
    store = EdgeStore(spark, fresh_path(spark, "s"), 3)
    store.load(spark.createDataFrame([(0, 1, 2, 5, 1, 60)], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"))
    make = lambda x: spark.createDataFrame(x, CHANGES + ", batch_id bigint, seq bigint")
    store.apply(make(first), ("s", 0), ["batch_id", "seq"])
    assert len(store.apply(make(second), ("s", 1), ["batch_id", "seq"])) == 3 and store.manifest()["hot"] == [[0, 1, 2]]
    assert len({x["slot"] for x in store.rows().where("src = 1 AND weight IS NOT NULL").collect()}) > 1
    assert store.apply(make(second), ("s", 1), ["batch_id", "seq"]) == []
    want = brute_state({(0, 1, 2): (5, 1, 60)}, [c[:6] for c in first + hot + cold])
    state = lambda: {(x["etype"], x["src"], x["dst"]): (x["weight"], x["time_first"], x["time_recent"]) for x in store.edges().collect()}
    assert state() == want
    n = store.rows().count()
    store.fold(99)
    assert state() == want and store.rows().count() < n
    with pytest.raises(ValueError, match="folded"):
        store.apply(make([("insert", 0, 1, 2, 1, 50, 9, 9)]), ("s", 2), ["batch_id", "seq"])
    store.resize(5)
    assert state() == want and store.manifest()["buckets"] == 5
    store.drop_old()
    assert state() == want


def test_two_writers_of_a_store(spark):
    store, other = (EdgeStore(spark, p, 2) for p in [fresh_path(spark, "s")] * 2)
    store.load(spark.createDataFrame([(0, 0, 1, 5, 1, 30)], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"))
    m = other.manifest()
    store.apply(spark.createDataFrame([("insert", 0, 3, 4, 1, 1)], CHANGES), "a", hot=[])
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit(m | {"version": 2})
    store._fs.create(store._jpath(f"{store.path}/manifests/3.claim"), False).close()
    with pytest.raises(RuntimeError, match="another writer"):
        store.apply(spark.createDataFrame([("insert", 0, 5, 6, 1, 1)], CHANGES), "b", hot=[])
    store.recover()
    store.apply(spark.createDataFrame([("insert", 0, 5, 6, 1, 1)], CHANGES), "b", hot=[])
    assert store.edges().count() == 3


def test_buffers_share_no_identity(spark):
    """The store leaves out what came before, but not what another buffer numbers alike."""
    store = EdgeStore(spark, fresh_path(spark, "s"), 2)
    store.load(spark.createDataFrame([], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"))
    for i, (a, b) in enumerate([(1, 2), (3, 4)]):
        buffer = generate.StreamBuffer(spark, strings=False)
        buffer.add_insert(a, b, time=5)
        buffer.send_batch()
        rows_ = spark.read.parquet(buffer.folder).select("op", "etype", "src", "dst", "weight", F.col("time").alias("at"), "batch_id", "seq")
        store.apply(rows_, f"buffer {i}", ["batch_id", "seq"])
    assert {(r["src"], r["dst"]) for r in store.edges().collect()} == {(1, 2), (3, 4)}
    feeds = [templates.feed_rows(templates.csv_updates(spark.createDataFrame([("1,2",)], "value string"), "$source1,$destination1")).head() for _ in range(2)]
    assert feeds[0]["batch_id"] != feeds[1]["batch_id"]


def test_buffer_by_the_clock_and_vertices(spark):
    clock = [0.0]
    b = generate.StreamBuffer(spark, every=10, clock=lambda: clock[0], batch_id=7)
    b.insert_json({"vertices": [{"vertex": "a", "type": "person", "set_weight": 3}, {"type": "x"}], "edges": [{"src": "a", "dest": "b"}]})
    assert b.tick() == 0
    clock[0] = 11.0
    assert b.tick() == 2 and b.tick() == 0
    got = spark.read.parquet(b.folder).orderBy("seq").collect()
    assert [(r["batch_id"], r["op"], r["src_str"], r["vtype_str"]) for r in got] == [(7, "vertex", "a", "person"), (7, "insert", "a", None)]


def test_long_adjacency_line(spark, tmp_path):
    """Names are numbered in the order of lines and entries, however many a line has."""
    (tmp_path / "m.txt").write_text("4 4\n" + " ".join(["3", "2"] * 40) + "\n4\n\n\n")
    g = files.metis_graph(spark, str(tmp_path / "m.txt"))
    names = {r["name"]: r["id"] for r in g.names.where("kind = 'vertex'").collect()}
    assert names == {"0": 0, "2": 1, "1": 2, "3": 3}
