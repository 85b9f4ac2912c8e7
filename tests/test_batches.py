"""A batch of the feed by every way it can take, and what of it is on disk."""

import random
from pathlib import Path

from hand import edges, graph, rows
from pyspark.sql import functions as F

from graphrill.operators import mutate, naming, stats
from graphrill.plans import change_queries
from graphrill.session import shared_dir
from graphrill.sources import generate
from graphrill.streaming import runtime


def test_a_batch_moves_little(spark, tmp_path, monkeypatch):
    """Rows of a batch with keys of their own stay where they are, and edges meet the batch once; as over small tables."""
    r = random.Random(5)
    row = {c.split()[0]: None for c in generate.FEED.split(", ")}
    feed = []
    for i in range(400):
        op = r.choice(["insert", "insert", "insert", "delete", "vertex"])
        side = lambda: r.choice([{"n": r.randrange(12)}, {"s": f"v{r.randrange(12)}"}, {"s": "new" if i % 9 == 0 else "v1"}, {"s": ""}])
        a, b = side(), side()
        one = row | {"batch_id": None if i % 97 == 0 else i // 20, "seq": i % 20, "op": op, "etype": r.randrange(2), "src": a.get("n"), "src_str": a.get("s"), "weight": r.choice([None, -2, 3]), "time": r.choice([None, i])}
        one |= {"set_weight": r.choice([None, 7]), "incr_weight": r.choice([None, 1]), "vtype_str": "t"} if op == "vertex" else {"dst": b.get("n"), "dst_str": b.get("s")}
        feed += [one] * r.choice([1, 1, 1, 2])
    batch = spark.createDataFrame(feed, generate.FEED)
    base = graph(spark, "0-1 2>3 3>3 4-5 5>6 7>8")
    base = base.with_(names=base.names.union(spark.createDataFrame([("vertex", i, f"v{i}") for i in range(10)], base.names.schema)))
    held = []

    def hold(df, name):
        held.append(name)
        df.write.mode("overwrite").parquet(path := f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(path)

    for directed in (True, False):
        with monkeypatch.context() as m:
            for module in (mutate, naming):
                m.setattr(module, "is_small", lambda df: True)
            small = mutate.apply_batch(base, batch, directed)
            expected = rows(small.edges), rows(small.vertices), rows(small.names)
        with monkeypatch.context() as m:
            # Small are only the repeated keys and vertices: names, edges and the batch are not.
            m.setattr(naming, "is_small", lambda df: True)
            m.setattr(mutate, "is_small", lambda df: "set_weight" in df.columns or "_s" in df.columns)
            held.clear()
            got = mutate.apply_batch(base, batch, directed, hold)
            assert "rows" not in held and "met" in held
            assert (rows(got.edges), rows(got.vertices), rows(got.names)) == expected
            plan = got.edges._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan  # a shuffle by key for insertions, deletions and edges together
        with monkeypatch.context() as m:
            for module in (mutate, naming):
                m.setattr(module, "is_small", lambda df: False)
            got = mutate.apply_batch(base, batch, directed, hold)
            assert "rows" in held and (rows(got.edges), rows(got.vertices), rows(got.names)) == expected


def test_degrees_of_loops_and_opposite_edges(spark):
    g = graph(spark, "0-1 1>2 2>2", edges("1>0 4>3", 1))
    slots = g.incident().groupBy("id").agg(F.count_if("is_out").alias("o"), F.count_if("is_in").alias("i"), F.count(F.lit(1)).alias("n"))
    assert rows(stats.degrees(g)) == rows(slots)
    empty_end = spark.createDataFrame([(0, None, 1, 1, 0, 0)], g.edges.schema)
    assert rows(stats.degrees(g.with_(edges=empty_end))) == [(1, 0, 1, 1), (None, 1, 0, 1)]


def test_the_feed_goes_as_it_is_taken(spark, monkeypatch):
    """A part of the feed is written when the one before is applied, and none is left."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    files = lambda: {p for p in folder.glob("feed-*/*.parquet")}
    before, seen, apply = files(), [], runtime.Engine.apply
    monkeypatch.setattr(runtime.Engine, "apply", lambda self, *a: seen.append(len(files() - before)) or apply(self, *a))
    change_queries._streamed(spark, "/root/testdata/sf0.001", [])
    assert seen == [1, 1] and files() == before
