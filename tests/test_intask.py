"""Loops that one task runs where what is left of them fits it, beside the same over tables."""

import random

import numpy as np
import pytest
from hand import column, graph

from graphrill.model import Graph
from graphrill.operators import communities, extract, intask, mutate, paths, structure
from graphrill.session import cut
from graphrill.session import cut_and_count as real
from graphrill.sources import generate
from graphrill.streaming import analytics


def some_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(3), r.randrange(n), r.randrange(n), r.randrange(1, 5)) for _ in range(m)})


def as_graph(spark, keys):
    return graph(spark, list({k[:3]: k for k in keys}.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_in_a_task_and_over_tables(spark, monkeypatch, seed):
    g = as_graph(spark, some_edges(seed, 300, 260))
    monkeypatch.setattr(structure, "FEW_ROWS", -1)
    with monkeypatch.context() as m:
        m.setattr(intask, "LINKS", -1)
        over_tables = column(structure.components(g), "label")
    # No round over tables: those would ask for the heavy vertices.
    monkeypatch.setattr(structure, "heavy", None)
    assert column(structure.components(g), "label") == over_tables and len(set(over_tables.values())) > 5


def test_forest_keeps_long_paths_and_hubs():
    path = np.arange(1000)
    np.random.default_rng(0).shuffle(path)
    label, vertex = intask.stars(np.concatenate([path[:-1], [5000] * 3]), np.concatenate([path[1:], [4999, 4000, 4500]]))
    assert dict(zip(vertex.tolist(), label.tolist())) == {v: 0 for v in range(1, 1000)} | {5000: 4000, 4999: 4000, 4500: 4000}


def test_betweenness_in_a_task_and_over_tables(spark, monkeypatch):
    g = as_graph(spark, some_edges(5, 40, 150))
    with monkeypatch.context() as m:
        m.setattr(intask, "ARCS", -1)
        over_tables = {r["id"]: r for r in structure.betweenness(g).collect()}
    # No job a level: the vertices found are no tables.
    held = []
    monkeypatch.setattr(structure, "cut_and_count", lambda df, *a: held.append(1) or real(df, *a))
    monkeypatch.setattr(intask, "CELLS", 200)
    got = {r["id"]: r for r in structure.betweenness(g).collect()}
    assert len(held) == 1 and got.keys() == over_tables.keys() and max(r["times_found"] for r in got.values()) > 20
    assert all(abs(got[v]["bc"] - over_tables[v]["bc"]) < 1e-9 and got[v]["times_found"] == over_tables[v]["times_found"] for v in got)


def test_hops_in_a_task_and_over_tables(spark, monkeypatch):
    g = as_graph(spark, [*some_edges(6, 90, 160), (0, 500, 500, 1)])
    with monkeypatch.context() as m:
        m.setattr(intask, "ARCS", -1)
        over_tables = paths._over_pairs(g, True, 64)
    # No job a level: no block is searched over tables.
    monkeypatch.setattr(paths, "_hops_in_bits", None)
    monkeypatch.setattr(intask, "CELLS", 30)
    assert paths._over_pairs(g, True, 64) == over_tables and over_tables[2] > 3
    alone = as_graph(spark, [(0, 7, 7, 1)])
    assert paths._over_pairs(alone, True, 64) == (0, 0, 0) and paths._over_pairs(Graph.empty(spark), True, 64) == (0, 0, None)


def test_expansion_takes_many_vertices_a_job(spark, monkeypatch):
    r = random.Random(8)
    g = as_graph(spark, [(0, i, (i + r.randrange(1, 4)) % 80, r.randrange(1, 5)) for i in range(80) for _ in range(3)])
    seed = [0, 7]
    steps = lambda: [r["id"] for r in extract.modular_expansion(g, seed).orderBy("step").collect()]
    jobs = []
    monkeypatch.setattr(extract, "cut", lambda df: jobs.append(1) or cut(df))
    with monkeypatch.context() as m:
        m.setattr(extract, "HELD_LINKS", 0)
        one_by_one = steps()
    assert len(jobs) > len(one_by_one) > 15
    for links, vertices in ((10**6, 10**6), (90, 10**6), (10**6, 3)):
        monkeypatch.setattr(extract, "HELD_LINKS", links)
        monkeypatch.setattr(extract, "HELD_VERTICES", vertices)
        jobs.clear()
        assert steps() == one_by_one and len(jobs) < len(one_by_one)
        if links == vertices:
            assert len(jobs) <= 4


@pytest.mark.parametrize("rule", [{"how": "cnm"}, {"how": "heaviest", "drop": 1.1}, {"how": "cnm", "most": 2, "drop": 1.5}, {"how": "heaviest", "most": 0}])
def test_agglomerate_in_a_task_and_over_tables(spark, monkeypatch, rule):
    g = as_graph(spark, some_edges(11, 60, 130))
    with monkeypatch.context() as m:
        m.setattr(intask, "LINKS", -1)
        over_tables = column(communities.agglomerate(g, both=True, **rule), "label")
    # No job a matching.
    monkeypatch.setattr(communities, "_matching", None)
    monkeypatch.setattr(communities, "_scored", None)
    assert column(communities.agglomerate(g, both=True, **rule), "label") == over_tables
    assert rule.get("most") == 0 or len(set(over_tables.values())) < len(over_tables)


def test_batch_names_are_looked_up_once(spark, monkeypatch):
    g = graph(spark, "0-1 2-3 4-5 5-6")
    row = {c.split()[0]: None for c in generate.FEED.split(", ")}
    rows = [row | {"batch_id": 1, "seq": i, "op": op, "etype": 0, "src": a, "dst": b} for i, (op, a, b) in enumerate([("insert", 1, 2), ("delete", 5, 6), ("delete", 6, 5), ("insert", 7, 8)])]
    batch = spark.createDataFrame(rows, generate.FEED)
    after = mutate.apply_batch(g, batch)
    lookups = []
    monkeypatch.setattr(analytics, "resolve", lambda *a: lookups.append(a[3]) or mutate.resolve(*a))
    own = analytics.Components().post(after, batch, analytics.Components().init(g))
    assert column(own, "label") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}
    assert lookups == ["src_str", "dst_str"]
