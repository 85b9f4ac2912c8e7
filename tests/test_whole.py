"""Queries over whole tables against brute force on small tables."""

import random
from collections import Counter

import __spark_entry__
from hand import column, rows


def tables(spark, folder, edges):
    """The tables of a graph of (etype, src, dst, weight)."""
    ids = sorted({x for _, a, b, _ in edges for x in (a, b)})
    made = {
        "edges": spark.createDataFrame([(*e, 1, 1) for e in edges], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint"),
        "vertices": spark.createDataFrame([(v, f"v{v}", 0, 0) for v in ids], "id bigint, name string, vtype bigint, weight bigint"),
        "name_map": spark.createDataFrame([("vertex", v, f"v{v}") for v in ids], "kind string, id bigint, name string"),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_whole_components(spark, tmp_path):
    r = random.Random(5)
    edges = sorted({(r.randrange(3), r.randrange(90), r.randrange(90)) for _ in range(60)})
    want = {x: x for _, a, b in edges for x in (a, b)}
    for _ in want:
        for _, a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    d, queries = tables(spark, tmp_path, [(*e, 1) for e in edges]), __spark_entry__.queries()
    sizes = Counter(want.values())
    assert len(sizes) > 3 and max(sizes.values()) > 5
    assert column(queries["j06_components"](spark, d), "label") == want
    assert column(queries["e10_component_sizes"](spark, d), "size", "label") == sizes
    assert column(queries["e09_size_histogram"](spark, d), "labels", "size") == Counter(sizes.values())
    got = queries["e11_component_stats"](spark, d).head()
    assert (got["components"], got["min_size"], got["max_size"], got["avg_size"]) == (len(sizes), min(sizes.values()), max(sizes.values()), round(len(want) / len(sizes), 6))
    first = want[min(a for _, a, _ in edges)]
    assert rows(queries["g06_component_of"](spark, d)) == sorted(((v,) for v in want if want[v] == first), key=str)


def test_default_ranks(spark, tmp_path):
    """Ranks with the operators' own rounds and stop rules."""
    r = random.Random(6)
    edges = sorted({(0, r.randrange(30), r.randrange(30)) for _ in range(90)})
    ids = sorted({x for _, a, b in edges for x in (a, b)})
    out = Counter(a for _, a, _ in edges)
    d, queries = tables(spark, tmp_path, [(*e, 1) for e in edges]), __spark_entry__.queries()
    rank, n = {v: 1 / len(ids) for v in ids}, len(ids)
    for _ in range(20):
        lost = sum(rank[v] for v in ids if not out[v])
        new = {v: 0.85 * ((sum(rank[a] / out[a] for _, a, b in edges if b == v) if out[v] else 0) + lost / n) + 0.15 / n for v in ids}
        change, rank = sum(abs(new[v] - rank[v]) for v in ids), new
        if change <= 1e-8:
            break
    got = column(queries["j01_pagerank_default"](spark, d), "rank")
    assert got.keys() == rank.keys() and max(abs(got[v] - rank[v]) for v in ids) < 1e-9
    value = {v: 1.0 for v in ids}
    for _ in range(100):
        value = {v: 1 + 0.15 * sum(value[a] / out[a] for _, a, b in edges if b == v) for v in ids}
    got, total = column(queries["j23_power_rank_default"](spark, d), "value"), sum(value.values())
    assert max(abs(got[v] - value[v] / total) for v in ids) < 1e-6
    hub = {v: 1.0 for v in ids}
    for _ in range(10):
        authority = {v: sum(hub[a] for _, a, b in edges if b == v) for v in ids}
        norm = sum(x * x for x in authority.values()) ** 0.5
        authority = {v: x / norm for v, x in authority.items()}
        hub = {v: sum(authority[b] for _, a, b in edges if a == v) for v in ids}
        norm = sum(x * x for x in hub.values()) ** 0.5
        hub = {v: x / norm for v, x in hub.items()}
    got = queries["j11_hits_default"](spark, d).collect()
    assert max(max(abs(x["hub"] - hub[x["id"]]), abs(x["authority"] - authority[x["id"]])) for x in got) < 1e-9


def test_checkpoints_have_the_size_of_their_rows(spark):
    from graphrill.session import cut, estimated_bytes

    state = cut(spark.range(1000).selectExpr("id", "id AS value"))
    for _ in range(5):
        state = cut(state.join(state.selectExpr("id", "value AS a"), "id").join(state.selectExpr("id", "value AS b"), "id").selectExpr("id", "value + a - b AS value"))
    assert 1_000 <= estimated_bytes(state) < 200_000
    assert column(state, "value") == {i: i for i in range(1000)}
