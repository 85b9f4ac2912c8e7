import math
import random
from collections import Counter, defaultdict, deque

import pytest
from hand import AA9, AA9_DIRECTED, BC9, DAG19, DIAM7, PATH7, PR4, column, edges, graph, rows
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import communities, extract, paths, ranking, stats, structure

CLIQUE = [(0, i, j, 1) for i in range(10, 20) for j in range(10, 20) if i != j]


def near(got, want, by=1e-3):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= by for k in want), (got, want)


def test_pagerank_hand(spark):
    want = dict(enumerate(x / 4 for x in (1.49, 0.78, 1.58, 0.15)))
    near(column(ranking.pagerank(graph(spark, PR4), most=100), "rank"), want)
    both = graph(spark, PR4, CLIQUE)
    four = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    near(column(ranking.subset_pagerank(both, four, most=100), "rank"), want)


def test_typed_pagerank_hand(spark):
    g = graph(spark, PR4, [(1, i, j, 1) for _, i, j, _ in CLIQUE])
    r = column(ranking.pagerank(g, 0, epsilon=1e-12, most=100, dangling_receives=True), "rank")
    assert abs(r[0] / r[1] - 1.49 / 0.78) < 1e-2 and len({round(r[i], 9) for i in range(10, 20)}) == 1
    assert abs(sum(r.values()) - 1) < 1e-9


def test_dangling_rule(spark):
    g = graph(spark, "0>1")
    quirk = column(ranking.pagerank(g, most=50), "rank")
    book = column(ranking.pagerank(g, most=50, dangling_receives=True), "rank")
    assert abs(sum(book.values()) - 1) < 1e-6 and book[1] > book[0] and abs(quirk[1] - quirk[0]) < 1e-9


def test_warm_start_agrees(spark):
    g = graph(spark, PR4)
    cold = column(ranking.pagerank(g, epsilon=1e-10, most=200), "rank")
    start = g.ids().withColumn("rank", F.when(F.col("id") == 0, 1.0).otherwise(0.0))
    near(column(ranking.pagerank(g, epsilon=1e-10, most=200, start=start), "rank"), cold, 1e-6)


def test_betweenness_hand(spark):
    near(column(structure.betweenness(graph(spark, BC9)), "bc"), dict(enumerate([0, 7, 2, 4, 2, 7, 0, 3, 0])))
    both = graph(spark, BC9.replace(">", "-"))
    near(column(structure.betweenness(both), "bc"), dict(enumerate([0, 24.333333, 7.333333, 10, 4, 15.666667, 0, 6.666667, 4])), 1e-5)
    sampled = structure.betweenness(both, 3, seed=1)
    assert sampled.count() == 9 and sampled.agg(F.max("times_found")).head()[0] <= 3


def test_adamic_adar_hand(spark):
    ln = math.log
    near(column(structure.adamic_adar(graph(spark, AA9), 0), "score"), {4: 1 / ln(2) + 1 / ln(5), 5: 1 / ln(5), 6: 1 / ln(5), 7: 1 / ln(5), 8: 1 / ln(2)}, 1e-9)
    assert column(structure.adamic_adar(graph(spark, AA9_DIRECTED), 0), "score").keys() == {4, 5, 6, 7, 8}
    assert structure.adamic_adar(graph(spark, AA9), 99).count() == 0


def test_paths_hand(spark):
    g = graph(spark, PATH7)
    hops = column(paths.shortest_paths(g, 5, unweighted=True), "dist")
    assert hops[2] == 3 and hops[0] is None
    assert paths.point_to_point(g, 2, 3, unweighted=True).head()["dist"] == 2
    assert paths.point_to_point(g, 5, 0).head()["dist"] is None
    d = graph(spark, DAG19)
    assert paths.point_to_point(d, 1, 18).head()["dist"] == 26
    assert paths.point_to_point(d, 1, 18, unweighted=True).head()["dist"] == 3
    with pytest.raises(ValueError, match="negative"):
        paths.shortest_paths(graph(spark, [(0, 0, 1, -1)]), 0)


def test_diameters_hand(spark):
    g = graph(spark, DIAM7)
    assert paths.pseudo_diameter(g, 1).head()["diameter"] == 2
    assert paths.pseudo_diameter(g, 0).head()["diameter"] == 4
    assert paths.exact_diameter(g).head()[0] == 5


def test_hits_hand(spark):
    ring = graph(spark, " ".join(f"{i}-{(i + 1) % 9}" for i in range(9)))
    r = ranking.hits(ring, 5).collect()
    assert len({round(x["hub"], 9) for x in r}) == 1 and len({round(x["authority"], 9) for x in r}) == 1
    two = graph(spark, " ".join(f"{i}>{j}" for i in range(5) for j in range(5, 10)))
    r = {x["id"]: x for x in ranking.hits(two, 4).collect()}
    assert len({round(r[i]["hub"], 9) for i in range(5)}) == 1 and all(r[i]["authority"] == 0 for i in range(5))


@pytest.mark.parametrize("text", [DIAM7, DAG19, "0-1 1-2 2-3 3-0", "0>0"])
def test_independent_set(spark, text):
    g = graph(spark, text)
    chosen = {r["id"] for r in structure.independent_set(g, 3).collect()}
    linked = {frozenset((a, b)) for _, a, b, _ in edges(text) if a != b}
    assert not any(frozenset((a, b)) in linked for a in chosen for b in chosen)
    for v in {r["id"] for r in g.ids().collect()} - chosen:
        assert any(frozenset((v, c)) in linked for c in chosen)


def random_edges(seed, n=30, m=60, types=2):
    r = random.Random(seed)
    return sorted({(r.randrange(types), r.randrange(n), r.randrange(n)): 1 for _ in range(m)})


def as_graph(spark, keys):
    return graph(spark, [(*k, 1) for k in keys])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_brute_force(spark, seed):
    keys = random_edges(seed, 40, 35)
    near_ = defaultdict(set)
    for _, a, b in keys:
        near_[a].add(b)
        near_[b].add(a)
    want = {}
    for v in sorted(near_):
        if v not in want:
            queue = deque([v])
            while queue:
                u = queue.popleft()
                if u not in want:
                    want[u] = v
                    queue.extend(near_[u])
    g = as_graph(spark, keys)
    assert column(structure.components(g), "label") == want
    sizes = Counter(want.values())
    assert column(stats.label_sizes(structure.components(g)), "size", "label") == sizes


def test_long_path_components(spark):
    order = list(range(200))
    random.Random(0).shuffle(order)
    g = graph(spark, [(0, a, b, 1) for a, b in zip(order, order[1:])])
    assert set(column(structure.components(g), "label").values()) == {0}


def test_triangles_and_clustering_brute_force(spark):
    keys = random_edges(4, 14, 90)
    g = as_graph(spark, keys)
    links = {frozenset((a, b)) for _, a, b in keys if a != b}
    ids = sorted({x for _, a, b in keys for x in (a, b)})
    tri = Counter()
    for i, a in enumerate(ids):
        for j, b in enumerate(ids[i + 1 :], i + 1):
            for c in ids[j + 1 :]:
                if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= links:
                    tri.update((a, b, c))
    assert column(structure.triangles(g), "triangles") == {v: tri[v] for v in ids}
    ntri = Counter()
    for _, v, u in keys:
        for _, u2, w in keys:
            if v != u and u == u2 and w not in (v, u) and (0, v, w) in keys:
                ntri[v] += 1
    assert column(structure.clustering(g), "ntri") == {v: ntri[v] for v in ids}


def test_kcore(spark):
    four = " ".join(f"{i}-{j}" for i in range(4) for j in range(i + 1, 4))
    g = graph(spark, four + " 3-4 4-5")
    assert column(structure.kcore_exact(g), "core") == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    labels = column(structure.kcore(g), "label")
    assert labels[5] == 1 and labels[0] >= 2


def test_communities(spark):
    two = "0-1 0-2 1-2 3-4 3-5 4-5 2-3"
    g = graph(spark, two)
    labels = column(communities.agglomerate(g), "label")
    assert labels[0] == labels[1] == labels[2] != labels[3] == labels[4] == labels[5]
    q = stats.quality(g, communities.agglomerate(g)).head()
    assert abs(q["coverage"] - 12 / 14) < 1e-9 and q["modularity"] > 0.3 and q["mirror_coverage"] == 1
    for how in ("conductance", "heaviest", "mb"):
        assert communities.agglomerate(g, how).count() == 6
    assert max(Counter(column(communities.agglomerate(g, largest=2), "label").values()).values()) <= 2


def test_communities_of_a_star(spark):
    """A hub takes in one leaf a round, or with trees all at once; no number of rounds leaves leaves over."""
    star = graph(spark, " ".join(f"0-{i}" for i in range(1, 9)))
    assert set(column(communities.agglomerate(star, "heaviest"), "label").values()) == {0}
    assert set(column(communities.agglomerate(star, "heaviest", trees=True, most=1), "label").values()) == {0}
    assert len(set(column(communities.agglomerate(star, "heaviest", most=1), "label").values())) == 8
    assert len(set(column(communities.agglomerate(star, "heaviest", most_links=3), "label").values())) == 9
    heavy = graph(spark, "0-1:8 2-3:8 1-2:1")
    assert len(set(column(communities.agglomerate(heavy, "heaviest", drop=1.1), "label").values())) == 2


def test_expansion_against_brute_force(spark):
    keys = random_edges(3, 14, 40)
    g = as_graph(spark, keys)
    w = defaultdict(Counter)
    for _, a, b in keys:
        if a != b:
            w[a][b] += 1
            w[b][a] += 1
    vol = {v: sum(w[v].values()) for v in w}
    total, inside = sum(vol.values()), [keys[0][1]]
    while True:
        size = sum(vol[v] for v in inside)
        near = {u: sum(w[u][v] for v in inside) for v in inside for u in w[v] if u not in inside}
        if not near:
            break
        best = min(near, key=lambda u: (-(near[u] - vol[u] * size / total), -near[u], u))
        if near[best] - vol[best] * size / total < 0:
            break
        inside.append(best)
    assert [x["id"] for x in extract.modular_expansion(g, [keys[0][1]]).orderBy("step").collect()] == inside


def test_hops_of_all_pairs_hold_a_row_for_each_vertex(spark, monkeypatch):
    keys = random_edges(9, 20, 45)
    g = as_graph(spark, keys)
    pairs = [x["dist"] for x in paths.all_pairs(g, unweighted=True).where("source <> id").collect()]
    held = []

    def counted(df, *a, **k):
        out = paths.cut(df)
        held.append(out.count())
        return out, out.where(a[0]).count() if a else held[-1]

    monkeypatch.setattr(paths, "cut_and_count", counted)
    monkeypatch.setattr(paths, "distances", None)
    assert paths._over_pairs(g, True, 70) == (len(pairs), sum(pairs), max(pairs))
    assert held and max(held) <= g.ids().count()


def test_all_pairs_in_blocks(spark):
    keys = random_edges(9, 20, 45)
    g = as_graph(spark, keys)
    pairs = [x["dist"] for x in paths.all_pairs(g, unweighted=True).where("source <> id").collect()]
    assert paths.exact_diameter(g, True, block=6).head()[0] == max(pairs)
    assert abs(paths.mean_path(g, True, block=6).head()[0] - sum(pairs) / len(pairs)) < 1e-12


def test_agglomerate_update(spark):
    g = graph(spark, "0-1 0-2 1-2 3-4 3-5 4-5 2-3")
    start = communities.agglomerate(g)
    moved = graph(spark, "0-1 0-2 1-2 3-4 3-5 4-5 2-3 0-3 0-4 0-5")
    labels = column(communities.agglomerate(moved, start=start, singles=spark.createDataFrame([(0,)], "id bigint")), "label")
    assert labels.keys() == set(range(6)) and labels[3] == labels[4] == labels[5]


def test_partition_brute_force(spark):
    keys = random_edges(7, 25, 80)
    g = as_graph(spark, keys)
    ids = sorted({x for _, a, b in keys for x in (a, b)})
    parts, capacity = 3, 12.0
    weight = defaultdict(Counter)
    for _, a, b in keys:
        if a != b:
            weight[a][b] += 1
    size, want = [0] * parts, {}
    for v in ids:
        score = [sum(w for u, w in weight[v].items() if want.get(u) == p + 1) * (1 - size[p] / capacity) for p in range(parts)]
        p = min(range(parts), key=lambda p: (-score[p], size[p], p))
        want[v] = p + 1
        size[p] += 1
    assert column(communities.partition(g, parts, capacity, block=7), "part") == want
    assert column(communities.partition(g, parts, capacity), "part") == want


def test_adopt_labels_and_modularity(spark):
    g = graph(spark, "0-1 1-2 3-4")
    assert communities.adopt_labels(g, 3).count() == 5
    m = {(r["src"], r["dst"]): r["modularity"] for r in communities.pair_modularity(g).collect()}
    assert abs(m[3, 4] - (1 / 6 - 1 * 1 / 36)) < 1e-12


def test_expansion_and_searches(spark):
    g = graph(spark, "0-1 0-2 1-2 3-4 3-5 4-5 2-3")
    assert [r["id"] for r in extract.modular_expansion(g, [0], 3).orderBy("step").collect()] == [0, 1, 2]
    labels = communities.agglomerate(g)
    found = extract.label_search(g, [0], labels)
    assert {r["id"] for r in found.collect()} == {0, 1, 2}
    assert extract.label_search(g, [0], labels, limit=2).count() == 2
    assert extract.label_search_edges(g, found).count() == 3
    assert rows(paths.bfs_edges(graph(spark, "0>1 0>2 1>3 2>3"), 0)) == [(1, 0, 1), (1, 0, 2), (2, 1, 3)]
    assert paths.path_edges(graph(spark, "0>1 2>3"), 0, 3).count() == 0


def test_semiring_and_power(spark):
    g = graph(spark, "0>1:2 0>2:3 1>2:4")
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 5.0)], "id bigint, value double")
    assert column(ranking.matvec(g, x), "value") == {0: 19.0, 1: 20.0}
    assert column(ranking.matvec(g, x, "max", "min", empty=-1.0), "value") == {0: 3.0, 1: 4.0, 2: -1.0}
    assert column(ranking.transposed_matvec(g, x, 2.0, 1.0, x, unit=False), "value") == {0: 1.0, 1: 6.0, 2: 5.0 + 6.0 + 16.0}
    assert abs(sum(column(ranking.power_rank(g), "value").values()) - 1) < 1e-9


def test_empty_graph(spark):
    g = Graph.empty(spark, ("a",), ("b",))
    assert ranking.pagerank(g).count() == structure.components(g).count() == structure.triangles(g).count() == 0
    assert structure.independent_set(g).count() == structure.kcore_exact(g).count() == structure.betweenness(g).count() == 0
    assert communities.agglomerate(g).count() == communities.partition(g, 2, 5).count() == 0
    assert stats.totals(g).head()["total_edges"] == 0 and sum(r["n"] for r in stats.check(g).collect()) == 0
    assert paths.mean_path(g).head()["mean"] is None


def test_exact_diameter_in_bits(spark, monkeypatch):
    monkeypatch.setattr(paths, "distances", None)
    g = graph(spark, "0>1 1>2 2>3 9>8")
    assert paths.exact_diameter(g, True, block=2).head()[0] == 3


def test_components_of_few_links_need_no_sketch(spark, monkeypatch):
    g = graph(spark, "0-1 1-2 4>3 7>5 9>7")
    monkeypatch.setattr(structure, "heavy", None)
    assert column(structure.components(g), "label") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 7: 5, 9: 5}
    assert set(column(communities.agglomerate(graph(spark, "0>1 0>2 0>3"), "heaviest", trees=True, most=1), "label").values()) == {0}
