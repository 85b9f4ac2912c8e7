"""Components, cores, triangles, centrality, similarity and independent sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import intask
from graphrill.operators.lookups import heavy, lookup
from graphrill.operators.paths import MOST_ROUNDS
from graphrill.session import FEW_ROWS, broadcast_counted, broadcast_if_small, cut, cut_and_count


def components(g: Graph, etype: int | None = None) -> DataFrame:
    """(id, label): the least id of each weakly connected component; an isolated vertex has its own.

    Each task first leaves a forest of its links. If all forests together fit a task, one joins them. Else rounds alternate
    between linking all greater neighbours of a vertex to its least, and all lesser ones with itself to the least, until the
    links no longer change. So the rounds grow with the logarithm of the size, not with the diameter, and links never
    multiply.
    """
    links, count = cut_and_count(g.of_type(etype).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).mapInArrow(intask.forest, "a bigint, b bigint"))
    if count <= intask.LINKS:
        whole = cut(links.coalesce(1).mapInArrow(intask.forest, "label bigint, id bigint"))
        return g.ids().join(whole, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    links, count = cut_and_count(links.distinct())
    while True:
        few = 2 * count <= FEW_ROWS
        # Greater neighbours go to the least vertex around: a hub is joined by its least neighbour only.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _spread_join(both.where("b > a").withColumnRenamed("a", "v"), least, few).select(F.col("m").alias("a"), F.col("b").alias("b")).where("a <> b").distinct()
        # Lesser neighbours and the vertex itself go to its least neighbour.
        down = large.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
        lowest = down.groupBy("v").agg(F.min("u").alias("m"))
        small = _spread_join(down, lowest, few).select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b").union(lowest.select(F.col("m").alias("a"), F.col("v").alias("b"))).distinct()
        new, n = cut_and_count(small)
        # Equal sizes and no link that is new: the links are stars.
        if n == count and new.join(links, ["a", "b"], "left_anti").isEmpty():
            stars = new.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
            return g.ids().join(stars, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        links, count = new, n


def _spread_join(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """``rows`` (v, ...) with m of ``least`` (v, m); hot v are looked up by broadcast, all where ``least`` has few rows."""
    if few:
        return rows.join(F.broadcast(least), "v")
    found = lookup(rows, "v", least, "v", "m", "m", heavy(rows, F.col("v"), least, "v", "m"))
    return found.where("m IS NOT NULL")


def min_reachable(g: Graph, etype: int | None = None) -> DataFrame:
    """(id, label): the least id that each vertex reaches over out edges, itself included. On a symmetric graph the component."""
    arcs = cut(g.of_type(etype).where("src <> dst").select("src", "dst").distinct())
    state = cut(g.ids().select("id", F.col("id").alias("label"), F.lit(True).alias("fell")))
    for _ in range(MOST_ROUNDS):
        # Only vertices whose label fell can lower others.
        moved = state.where("fell").select(F.col("id").alias("dst"), "label")
        low = arcs.join(broadcast_if_small(moved), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("new"))
        state, n = cut_and_count(state.join(low, "id", "left").select("id", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("fell")), "fell")
        if not n:
            return state.drop("fell")
    raise RuntimeError("the labels did not settle")


def kcore(g: Graph) -> DataFrame:
    """(id, label, count): core labels by rounds of promotion over out edges, edges of different types apart.

    Label 1 needs an out edge. In round k, of the vertices with label k, those with more than k out edges to labels of at
    least k note that count; then those with more than k such edges whose ends' noted counts exceed k get label k + 1.
    Counts noted in earlier rounds stay. For exact cores see kcore_exact.
    """
    e = cut(g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")))
    out = e.select(F.col("src").alias("id")).distinct().withColumn("label", F.lit(1))
    state = cut(g.ids().join(out, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"), F.lit(0).cast("bigint").alias("count")))
    k = 0
    while True:
        k += 1
        ends = state.where(F.col("label") >= k).select(F.col("id").alias("dst"), "count")
        now = state.where(F.col("label") == k).select(F.col("id").alias("src"))
        first = e.join(now, "src", "left_semi").join(ends.drop("count"), "dst", "left_semi").groupBy("src").agg(F.sum("c").alias("n")).where(F.col("n") > k)
        state = cut(state.join(first.withColumnRenamed("src", "id"), "id", "left").select("id", "label", F.coalesce("n", "count").alias("count")))
        ends = state.where((F.col("label") >= k) & (F.col("count") > k)).select(F.col("id").alias("dst"))
        second = e.join(now, "src", "left_semi").join(ends, "dst", "left_semi").groupBy("src").agg(F.sum("c").alias("n")).where(F.col("n") > k)
        up, n = cut_and_count(second.select(F.col("src").alias("id"), F.lit(k + 1).alias("up")))
        if not n:
            return state
        state = cut(state.join(up, "id", "left").select("id", F.coalesce("up", "label").alias("label"), "count"))


def kcore_exact(g: Graph) -> DataFrame:
    """(id, core): exact core numbers of the simple undirected graph.

    A vertex's estimate starts as its degree and falls to the greatest h such that h neighbours have at least h; it settles
    at the core number. After the first round only vertices are computed again of which a neighbour fell below their own
    estimate. A hub's neighbours are counted by value before they meet.
    """
    n = cut(g.both_ways())
    state = cut(g.ids().join(n.groupBy("id").agg(F.count(F.lit(1)).alias("core")), "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core")))
    fell = None
    while True:
        value = state.select(F.col("id").alias("nbr"), F.col("core").alias("h"))
        open_ = state
        if fell is not None:
            # A neighbour that fell from at least one's own estimate to below it no longer counts.
            lower = n.join(broadcast_counted(fell, n_fell), "nbr").groupBy("id").agg(F.min("now").alias("now"))
            open_ = state.join(lower, "id").where("now < core").select("id", "core")
        near = n.join(open_, "id").join(value, "nbr")
        counts = near.select("id", F.least("h", "core").alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("c"))
        # One list per vertex of (value, count); at most as many as its estimate has values.
        lists = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("h", "c")), False).alias("l"))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("best"))
        fold = lambda a, x: F.struct((a["n"] + x["c"]).alias("n"), F.greatest(a["best"], F.least(x["h"], a["n"] + x["c"])).alias("best"))
        new = lists.select("id", F.aggregate("l", start, fold, lambda a: a["best"]).alias("new"))
        joined, n_fell = cut_and_count(state.join(new, "id", "left").select("id", F.coalesce(F.least("core", "new"), "core").alias("core"), F.coalesce(F.col("new") < F.col("core"), F.lit(False)).alias("fell")), "fell")
        if not n_fell:
            return joined.drop("fell")
        state = joined.drop("fell")
        fell = joined.where("fell").select(F.col("id").alias("nbr"), F.col("core").alias("now"))


def triangle_list(g: Graph) -> DataFrame:
    """(a, b, c): each triangle of linked vertices once, in order of degree and id.

    A link is held at its end of lower degree, so no vertex holds more than the root of twice the links, and the pairs that
    are tried stay within links^1.5, whatever the hubs.
    """
    links = g.links()
    deg = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = links.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = cut(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest("da", "db").alias("dy")))
    one = arcs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("dy").alias("db"))
    two = arcs.select(F.col("x").alias("a"), F.col("y").alias("c"), F.col("dy").alias("dc"))
    wedges = one.join(two, "a").where((F.col("db") < F.col("dc")) | ((F.col("db") == F.col("dc")) & (F.col("b") < F.col("c"))))
    return wedges.join(arcs.select(F.col("x").alias("b"), F.col("y").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangles(g: Graph) -> DataFrame:
    """(id, triangles): of every vertex, in the simple undirected graph."""
    t = triangle_list(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return g.ids().join(t, "id", "left").fillna(0, ["triangles"])


def clustering(g: Graph, closing_type: int = 0) -> DataFrame:
    """(id, ntri, outdegree, cc): directed counts and coefficients.

    ntri of v counts its out edges to u, with out edges of u to w, for which v has an edge of ``closing_type`` to w; edges
    of other types count apart. cc is ntri / (d * (d - 1)) with the out-degree d, 0 below 2. The undirected triangles are
    listed once and then weighted by their directed edges.
    """
    t = triangle_list(g)
    counts = cut(g.edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"), F.max((F.col("etype") == closing_type).cast("int")).alias("z")))
    corners = ["a", "b", "c"]
    for p in corners:
        for q in corners:
            if p != q:
                of = counts.select(F.col("src").alias(p), F.col("dst").alias(q), F.col("m").alias(f"m{p}{q}"), F.col("z").alias(f"z{p}{q}"))
                t = t.join(of, [p, q], "left").fillna(0, [f"m{p}{q}", f"z{p}{q}"])
    part = lambda v, u, w: F.col(f"m{v}{u}") * F.col(f"m{u}{w}") * F.col(f"z{v}{w}")
    of_corner = [F.struct(F.col(v).alias("id"), (part(v, u, w) + part(v, w, u)).alias("n")) for v, u, w in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))]
    ntri = t.select(F.explode(F.array(*of_corner)).alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.sum("r.n").alias("ntri"))
    out = g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outdegree"))
    rows = g.ids().join(ntri, "id", "left").join(out, "id", "left").fillna(0, ["ntri", "outdegree"])
    d = F.col("outdegree")
    return rows.withColumn("cc", F.when(d > 1, F.col("ntri") / (d * (d - 1))).otherwise(0.0))


def betweenness(g: Graph, samples: int | None = None, seed: int = 0) -> DataFrame:
    """(id, bc, times_found): dependencies summed over sources, unnormalised; a source's own is left out.

    All sources, or ``samples`` of them in the order of a seeded hash if there are more vertices. Paths follow out edges;
    edges of different types are different paths. If all arcs fit a task, each task searches from its sources on its own. Else
    all sources advance together, a level a round; the rows are those of the vertices that each source reaches.
    """
    arcs, n = cut_and_count(g.edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("c")))
    ids = cut(g.ids())
    sources = ids if samples is None else ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples)
    if n <= intask.ARCS:
        found = intask.Shared(arcs, both=True).search(sources, intask.of_sources, "id bigint, bc double, times_found bigint")
        sums = found.groupBy("id").agg(F.sum("bc").alias("bc"), F.sum("times_found").alias("times_found"))
        return ids.join(sums, "id", "left").fillna(0.0, ["bc"]).fillna(0, ["times_found"])
    frontier = cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))
    levels = [frontier]
    seen = frontier.select("s", "id")
    while True:
        step = frontier.join(arcs, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("sigma") * F.col("c")).alias("sigma"))
        frontier, n = cut_and_count(step.join(seen, ["s", "id"], "left_anti"))
        if not n:
            break
        levels.append(frontier)
        seen = seen.union(frontier.select("s", "id"))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    parts = [delta] if len(levels) > 1 else []
    for level in reversed(levels[1:-1]):
        after = delta.select("s", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("x"))
        gain = level.join(arcs, F.col("id") == F.col("src")).join(after, ["s", "dst"]).groupBy("s", "id").agg(F.sum(F.col("sigma") * F.col("c") * F.col("x")).alias("delta"))
        delta = cut(level.join(gain, ["s", "id"], "left").fillna(0.0, ["delta"]))
        parts.append(delta)
    found = g.spark.createDataFrame([], "id bigint, delta double")
    for p in parts:
        found = found.union(p.select("id", "delta"))
    sums = found.groupBy("id").agg(F.sum("delta").alias("bc"), F.count(F.lit(1)).alias("times_found"))
    return ids.join(sums, "id", "left").fillna(0.0, ["bc"]).fillna(0, ["times_found"])


def adamic_adar(g: Graph, source: int, etype: int | None = None) -> DataFrame:
    """(id, score) of the vertices two hops from the source that are not its neighbours: sum of 1 / ln(degree) of the common
    neighbours, whose degree (slots) is over 1. Direction does not count."""
    slots = g.slots(etype)
    near = broadcast_if_small(slots.where((F.col("id") == source) & (F.col("nbr") != source)).select(F.col("nbr").alias("z")).distinct())
    # The neighbourhoods of the common neighbours only; a slot per type counts for the degree.
    around = slots.join(near, F.col("id") == F.col("z"), "left_semi")
    deg = around.groupBy(F.col("id").alias("z")).agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    pairs = around.select(F.col("id").alias("z"), F.col("nbr").alias("id")).distinct().where(F.col("id") != source)
    scored = pairs.join(deg, "z").join(near.withColumnRenamed("z", "id"), "id", "left_anti")
    return scored.groupBy("id").agg(F.sum(1 / F.log("d")).alias("score"))


def independent_set(g: Graph, seed: int = 0) -> DataFrame:
    """(id): a maximal set of vertices without links among them, in rounds: a vertex whose seeded hash is the least among its
    open neighbours enters, and its neighbours leave. Vertices with a self loop can enter; links are between two vertices."""
    n = cut(g.both_ways())
    open_ = cut(g.ids().withColumn("h", F.struct(F.xxhash64("id", F.lit(seed)), "id")))
    chosen = g.spark.createDataFrame([], "id bigint")
    while True:
        least = n.join(open_.select(F.col("id").alias("nbr"), "h"), "nbr").groupBy("id").agg(F.min("h").alias("least"))
        won = cut(open_.join(least, "id", "left").where(F.col("least").isNull() | (F.col("h") < F.col("least"))).select("id"))
        chosen = chosen.union(won)
        gone = won.union(n.join(won, "id", "left_semi").select("nbr")).distinct()
        open_, left = cut_and_count(open_.join(gone, "id", "left_anti"))
        if not left:
            return chosen
        n = cut(n.join(open_.select("id"), "id", "left_semi").join(open_.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id", "nbr"))
