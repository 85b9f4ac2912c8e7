"""Breadth-first searches, shortest paths and diameters, as loops of frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import intask
from graphrill.operators.columns import positions
from graphrill.session import broadcast_counted, broadcast_if_small, cut, cut_and_count, cut_and_measure

#: A search that has not ended after so many rounds is an error, not a cut.
MOST_ROUNDS = 100_000


def _arcs(g: Graph, etype: int | None, unweighted: bool, both: bool = False) -> DataFrame:
    """(src, dst, w): the least weight from vertex to vertex; 1 if unweighted."""
    e = g.of_type(etype).where("src <> dst")
    w = F.lit(1).cast("bigint") if unweighted else F.col("weight")
    arcs = e.select("src", "dst", w.alias("w"))
    if both:
        arcs = arcs.union(arcs.select("dst", "src", "w"))
    return arcs.groupBy("src", "dst").agg(F.min("w").alias("w"))


#: Levels of a search that are read side by side before they become one table.
LEVELS = 16


def distances(g: Graph, sources: DataFrame, etype: int | None = None, unweighted: bool = False, both: bool = False, target: int | None = None) -> DataFrame:
    """(source, id, dist) of every vertex that a source (id) reaches over out edges, itself with 0; others have no row.

    Weights must not be negative. Each round joins only the vertices whose distance fell in the last one. Hops only add
    vertices to those found, so found ones are not written again. With ``target`` the search ends when that vertex's distance
    cannot fall any more; other distances are then not all there or not all final.
    """
    arcs = cut(_arcs(g, etype, unweighted, both))
    start = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("bigint").alias("dist")).distinct())
    if unweighted:
        return _levels(arcs, start, target)
    if arcs.where("w < 0").limit(1).count():
        raise ValueError("a weight is negative")
    found = frontier = start
    seen = {"n": start.count()}
    for _ in range(MOST_ROUNDS):
        reached = broadcast_counted(frontier, seen["n"]).join(arcs, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        best = reached.groupBy("source", "id").agg(F.min("dist").alias("new"))
        fell = F.col("dist").isNull() | F.coalesce(F.col("new") < F.col("dist"), F.lit(False))
        merged, seen = cut_and_measure(
            found.join(best, ["source", "id"], "full").select("source", "id", F.least("dist", "new").alias("dist"), fell.alias("fell")),
            n=F.count_if(F.col("fell")), nearest=F.min(F.when(F.col("fell"), F.col("dist"))), reached=F.max(F.when(F.col("id") == F.lit(target), F.col("dist"))),
        )
        frontier = merged.where("fell").drop("fell")
        found = merged.drop("fell")
        if not seen["n"] or (seen["reached"] is not None and seen["reached"] <= seen["nearest"]):
            return found
    raise RuntimeError("the search did not end")


def _levels(arcs: DataFrame, start: DataFrame, target: int | None) -> DataFrame:
    """distances by hops: a level a round, next to those before."""
    levels, frontier = [start], start
    measures = {"n": start.count()}
    for _ in range(MOST_ROUNDS):
        seen = levels[0].select("source", "id")
        for level in levels[1:]:
            seen = seen.union(level.select("source", "id"))
        step = broadcast_counted(frontier, measures["n"]).join(arcs, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()
        frontier, measures = cut_and_measure(step.join(seen, ["source", "id"], "left_anti"), n=F.count(F.lit(1)), hits=F.count_if(F.col("id") == F.lit(target)))
        if measures["n"]:
            levels.append(frontier)
        if not measures["n"] or measures["hits"]:
            break
        if len(levels) > LEVELS:
            levels = [cut(_union(levels))]
    else:
        raise RuntimeError("the search did not end")
    return _union(levels)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def shortest_paths(g: Graph, source: int, etype: int | None = None, unweighted: bool = False) -> DataFrame:
    """(id, dist) of all vertices; null if the source does not reach one."""
    start = g.spark.createDataFrame([(source,)], "id bigint")
    return g.ids().join(distances(g, start, etype, unweighted).select("id", "dist"), "id", "left")


def point_to_point(g: Graph, source: int, target: int, unweighted: bool = False) -> DataFrame:
    """One row (source, target, dist); dist is null if there is no path."""
    start = g.spark.createDataFrame([(source,)], "id bigint")
    hit = distances(g, start, unweighted=unweighted, target=target).where(F.col("id") == target).agg(F.min("dist").alias("dist"))
    return hit.select(F.lit(source).cast("bigint").alias("source"), F.lit(target).cast("bigint").alias("target"), "dist")


def all_pairs(g: Graph, unweighted: bool = False) -> DataFrame:
    """(source, id, dist) of all pairs with a path. The result has a row for each pair, as asked."""
    return distances(g, g.ids(), unweighted=unweighted)


#: Sources that search together where only numbers about all pairs are wanted.
SOURCES = 1024


#: Bits of a column of sources.
WORD = 64


def _over_pairs(g: Graph, unweighted: bool, block: int) -> tuple[int, int, int | None]:
    """Pairs of different vertices with a path, the sum of their distances and the greatest distance of all pairs.

    The sources search in blocks, so the rows held are those of a block, not of all pairs. By hops, a vertex is one row with a
    bit for each source of the block; if all arcs fit a task, each task searches from its sources on its own.
    """
    ids, _ = cut_and_count(g.ids())
    arcs = None
    if unweighted:
        arcs, measures = cut_and_measure(_arcs(g, None, True), n=F.count(F.lit(1)))
        if measures["n"] <= intask.ARCS:
            each = intask.Shared(arcs.withColumnRenamed("w", "c")).search(ids, intask.of_pairs, "pairs bigint, total bigint, greatest bigint")
            none = F.lit(0).cast("bigint")
            return tuple(each.agg(F.coalesce(F.sum("pairs"), none), F.coalesce(F.sum("total"), none), F.max("greatest")).head())
    ranked = cut(positions(ids, [F.col("id")]).select("id", F.floor(F.col("pos") / block).alias("block"), (F.col("pos") % block).alias("at")))
    pairs, total, greatest = 0, 0, None
    for b in range(ranked.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).head()[0]):
        own = ranked.where(F.col("block") == b)
        if unweighted:
            n, length, most = _hops_in_bits(arcs, own, block)
        else:
            d = distances(g, own.select("id"))
            other = F.col("source") != F.col("id")
            n, length, most = d.agg(F.count_if(other), F.coalesce(F.sum(F.when(other, F.col("dist"))), F.lit(0)), F.max("dist")).head()
        pairs, total = pairs + n, total + length
        greatest = most if greatest is None or (most or 0) > greatest else greatest
    return pairs, total, greatest


def _hops_in_bits(arcs: DataFrame, sources: DataFrame, block: int) -> tuple[int, int, int]:
    """The numbers of _over_pairs for the sources (id, at) with ``at`` below ``block``, by hops."""
    words = range(-(-block // WORD))
    new, seen, reached = ([f"{c}{i}" for i in words] for c in "nsr")
    zero = F.lit(0).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % WORD).cast("int"))
    own = [F.when(F.floor(F.col("at") / WORD) == i, bit).otherwise(zero) for i in words]
    state = cut(sources.select("id", *[c.alias(x) for c, x in zip(own, seen)], *[c.alias(x) for c, x in zip(own, new)], zero.alias("pairs"), zero.alias("total")))
    for level in range(1, MOST_ROUNDS):
        ahead = state.where(" OR ".join(f"{x} <> 0" for x in new)).select(F.col("id").alias("src"), *new)
        step = ahead.join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(x).alias(y) for x, y in zip(new, reached)])
        both = state.drop(*new).join(step, "id", "full").fillna(0)
        both = both.select("id", "pairs", "total", *[F.col(x).bitwiseOR(F.col(y)).alias(x) for x, y in zip(seen, reached)], *[F.col(y).bitwiseAND(F.bitwise_not(x)).alias(z) for x, y, z in zip(seen, reached, new)])
        found = F.lit(0).cast("bigint")
        for x in new:
            found = found + F.bit_count(x)
        # The numbers travel with the rows, as measures only tell whether to go on.
        state, n = cut_and_count(both.withColumns({"pairs": F.col("pairs") + found, "total": F.col("total") + level * found}), " OR ".join(f"{x} <> 0" for x in new))
        if not n:
            row = state.agg(F.coalesce(F.sum("pairs"), zero), F.coalesce(F.sum("total"), zero)).head()
            return row[0], row[1], level - 1
    raise RuntimeError("the search did not end")


def mean_path(g: Graph, unweighted: bool = False, block: int = SOURCES) -> DataFrame:
    """One row ``mean``: over the pairs of different vertices with a path; null if there is none."""
    pairs, total, _ = _over_pairs(g, unweighted, block)
    return g.spark.createDataFrame([(total / pairs if pairs else None,)], "mean double")


def pseudo_diameter(g: Graph, source: int, unweighted: bool = False) -> DataFrame:
    """One row (source, target, diameter): from the farthest vertex (the least id of them) again until it gets no farther."""
    best, at = -1, source
    ends = (source, source)
    while True:
        d = distances(g, g.spark.createDataFrame([(at,)], "id bigint"), unweighted=unweighted)
        far = d.agg(F.max(F.struct("dist", -F.col("id")))).head()[0]
        dist, target = far[0], -far[1]
        if dist <= best:
            return g.spark.createDataFrame([(*ends, best)], "source bigint, target bigint, diameter bigint")
        best, ends, at = dist, (at, target), target


def exact_diameter(g: Graph, unweighted: bool = False, block: int = SOURCES) -> DataFrame:
    """One row ``diameter``: the greatest distance of all pairs with a path; null without vertices."""
    return g.spark.createDataFrame([(_over_pairs(g, unweighted, block)[2],)], "diameter bigint")


def bfs_edges(g: Graph, source: int, etype: int | None = 0) -> DataFrame:
    """(level, parent, id): the tree of a breadth-first search over the out edges of a type; the least parent wins."""
    arcs = cut(g.of_type(etype).where("src <> dst").select("src", "dst").distinct())
    seen = frontier = g.spark.createDataFrame([(0, None, source)], "level int, parent bigint, id bigint")
    for level in range(1, MOST_ROUNDS):
        step = broadcast_if_small(frontier.select("id")).join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        new = step.select(F.lit(level).alias("level"), "parent", F.col("dst").alias("id")).join(seen.select("id"), "id", "left_anti")
        frontier, n = cut_and_count(new.select("level", "parent", "id"))
        if not n:
            return seen.where("parent IS NOT NULL")
        seen = seen.union(frontier)
    raise RuntimeError("the search did not end")


def path_edges(g: Graph, source: int, target: int) -> DataFrame:
    """(src, dst, level): all edges that lie on a path of fewest hops from source to target, over out edges.

    No rows if there is no path; the level is that of dst.
    """
    start, end = (g.spark.createDataFrame([(v,)], "id bigint") for v in (source, target))
    ahead = distances(g, start, unweighted=True).select("id", F.col("dist").alias("a"))
    reverse = g.edges.select("etype", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "time_first", "time_recent")
    back = distances(g.with_(edges=reverse), end, unweighted=True).select("id", F.col("dist").alias("b"))
    total = ahead.where(F.col("id") == target).select(F.col("a").alias("total"))
    e = g.edges.select("src", "dst").where("src <> dst").distinct()
    e = e.join(ahead.withColumnRenamed("id", "src"), "src").join(back.withColumnRenamed("id", "dst"), "dst")
    return e.join(F.broadcast(total), F.col("a") + F.col("b") + 1 == F.col("total")).select("src", "dst", (F.col("a") + 1).alias("level"))
