"""Modularity, communities and partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import intask
from graphrill.operators.columns import positions
from graphrill.operators.structure import components
from graphrill.session import cut, cut_and_count


def pair_modularity(g: Graph) -> DataFrame:
    """(src, dst, modularity) of linked ordered pairs: w / m - out(src) * in(dst) / m^2, over weights of all types."""
    w = g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = g.edges.groupBy("src").agg(F.sum("weight").alias("k_out"))
    into = g.edges.groupBy("dst").agg(F.sum("weight").alias("k_in"))
    m = F.broadcast(g.edges.agg(F.sum("weight").cast("double").alias("m")))  # one row
    value = F.col("w") / F.col("m") - F.col("k_out") * F.col("k_in") / (F.col("m") * F.col("m"))
    return w.join(out, "src").join(into, "dst").crossJoin(m).select("src", "dst", value.alias("modularity"))


def adopt_labels(g: Graph, most: int = 20) -> DataFrame:
    """(id, label): first level of modularity communities. Every vertex takes the label of its out neighbour of the greatest
    pair modularity (the least id of equals), all at once, until no label moves or ``most`` rounds are done."""
    best = pair_modularity(g).groupBy(F.col("src").alias("id")).agg(F.max(F.struct("modularity", (-F.col("dst")).alias("d"))).alias("b"))
    best = cut(best.select("id", (-F.col("b.d")).alias("follows")))
    state = cut(g.ids().withColumn("label", F.col("id")))
    for _ in range(most):
        labels = state.select(F.col("id").alias("follows"), F.col("label").alias("new"))
        moved, n = cut_and_count(state.join(best.join(labels, "follows"), "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.coalesce(F.col("new") != F.col("label"), F.lit(False)).alias("moved")), "moved")
        state = moved.drop("moved")
        if not n:
            break
    return state


def _scored(e: DataFrame, d: DataFrame, how: str) -> DataFrame:
    """Community edges (i, j, w) with a score; ``d`` is (i, inside)."""
    if how == "heaviest":
        return e.withColumn("score", F.col("w").cast("double"))
    volume = e.select("i", "w").union(e.select("j", "w")).union(d.select("i", "inside")).groupBy("i").agg(F.sum("w").alias("vol"))
    total = F.broadcast(e.agg(F.sum("w").alias("x")).crossJoin(d.agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("y"))).select((F.col("x") + F.col("y")).cast("double").alias("total")))  # single rows
    s = e.join(volume, "i").join(volume.select(F.col("i").alias("j"), F.col("vol").alias("vol_j")), "j").crossJoin(total)
    cnm = 2 * (F.col("w") / F.col("total") - (F.col("vol") / F.col("total")) * (F.col("vol_j") / F.col("total")))
    if how == "conductance":
        inside = d.select("i", F.col("inside").alias("d_i")), d.select(F.col("i").alias("j"), F.col("inside").alias("d_j"))
        s = s.join(inside[0], "i", "left").join(inside[1], "j", "left").fillna(0, ["d_i", "d_j"])

        def phi(vol, cut_):
            least = F.least(vol, 2 * F.col("total") - vol)
            return F.when(least > 0, cut_ / least).otherwise(0.0)

        a, b = F.col("vol"), F.col("vol_j")
        ca, cb = a - F.col("d_i"), b - F.col("d_j")
        return s.withColumn("score", phi(a, ca) + phi(b, cb) - phi(a + b, ca + cb - 2 * F.col("w"))).select("i", "j", "w", "score")
    s = s.withColumn("score", cnm).select("i", "j", "w", "score")
    if how == "mb":
        stats = F.broadcast(s.agg((F.avg("score") + 1.5 * F.stddev_pop("score")).alias("bound")))
        s = s.crossJoin(stats).where(F.col("score") >= F.col("bound")).drop("bound")  # one row
    return s


def _matching(s: DataFrame) -> DataFrame:
    """(i, j): a greedy maximal matching by score, then the lower (i, j): edges that are best for both ends, until none is left."""
    s, left = cut_and_count(s.where("score > 0"))
    matched = s.sparkSession.createDataFrame([], "i bigint, j bigint")
    while left:
        rank = F.struct("score", (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
        ends = s.select(F.col("i").alias("v"), rank.alias("r")).union(s.select("j", rank))
        best = ends.groupBy("v").agg(F.max("r").alias("r"))
        twice = best.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        pairs = cut(twice.select((-F.col("r.a")).alias("i"), (-F.col("r.b")).alias("j")))
        matched = matched.union(pairs)
        gone = pairs.select("i").union(pairs.select("j"))
        s, left = cut_and_count(s.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti"))
    return matched


def _trees(s: DataFrame) -> DataFrame:
    """(i, j): the best link of every community by score, then the lower (i, j), as far as it is above 0; they form trees, and
    each j is the member of a tree with the least i."""
    rank = F.struct("score", (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
    s = s.where("score > 0")
    best = s.select(F.col("i").alias("v"), rank.alias("r")).union(s.select("j", rank)).groupBy("v").agg(F.max("r").alias("r"))
    # Held, as the components read them several times.
    links = cut(best.select((-F.col("r.a")).alias("src"), (-F.col("r.b")).alias("dst")).distinct())
    return components(Graph.of(links)).where("id <> label").select(F.col("label").alias("i"), F.col("id").alias("j"))


def agglomerate(g: Graph, how: str = "cnm", most: int | None = None, coverage: float | None = None, largest: int | None = None, singles: DataFrame | None = None, start: DataFrame | None = None, both: bool = False, trees: bool = False, drop: float | None = None, most_links: int | None = None) -> DataFrame:
    """(id, label): communities by repeated matching and contraction of the community graph; the label is the least id.

    Links are the edges from a lower to a higher id (with ``both`` those of either direction), by weight. A round scores the
    links between communities ('cnm', 'conductance', 'heaviest' or 'mb'), matches greedily those above 0 and merges each
    pair; with ``trees`` every community joins along its best link, so that a hub takes in all its leaves in one round.

    It ends when nothing merges, or when ``coverage`` of the weight is inside, or when the best score is below that of the
    round before over ``drop``; ``most`` rounds are no limit unless one is given. ``largest`` forbids greater communities, and
    communities with more than ``most_links`` links take no part. Once what is between communities fits a task, it runs the
    rounds that are left, for 'cnm' and 'heaviest' without limits of size or coverage. ``start`` (id, label) gives communities to go on from, in which the vertices ``singles`` (id)
    begin anew; the result is then that of an update.
    """
    ids = g.ids()
    if start is not None:
        keep = start if singles is None else start.join(singles.select("id"), "id", "left_anti")
        # A community whose least member left has its new least member as label.
        names = keep.groupBy("label").agg(F.min("id").alias("least"))
        keep = keep.join(names, "label").select("id", F.col("least").alias("label"))
        labels = ids.join(keep, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    else:
        labels = ids.withColumn("label", F.col("id"))
    labels = cut(labels)
    e = g.edges if both else g.edges.where("src <= dst")
    by = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"l{end}"))
    flows = e.join(by("src"), "src").join(by("dst"), "dst").groupBy(F.least("lsrc", "ldst").alias("i"), F.greatest("lsrc", "ldst").alias("j")).agg(F.sum("weight").alias("w"))
    flows, n_flows = cut_and_count(flows)
    links, d = flows.where("i <> j"), flows.where("i = j").select("i", F.col("w").alias("inside"))
    before = None
    # The rules that need no more than the flows; a task then runs the rounds that are left.
    plain = how in ("cnm", "heaviest") and not trees and coverage is None and largest is None and most_links is None
    while most is None or most > 0:
        if plain and n_flows <= intask.LINKS:
            rest = flows.select("i", "j", "w").coalesce(1).mapInArrow(intask.merges(how == "cnm", drop, before, most), "old bigint, new bigint")
            return cut(labels.join(cut(rest).withColumnRenamed("old", "label"), "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        most = None if most is None else most - 1
        if coverage is not None:
            inside, between = d.agg(F.coalesce(F.sum("inside"), F.lit(0))).head()[0], links.agg(F.coalesce(F.sum("w"), F.lit(0))).head()[0]
            if inside + between and inside / (inside + between) >= coverage:
                break
        s = _scored(links, d, how)
        if largest is not None:
            sizes = labels.groupBy(F.col("label").alias("i")).agg(F.count(F.lit(1)).alias("n"))
            s = s.join(sizes, "i").join(sizes.select(F.col("i").alias("j"), F.col("n").alias("n_j")), "j").where(F.col("n") + F.col("n_j") <= largest).select("i", "j", "w", "score")
        if most_links is not None:
            degree = links.select("i").union(links.select("j")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_links).select("i")
            s = s.join(degree, "i", "left_anti").join(degree.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "w", "score")
        if drop is not None:
            best = s.agg(F.max("score")).head()[0]
            if best is None or (before is not None and best < before / drop):
                break
            before = best
        merged, n = cut_and_count(_trees(s) if trees else _matching(s))
        if not n:
            break
        # j joins i, which is lower.
        to = merged.select(F.col("j").alias("old"), F.col("i").alias("new"))
        labels = cut(labels.join(to.withColumnRenamed("old", "label"), "label", "left").select("id", F.coalesce("new", "label").alias("label")))
        a = links.join(to.withColumnsRenamed({"old": "i", "new": "ni"}), "i", "left").join(to.withColumnsRenamed({"old": "j", "new": "nj"}), "j", "left")
        a = a.select(F.coalesce("ni", "i").alias("x"), F.coalesce("nj", "j").alias("y"), "w")
        flows = a.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "w")
        own = d.join(to.withColumnsRenamed({"old": "i", "new": "ni"}), "i", "left").select(F.coalesce("ni", "i").alias("i"), F.coalesce("ni", "i").alias("j"), F.col("inside").alias("w"))
        flows, n_flows = cut_and_count(flows.union(own).groupBy("i", "j").agg(F.sum("w").alias("w")))
        links, d = flows.where("i <> j"), flows.where("i = j").select("i", F.col("w").alias("inside"))
    return labels


#: Vertices that partition places in one task; what they know of the rest is one row per part.
BLOCK = 50_000


def partition(g: Graph, parts: int, capacity: float, block: int = BLOCK) -> DataFrame:
    """(id, part): vertices in the order of ids go to the part (1 to ``parts``) of the greatest weight of out edges into it,
    times 1 - size / capacity; of equal scores to the smaller part, then the lower number.

    Each choice depends on all before, so the order is kept: blocks of vertices follow one another, and a task gets one block,
    its weights into the parts so far (at most ``parts`` rows a vertex), its inner edges and the sizes of the parts.
    """
    spark = g.spark
    ranked = cut(positions(g.ids(), [F.col("id")]).select("id", F.floor(F.col("pos") / block).alias("block")))
    blocks = ranked.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).head()[0]
    at = lambda end: ranked.select(F.col("id").alias(end), F.col("block").alias(f"b_{end}"))
    e = cut(g.edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(at("src"), "src").join(at("dst"), "dst"))
    placed = spark.createDataFrame([], "id bigint, part bigint")
    sizes = [0] * parts

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        gains: dict[int, dict[int, int]] = {}
        inner: dict[int, list[tuple[int, int]]] = {}
        vertices = []
        for kind, v, x, w in pdf[["kind", "v", "x", "w"]].itertuples(index=False):
            if kind == 0:
                vertices.append(v)
            elif kind == 1:
                gains.setdefault(v, {})[x] = w
            else:
                inner.setdefault(v, []).append((x, w))
        size, mine = list(sizes), {}
        for v in sorted(vertices):
            gain = dict(gains.get(v, {}))
            for x, w in inner.get(v, []):
                if x in mine:
                    gain[mine[x]] = gain.get(mine[x], 0) + w
            score = [gain.get(p + 1, 0) * (1 - size[p] / capacity) for p in range(parts)]
            best = min(range(parts), key=lambda p: (-score[p], size[p], p))
            mine[v] = best + 1
            size[best] += 1
        return pd.DataFrame({"id": list(mine), "part": list(mine.values())}, dtype="int64")

    for b in range(blocks):
        own = ranked.where(F.col("block") == b).select(F.lit(0).alias("kind"), F.col("id").alias("v"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("w"))
        out = e.where(F.col("b_src") == b)
        past = out.where(F.col("b_dst") < b).join(placed.withColumnRenamed("id", "dst"), "dst").groupBy("src", "part").agg(F.sum("w").alias("w"))
        rows = own.union(past.select(F.lit(1), "src", "part", "w")).union(out.where(F.col("b_dst") == b).select(F.lit(2), "src", "dst", "w"))
        new = cut(rows.groupBy(F.lit(b).alias("b")).applyInPandas(place, "id bigint, part bigint"))
        for r in new.groupBy("part").count().collect():  # one row a part
            sizes[r["part"] - 1] += r["count"]
        placed = cut(placed.union(new))
    return placed
