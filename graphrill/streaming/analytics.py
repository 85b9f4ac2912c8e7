"""Analytics that follow the graph: rates, triangles, components, ranks, communities, centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.model import Graph
from graphrill.operators import communities, ranking, stats, structure
from graphrill.operators.extract import induced
from graphrill.operators.mutate import DEFAULTS, resolve
from graphrill.operators.traverse import affected
from graphrill.session import broadcast_if_small, cut


def ends(g: Graph, batch: DataFrame, op: str | None = None, *more: str) -> DataFrame:
    """(src, dst) and ``more`` columns of the batch's edges through the names of ``g``, unset ends as apply_batch takes them;
    strings that are no name are left out."""
    rows = batch.where(F.col("op").isin("insert", "delete") if op is None else F.col("op") == op)
    unnamed = rows
    for end in ("src", "dst"):
        rows = resolve(g.names, rows, "vertex", f"{end}_str", end, DEFAULTS[end], unnamed)
    return rows.select("src", "dst", *more).dropna(subset=["src", "dst"])


#: An update of communities ends when the best score falls by this factor in a round; a fixed value of the rule.
DROP = 1.1


def decay(rows: DataFrame, column: str, by: float) -> DataFrame:
    """``rows`` with a column multiplied by a weight."""
    return rows.withColumn(column, F.col(column) * by)


class RateMonitor:
    """Exponential means of how often batches name each vertex: velocity, and acceleration against the velocity before."""

    name, needs, k = "rate_monitor", (), 0.333

    def init(self, g: Graph) -> DataFrame:
        return g.spark.createDataFrame([], "id bigint, velocity double, acceleration double")

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        e = ends(g, batch)
        counts = e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n"))
        both = own.join(counts, "id", "full").fillna(0.0, ["velocity", "acceleration", "n"])
        k, v, n = F.lit(self.k), F.col("velocity"), F.col("n")
        return both.select("id", (k * v + (1 - k) * n).alias("velocity"), (k * F.col("acceleration") + (1 - k) * (n - v)).alias("acceleration"))


class Triangles:
    """Triangles of each vertex; after a batch only the vertices that it can change are counted again."""

    name, needs = "triangles", ()

    def init(self, g: Graph) -> DataFrame:
        return structure.triangles(g)

    def pre(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame | None:
        # A deleted edge is still known here: both its ends' neighbours lose triangles.
        self._lost = cut(self._around(g, batch, "delete"))
        return None

    @staticmethod
    def _around(g: Graph, batch: DataFrame, op: str | None) -> DataFrame:
        e = ends(g, batch, op)
        back = g.with_(edges=g.edges.select("etype", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "time_first", "time_recent"))
        return affected(g, e).union(affected(back, e)).distinct()

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        touched = cut(self._around(g, batch, None).union(self._lost).distinct())
        # A triangle of a touched vertex lies within it and its neighbours.
        near = g.both_ways().join(touched, "id", "left_semi").select("nbr").union(touched).distinct().toDF("id")
        again = structure.triangles(induced(g, near)).join(touched, "id", "left_semi")
        rest = own.join(touched, "id", "left_anti")
        missing = g.ids().join(own, "id", "left_anti").join(touched, "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("triangles"))
        return rest.union(again).union(missing)


class Components:
    """(id, label, component_size): labels join when edges arrive; components that lose an edge are computed again."""

    name, needs = "components", ()

    @staticmethod
    def _sized(labels: DataFrame) -> DataFrame:
        sizes = stats.label_sizes(labels).withColumnRenamed("size", "component_size")
        return labels.join(sizes, "label").select("id", "label", "component_size")

    def init(self, g: Graph) -> DataFrame:
        return self._sized(structure.components(g))

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        old = own.select("id", "label")
        # The names of the batch are looked up once.
        named = cut(ends(g, batch, None, "op").distinct())
        deleted = named.where("op = 'delete'")
        hit = deleted.select(F.col("src").alias("id")).union(deleted.select("dst")).join(old, "id").select("label").distinct()
        open_ = cut(old.join(hit, "label", "left_semi").select("id"))
        redone = structure.components(induced(g, open_)).join(open_, "id", "left_semi")
        known = old.join(open_, "id", "left_anti").unionByName(redone.select("id", "label"))
        known = cut(known.unionByName(g.ids().join(known, "id", "left_anti").select("id", F.col("id").alias("label"))))
        # The batch's insertions link labels, as far as its deletions left them; only this small graph of labels is searched.
        new = named.where("op = 'insert'").select("src", "dst")
        new = new.union(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        new = g.edges.select("src", "dst").join(broadcast_if_small(new), ["src", "dst"], "left_semi")
        by = lambda end: known.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
        between = new.join(by("src"), "src").join(by("dst"), "dst").select(F.col("l_src").alias("src"), F.col("l_dst").alias("dst")).where("src <> dst").distinct()
        joined = structure.components(Graph.of(cut(between))).select(F.col("id").alias("label"), F.col("label").alias("to"))
        return self._sized(cut(known.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label"))))


class PageRank:
    """PageRank that starts from the rank before the batch."""

    name, needs = "pagerank", ()

    def __init__(self, epsilon: float = 1e-8, most: int = 20):
        self.epsilon, self.most = epsilon, most

    def init(self, g: Graph) -> DataFrame:
        return ranking.pagerank(g, epsilon=self.epsilon, most=self.most)

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        return ranking.pagerank(g, epsilon=self.epsilon, most=self.most, start=own if own.limit(1).count() else None)


class DeltaRank:
    """power_rank kept up to date by the change of a batch alone.

    Before the batch b0 = A^T D^-1 x for its vertices, after it b1; the difference times alpha spreads until its L1 norm is
    small, and is added to the rank. ``held`` keeps back entries that are small against the mean.
    """

    needs = ()

    def __init__(self, alpha: float = 0.15, epsilon: float = 1e-9, held: bool = False, most: int = 50):
        self.name = "dpr_held" if held else "dpr"
        self.alpha, self.epsilon, self.held, self.most = alpha, epsilon, held, most

    def init(self, g: Graph) -> DataFrame:
        return ranking.power_rank(g, self.alpha)

    @staticmethod
    def _sources(g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        touched = ends(g, batch).select(F.col("src").alias("id")).union(ends(g, batch).select("dst")).distinct()
        return own.join(touched, "id", "left_semi").select("id", "value")

    def pre(self, g: Graph, batch: DataFrame, own: DataFrame) -> None:
        self._before = cut(ranking.transposed_matvec(g, self._sources(g, batch, own), 1.0, by_degree=True))

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        ids = g.ids()
        n_old = own.count()
        n = ids.count()
        # In the scale of the sum of ranks, new vertices bring their share of v.
        x = cut(ids.join(own, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value")))
        after = ranking.transposed_matvec(g, self._sources(g, batch, x), 1.0, by_degree=True)
        scale = self._v_scale(g, x, n_old)
        fresh = ids.join(own, "id", "left_anti").select("id", F.lit(scale).alias("value"))
        b = after.select("id", (F.col("value") * self.alpha).alias("value")).union(self._before.select("id", F.col("value") * -self.alpha)).union(fresh)
        d = b = cut(b.groupBy("id").agg(F.sum("value").alias("value")).where("value <> 0"))
        for _ in range(self.most):
            below = None
            if self.held:
                s = d.agg(F.sum(F.abs("value")), F.count(F.lit(1))).head()
                below = self.epsilon * (s[0] or 0.0) / max(1, s[1])
            new = cut(ranking.transposed_matvec(g, d, self.alpha, 1.0, b, by_degree=True, below=below))
            change = stats.l1(new, d).head()[0]
            d = new
            if change < self.epsilon / max(1, n):
                break
        return stats.normalised(x.union(d.select("id", "value")).groupBy("id").agg(F.sum("value").alias("value")))

    def _v_scale(self, g: Graph, x: DataFrame, n_old: int) -> float:
        """What v = 1 is in the scale of a rank of norm 1: what the matrix does not return of the norm, for each vertex."""
        have = g.edges.select(F.col("src").alias("id")).distinct()
        row = x.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("all")).crossJoin(x.join(have, "id", "left_semi").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("out"))).head()  # single rows
        return (row["all"] - self.alpha * row["out"]) / n_old if n_old and row["all"] else 1.0


class Communities:
    """Agglomerated communities; after a batch the vertices it names begin anew and the rest goes on from its communities."""

    name, needs = "communities", ()

    def init(self, g: Graph) -> DataFrame:
        return communities.agglomerate(g)

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        e = ends(g, batch)
        touched = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        return communities.agglomerate(g, start=own, singles=touched, drop=DROP)


class Betweenness:
    """Sampled betweenness, blended with that of each batch's own sample."""

    name, needs = "betweenness", ()

    def __init__(self, samples: int = 256, weight: float = 0.5):
        self.samples, self.weight, self.round = samples, weight, 0

    def init(self, g: Graph) -> DataFrame:
        return structure.betweenness(g, self.samples).select("id", "bc")

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        self.round += 1
        new = structure.betweenness(g, self.samples, seed=self.round).select("id", F.col("bc").alias("new"))
        both = new.join(own, "id", "left")
        return both.select("id", ((1 - self.weight) * F.coalesce("bc", F.lit(0.0)) + self.weight * F.col("new")).alias("bc"))


class Recompute:
    """Any function of the graph as an analytic that is computed again after each batch."""

    def __init__(self, name: str, function, needs: tuple[str, ...] = ()):
        self.name, self.needs, self.function = name, needs, function

    def init(self, g: Graph) -> DataFrame:
        return self.function(g)

    def post(self, g: Graph, batch: DataFrame, own: DataFrame) -> DataFrame:
        return self.function(g)
