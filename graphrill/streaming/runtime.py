"""The update feed as a stream: each micro-batch is applied to the graph, analytics run around it, and views are published."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.model import EDGE, EDGES, NAMES, VERTICES, Graph
from graphrill.operators.mutate import apply_batch
from graphrill.session import releasing
from graphrill.sources.sinks import write_history


class Analytic(Protocol):
    """A per-vertex result that follows the graph. Results of ``needs`` are in ``graph.results`` by name.

    Any of the hooks may be missing; each returns the new result, or None to leave it.
    """

    name: str
    needs: tuple[str, ...]

    def init(self, graph: Graph) -> DataFrame | None: ...

    def pre(self, graph: Graph, batch: DataFrame, own: DataFrame | None) -> DataFrame | None: ...

    def post(self, graph: Graph, batch: DataFrame, own: DataFrame | None) -> DataFrame | None: ...


def levels(analytics: list[Analytic]) -> list[list[Analytic]]:
    """The analytics by level: one more than the highest level of what each needs. Unknown or circular needs are an error."""
    by, level = {a.name: a for a in analytics}, {}

    def of(name: str, path: tuple[str, ...]) -> int:
        if name in path:
            raise ValueError(f"{name} needs itself")
        if name not in by:
            raise ValueError(f"{name} is not registered")
        if name not in level:
            level[name] = 1 + max((of(n, (*path, name)) for n in getattr(by[name], "needs", ())), default=-1)
        return level[name]

    out: list[list[Analytic]] = []
    for a in analytics:
        of(a.name, ())
    for n in range(1 + max(level.values(), default=-1)):
        out.append([a for a in analytics if level[a.name] == n])
    return out


class StateStore:
    """Versions of a graph under ``path``: v<number> folders and the file CURRENT, which a rename replaces."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def current(self) -> dict | None:
        """{version, last_batch, results}, or None before the first commit."""
        found = sorted(int(n[1:-5]) for s in self._list() if (n := s.getPath().getName()).startswith("c") and n.endswith(".json"))
        if not found:
            return None
        stream = self._fs.open(self._p(f"{self.path}/c{found[-1]}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _list(self):
        p = self._p(self.path)
        return self._fs.listStatus(p) if self._fs.exists(p) else []

    def load(self) -> Graph | None:
        """The last committed graph with its results."""
        c = self.current()
        if c is None:
            return None
        root = f"{self.path}/v{c['version']}"
        return self._read(root).with_(results={n: self.spark.read.parquet(f"{root}/results/{n}") for n in c["results"]})

    def _read(self, root: str) -> Graph:
        at = lambda schema, part: self.spark.read.schema(schema).parquet(f"{root}/{part}")
        return Graph(at(EDGES, "edges").select(*EDGE), at(VERTICES, "vertices"), at(NAMES, "names"))

    def write(self, g: Graph, version: int) -> Graph:
        """Writes the parts of a version, which no reader sees before commit; a crash leaves them to be written again."""
        root = f"{self.path}/v{version}"
        with releasing(self.spark):
            g.edges.write.mode("overwrite").partitionBy("etype").parquet(f"{root}/edges")
            g.vertices.write.mode("overwrite").parquet(f"{root}/vertices")
            g.names.write.mode("overwrite").parquet(f"{root}/names")
        new = self._read(root)
        return g.with_(edges=new.edges, vertices=new.vertices, names=new.names)

    def write_result(self, version: int, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/v{version}/results/{name}"
        with releasing(rows.sparkSession):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, version: int, last_batch: int, results: list[str]) -> None:
        temporary, final = self._p(f"{self.path}/_c{version}"), self._p(f"{self.path}/c{version}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version, "last_batch": last_batch, "results": results}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {version} was committed by another writer, or its commit failed")
        old = version - self.keep
        for name in (f"c{old}.json", f"v{old}"):
            self.remove(f"{self.path}/{name}")

    def remove(self, path: str) -> None:
        if self._fs.exists(self._p(path)):
            self._fs.delete(self._p(path), True)


@dataclass
class Engine:
    """Applies batches in order: hooks before by level, the batch, hooks after by level, commit, sessions, history.

    A batch whose id is not above the last committed one changes nothing, so a replay after a crash is harmless.
    """

    spark: SparkSession
    path: str
    analytics: list[Analytic] = field(default_factory=list)
    directed: bool = True
    history: str | None = None
    keep_history: int | None = None
    start: Graph | None = None

    def __post_init__(self):
        self.store = StateStore(self.spark, self.path)
        self.sessions: dict[int, object] = {}
        self.counts = {"batches": 0, "inserted": 0, "deleted": 0, "max_time": 0}
        self.graph = self.store.load()
        self.order = levels(self.analytics)
        if self.graph is None:
            g = self.store.write(self.start or Graph.empty(self.spark), 0)
            self.graph = self._run(g, 0, lambda a, g: a.init(g) if hasattr(a, "init") else None)
            self.store.commit(0, -1, list(self.graph.results))
        else:
            fresh = [a for a in self.analytics if a.name not in self.graph.results and hasattr(a, "init")]
            self.graph = self.graph.with_(results=self.graph.results | {a.name: r for a in fresh if (r := a.init(self.graph)) is not None})
        self.publish()

    def _run(self, g: Graph, version: int, hook: Callable) -> Graph:
        for level in self.order:
            new = {a.name: self.store.write_result(version, a.name, r) for a in level if (r := hook(a, g)) is not None}
            g = g.with_(results=g.results | new)
        return g

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch (the schema of the feed); the function for foreachBatch."""
        current = self.store.current()
        if batch_id <= current["last_batch"]:
            return
        with releasing(self.spark):
            self._apply(batch, batch_id, current["version"] + 1, self.graph)
        self.publish()

    def _apply(self, batch: DataFrame, batch_id: int, version: int, before: Graph) -> None:
        held = f"{self.path}/_held{version}"
        try:
            # Columns on disk, of which each hook reads what it needs; what a batch holds goes when it is applied.
            batch = self._hold(batch, f"{held}/batch")
            own = dict(before.results)
            for level in self.order:
                for a in level:
                    if hasattr(a, "pre") and (r := a.pre(before.with_(results=own), batch, own.get(a.name))) is not None:
                        own[a.name] = r
            g = self.store.write(apply_batch(before, batch, self.directed, lambda df, name: self._hold(df, f"{held}/rows/{name}")), version).with_(results=own)
            self.store.remove(f"{held}/rows")
            g = self._run(g, version, lambda a, g: a.post(g, batch, g.results.get(a.name)) if hasattr(a, "post") else None)
            kept = {n: r if f"/v{version}/" in str(r.inputFiles()[:1]) else self.store.write_result(version, n, r) for n, r in g.results.items()}
            g = g.with_(results=kept)
            n = batch.groupBy().agg(F.count_if(F.col("op") == "insert").alias("i"), F.count_if(F.col("op") == "delete").alias("d"), F.max(F.when(F.col("op") == "insert", F.col("time"))).alias("t")).head()
            for s in self.sessions.values():
                s.update(before, g, batch)
            self.store.commit(version, batch_id, list(kept))
            self.graph = g
            self.counts["batches"] += 1
            self.counts["inserted"] += n["i"]
            self.counts["deleted"] += n["d"]
            self.counts["max_time"] = max(self.counts["max_time"], n["t"] or 0)
            if self.history:
                write_history(g.results, batch_id, self.history, self.keep_history)
        finally:
            self.store.remove(held)

    def _hold(self, df: DataFrame, path: str) -> DataFrame:
        with releasing(df.sparkSession):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self) -> None:
        """Swaps the views vertices, edges and alg_<name> to the last version."""
        from graphrill.functions.sql import register

        register(self.graph)

    def stream(self, feed: DataFrame, checkpoint: str):
        """Starts a query over a streaming frame of the feed; the caller stops it or waits."""
        return feed.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the feed's files; the number of files bounds a batch, and nothing is dropped."""
    from graphrill.sources.generate import FEED

    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windows(feed: DataFrame, time: str = "sent_at", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, op, n): changes by event-time window with a watermark; on a batch frame the watermark does nothing."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return feed.withWatermark(time, late).groupBy(w.alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "op", "n")
