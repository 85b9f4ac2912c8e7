"""Sessions: what changed since the last request."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.functions.scalar import coordinates, located
from graphrill.model import Graph
from graphrill.operators.extract import members, subgraph_changes
from graphrill.operators.traverse import label_edges
from graphrill.session import stored
from graphrill.streaming.analytics import ends

#: Seconds after which a session that nobody asks is dropped, and how many may live; fixed values of the interface.
IDLE, MOST = 30.0, 20


class Subgraph:
    """The edges inside the community of a vertex: all at first, then insertions and deletions since the last request."""

    def __init__(self, g: Graph, name: str, data: str, source: int):
        self.name, self.data, self.source = name, data, source
        self.now = self._edges(g)
        self.shown: DataFrame | None = None

    def _edges(self, g: Graph) -> DataFrame:
        labels = g.results[self.name].select("id", F.col(self.data).alias("label"))
        own = members(labels, self.source)
        e = label_edges(g, labels).join(own.withColumnRenamed("id", "src"), "src", "left_semi")
        return stored(e.select(*g.edges.columns), "session")

    def update(self, before: Graph, after: Graph, batch: DataFrame) -> None:
        self.now = self._edges(after)

    def request(self) -> dict[str, DataFrame]:
        shown, self.shown = self.shown, self.now
        if shown is None:
            return {"subgraph": self.now}
        inserted, deleted = subgraph_changes(shown, self.now)
        return {"insertions": inserted, "deletions": deleted}


class VertexEvents:
    """Insertions and deletions of batches that touch watched vertices, since the last request."""

    def __init__(self, g: Graph, vertices: list[int]):
        self.vertices, self.parts = vertices, []

    def update(self, before: Graph, after: Graph, batch: DataFrame) -> None:
        for op in ("insert", "delete"):
            e = ends(after, batch, op).where(F.col("src").isin(self.vertices) | F.col("dst").isin(self.vertices))
            self.parts.append(stored(e.select(F.lit(op).alias("op"), "src", "dst"), "session"))

    def request(self) -> dict[str, DataFrame]:
        parts, self.parts = self.parts, []
        out = None
        for p in parts:
            out = p if out is None else out.union(p)
        return {} if out is None else {"insertions": out.where("op = 'insert'").drop("op"), "deletions": out.where("op = 'delete'").drop("op")}


class LatLon:
    """Distinct places in the metadata of batches since the last request; 'get_latlon_gnip' has sentiment and more."""

    def __init__(self, kind: str = "get_latlon"):
        self.kind, self.parts = kind, []

    def places(self, batch: DataFrame) -> DataFrame:
        place = located(F.col("metadata")) if self.kind == "get_latlon_gnip" else coordinates(F.col("metadata"))
        return batch.where("metadata IS NOT NULL").select(place.alias("p")).where("p IS NOT NULL").select("p.*").distinct()

    def update(self, before: Graph, after: Graph, batch: DataFrame) -> None:
        self.parts.append(stored(self.places(batch), "session"))

    def request(self) -> dict[str, DataFrame]:
        parts, self.parts = self.parts, []
        out = None
        for p in parts:
            out = p if out is None else out.union(p)
        return {} if out is None else {"coordinates": out.distinct()}


class Sessions:
    """Open sessions by number; idle ones are dropped when the next is opened or asked for."""

    def __init__(self, engine, clock=time.monotonic):
        self.engine, self.clock, self.last, self.next = engine, clock, {}, 0

    def _drop_idle(self) -> None:
        for i, at in list(self.last.items()):
            if self.clock() - at > IDLE:
                self.close(i)

    def register(self, kind: str, **params) -> int:
        self._drop_idle()
        if len(self.last) >= MOST:
            raise RuntimeError("too many sessions")
        g = self.engine.graph
        if kind == "subgraph":
            s = Subgraph(g, params["name"], params["data"], params["source"])
        elif kind == "vertex_event_notifier":
            s = VertexEvents(g, params["set"])
        elif kind in ("get_latlon", "get_latlon_gnip", "get_latlon_twitter"):
            s = LatLon(kind)
        else:
            raise KeyError(kind)
        self.next += 1
        self.engine.sessions[self.next], self.last[self.next] = s, self.clock()
        return self.next

    def request(self, session_id: int) -> dict[str, DataFrame]:
        self._drop_idle()
        s = self.engine.sessions[session_id]
        self.last[session_id] = self.clock()
        return s.request()

    def close(self, session_id: int) -> None:
        self.engine.sessions.pop(session_id, None)
        self.last.pop(session_id, None)
