"""Named requests with checked parameters over a graph and its results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.functions.sql import built_in
from graphrill.model import Graph
from graphrill.operators import columns, communities, extract, paths, ranking, stats, structure
from graphrill.operators.traverse import with_names

#: Error codes of the interface; fixed values.
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
NO_RESULT, NO_COLUMN, NO_SESSION, UNAVAILABLE = -32003, -32002, -32001, -32000
REQUIRED = object()


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Param:
    """A parameter: kind is vertex, etype, vtype, int, text, float, bool or array (of vertices)."""

    name: str
    kind: str
    default: object = REQUIRED


def _id(g: Graph, kind: str, value) -> int:
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(value, str):
        row = g.names.where((F.col("kind") == kind) & (F.col("name") == value)).select("id").head()
        if row is not None:
            return row[0]
    raise RpcError(BAD_PARAMS, f"{value!r} is no {kind}")


def bind(g: Graph, params: list[Param], given: dict) -> dict:
    """The parameters by name, names of vertices and types resolved; what an array holds that names nothing is left out."""
    out = {}
    for p in params:
        if p.name not in given:
            if p.default is REQUIRED:
                raise RpcError(BAD_PARAMS, f"{p.name} is missing")
            out[p.name] = p.default
            continue
        v = given[p.name]
        if p.kind in ("vertex", "etype", "vtype"):
            v = _id(g, p.kind, v)
        elif p.kind == "array":
            if not isinstance(v, list):
                raise RpcError(BAD_PARAMS, f"{p.name} is no array")
            found = []
            for x in v:
                try:
                    found.append(_id(g, "vertex", x))
                except RpcError:
                    continue
            v = found
        elif p.kind == "bool":
            v = bool(v)
        elif not isinstance(v, {"int": int, "text": str, "float": (int, float), "values": list}[p.kind]) or isinstance(v, bool):
            raise RpcError(BAD_PARAMS, f"{p.name} is no {p.kind}")
        out[p.name] = v
    return out


class Rpc:
    """Methods over the graph that ``current`` gives, so a stream's engine can be asked while it runs."""

    def __init__(self, current: Callable[[], Graph], sessions=None, health: Callable[[], dict] | None = None):
        self.current, self.sessions, self.health, self.started = current, sessions, health, time.monotonic()
        s, v = Param("strings", "bool", False), Param("source", "vertex")
        named = [Param("name", "text"), Param("data", "text")]
        picks = [s, Param("stride", "int", 1), Param("samples", "int", 0), Param("log", "bool", False), Param("vtypes", "values", None)]
        page = [Param("offset", "int"), Param("count", "int")]
        limit = Param("limit", "int", 1 << 30)
        self.methods: dict[str, tuple[Callable, list[Param]]] = {
            "adamic_adar": (lambda g, source, strings, etype: self._named(g, structure.adamic_adar(g, source, None if etype < 0 else etype), strings), [v, s, Param("etype", "etype", -1)]),
            "bfs_edges": (lambda g, source, strings, etype: self._named(g, paths.bfs_edges(g, source, etype), strings), [v, s, Param("etype", "etype", 0)]),
            "breadth_first_search": (lambda g, source, target, strings: self._ends(g, paths.path_edges(g, source, target), strings), [v, Param("target", "vertex"), s]),
            "community_on_demand": (lambda g, strings: self._named(g, communities.adopt_labels(g, 5), strings), [s]),
            "egonet": (lambda g, source, strings, incident_edges: self._ends(g, extract.egonet(g, [source], incident_edges), strings), [v, s, Param("incident_edges", "bool", False)]),
            "exact_diameter": (lambda g: paths.exact_diameter(g), []),
            "get_connected_component": (lambda g, source, strings: self._named(g, extract.members(self._result(g, "components"), source), strings), [v, s]),
            "get_data_array": (self._array, [*named, *picks]),
            "get_data_array_range": (self._range, [*named, *page, *picks]),
            "get_data_array_sorted_range": (self._sorted, [*named, *page, Param("order", "text", "DESC"), *picks]),
            "get_data_array_set": (lambda g, name, data, set, strings, vtypes: columns.data_set(self._column(g, name, data), data, set, g, strings, vtypes), [*named, Param("set", "values"), s, Param("vtypes", "values", None)]),
            "get_data_array_reduction": (self._reduction, [Param("name", "text"), Param("op", "text")]),
            "get_algorithms": (lambda g: g.spark.createDataFrame([(n,) for n in ("graph", *g.results)], "name string"), []),
            "get_data_description": (lambda g, name: g.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self._result(g, name).schema if f.name != "id"], "name string, type string"), [Param("name", "text")]),
            "get_graph_stats": (lambda g: stats.graph_stats(g), []),
            "get_server_health": (self._health, []),
            "get_server_info": (lambda g: g.spark.createDataFrame([(g.spark.version, g.spark.sparkContext.master)], "spark string, master string"), []),
            "pagerank_subgraph": (lambda g, vertices, strings: self._named(g, ranking.subset_pagerank(g, g.spark.createDataFrame([(x,) for x in vertices], "id bigint")), strings), [Param("vertices", "array"), s]),
            "single_source_shortest_path": (lambda g, source, ignore_weights, strings, etype: self._named(g, paths.shortest_paths(g, source, None if etype < 0 else etype, ignore_weights), strings), [v, Param("ignore_weights", "bool"), s, Param("etype", "etype", -1)]),
            "label_breadth_first_search": (lambda g, source, name, data, limit, strings: self._named(g, extract.label_search(g, source, self._column(g, name, data), limit, data), strings), [Param("source", "array"), *named, limit, s]),
            "label_mod_expand": (lambda g, source, name, data, limit, strings: self._named(g, extract.modular_expansion(extract.induced(g, extract.members(self._column(g, name, data), source[0], data)), source, limit), strings), [Param("source", "array"), *named, limit, s]),
        }

    @staticmethod
    def _named(g: Graph, rows: DataFrame, strings: bool) -> DataFrame:
        return with_names(rows, g.names, "id", into="name") if strings else rows

    @staticmethod
    def _ends(g: Graph, rows: DataFrame, strings: bool) -> DataFrame:
        return with_names(with_names(rows, g.names, "src"), g.names, "dst") if strings else rows

    @staticmethod
    def _result(g: Graph, name: str) -> DataFrame:
        if name == "graph":
            return built_in(g)
        if name not in g.results:
            raise RpcError(NO_RESULT, f"there is no result {name}")
        return g.results[name]

    def _column(self, g: Graph, name: str, data: str) -> DataFrame:
        rows = self._result(g, name)
        if data not in rows.columns:
            raise RpcError(NO_COLUMN, f"{name} has no column {data}")
        return rows

    def _array(self, g, name, data, strings, stride, samples, log, vtypes):
        return columns.data_array(self._column(g, name, data), data, g, stride, samples, log, strings, vtypes)

    def _range(self, g, name, data, offset, count, strings, stride, samples, log, vtypes):
        rows = self._column(g, name, data)
        if offset > (rows.agg(F.max("id")).head()[0] or 0):
            raise RpcError(BAD_PARAMS, "the offset is beyond the last vertex")
        return columns.data_range(rows, data, offset, count, g, strings, vtypes, stride, samples, log)

    def _sorted(self, g, name, data, offset, count, order, strings, stride, samples, log, vtypes):
        return columns.sorted_range(self._column(g, name, data), data, offset, count, order, g, strings, vtypes, stride, samples, log)

    def _reduction(self, g, name, op):
        rows = self._result(g, name)
        numbers = [f.name for f in rows.schema if f.name != "id" and f.dataType.simpleString() in ("bigint", "int", "double", "float", "smallint")]
        return stats.reduce_positive(rows, numbers, op if op in ("sum", "sum_positive") else "sum_positive")

    def _health(self, g):
        row = stats.totals(g).head().asDict() | {"uptime": time.monotonic() - self.started} | (self.health() if self.health else {})
        return g.spark.createDataFrame([(k, float(v or 0)) for k, v in row.items()], "name string, value double")

    def call(self, method: str, params: dict | None = None):
        """The rows of a method; register and request concern sessions."""
        params = dict(params or {})
        if method in ("register", "request"):
            if self.sessions is None:
                raise RpcError(UNAVAILABLE, "there are no sessions")
            try:
                return self.sessions.register(params.pop("type"), **params) if method == "register" else self.sessions.request(params["session_id"])
            except KeyError as e:
                raise RpcError(NO_SESSION if method == "request" else BAD_PARAMS, str(e)) from e
        if method not in self.methods:
            raise RpcError(NO_METHOD, f"there is no method {method}")
        g = self.current()
        function, declared = self.methods[method]
        return function(g, **bind(g, declared, params))

    def respond(self, message) -> dict:
        """A JSON-RPC 2.0 answer with rows as lists and ``millis``; for results that are small enough to show."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "no valid request"}}
        began = time.monotonic()
        try:
            rows = self.call(message["method"], message.get("params"))
            show = lambda x: {c: [r[c] for r in x.toLocalIterator()] for c in x.columns} if isinstance(x, DataFrame) else x
            if isinstance(rows, DataFrame):
                found = rows.persist()
                result = {c: [] for c in rows.columns}
                for r in found.toLocalIterator():
                    for c in rows.columns:
                        result[c].append(r[c])
                found.unpersist()
            else:
                result = {k: show(v) for k, v in rows.items()} if isinstance(rows, dict) else {"session_id": rows}
            return {"jsonrpc": "2.0", "id": message.get("id"), "result": result | {"millis": (time.monotonic() - began) * 1000}}
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": message.get("id"), "error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # noqa: BLE001
            return {"jsonrpc": "2.0", "id": message.get("id"), "error": {"code": INTERNAL, "message": str(e)[:500]}}
