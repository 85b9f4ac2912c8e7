"""Updates from CSV and JSON records by templates whose values are variables such as ``$source_str1``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.functions.scalar import compact, ttr_time
from graphrill.sources.generate import fresh_batch_id

VARIABLE = re.compile(
    r"\$(type_str|type|source_str|source_type|source_weight_incr|source_weight|source|destination_str|destination_type"
    r"|destination_weight_incr|destination_weight|destination|weight|time_ttr|time_unix|time)(\d*)(ordered|exact)?\s*(?:=\s*(.*))?"
)
NUMBERS = {"type", "source", "destination", "weight", "time", "source_weight", "source_weight_incr", "destination_weight", "destination_weight_incr"}
#: Variables of a record in the order in which edges are made, with the columns they fill.
PARTS = {
    "type": ("etype", "etype_str"), "source": ("src", "src_str"), "destination": ("dst", "dst_str"), "weight": ("weight", None), "time": ("time", None),
}
VERTEX = ["source_type", "source_weight", "source_weight_incr", "destination_type", "destination_weight", "destination_weight_incr"]


@dataclass
class Group:
    """The variables of one kind of edge: arrays of texts by variable, and the mode in which they combine."""

    values: dict[str, list[Column]] = field(default_factory=dict)
    mode: str = "default"

    def add(self, name: str, value: Column) -> None:
        self.values.setdefault(name, []).append(value)

    def array(self, *names: str) -> Column | None:
        """All values of the variables, as structs (number, string); numbers that do not parse are left out."""
        parts = []
        for n in names:
            for v in self.values.get(n, []):
                if n == "time_ttr":
                    number = lambda x: ttr_time(x)
                elif n == "time_unix":
                    number = lambda x: compact(x.try_cast("bigint"))
                else:
                    number = lambda x: x.try_cast("bigint")
                is_number = n in NUMBERS or n.startswith("time")
                kept = F.filter(v, lambda x: (number(x) if is_number else x).isNotNull())  # noqa: B023
                parts.append(F.transform(kept, lambda x: F.struct((number(x) if is_number else F.lit(None).cast("bigint")).alias("n"), (F.lit(None).cast("string") if is_number else x).alias("s"))))  # noqa: B023
        return F.concat(*parts) if parts else None


def _variable(text: str) -> tuple[str, int, str, str | None] | None:
    m = VARIABLE.fullmatch(text.strip())
    return (m[1], int(m[2] or 0), m[3] or "default", m[4]) if m else None


def _edges(rows: DataFrame, groups: dict[int, Group]) -> DataFrame:
    """The edges of all groups, one projection each."""
    out = None
    for g in groups.values():
        part = _of_group(rows, g)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the template has no variable")
    return out


def _of_group(rows: DataFrame, g: Group) -> DataFrame:
    arrays = {p: g.array(*([p, f"{p}_str"] if p in ("type", "source", "destination") else ["time", "time_ttr", "time_unix"] if p == "time" else [p])) for p in PARTS}
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("s")))
    ends = {"source", "destination"}
    filled = {p: (a if a is not None else none) if p in ends else (none if a is None else F.when(F.size(a) > 0, a).otherwise(none)) for p, a in arrays.items()}
    extra = [(F.element_at(F.concat(*g.values[v]), 1) if v in g.values else F.lit(None).cast("string")).alias(v) for v in VERTEX]
    rows = rows.select(*[a.alias(p) for p, a in filled.items()], *extra)
    if g.mode == "ordered":
        # By position; short lists of weights and times repeat their last, types beyond theirs are unset.
        at = lambda p, i: F.try_element_at(p, F.least(i + 1, F.size(p)) if p in ("weight", "time") else i + 1)
        count = F.least(F.size("source"), F.size("destination"))
        zipped = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(*[at(p, i).alias(p) for p in PARTS]))
        rows = rows.withColumn("_e", F.explode(F.when(count > 0, zipped)))
        rows = rows.select(*[F.col(f"_e.{p}").alias(p) for p in PARTS], *VERTEX)
    else:
        for p in PARTS:
            rows = rows.withColumn(p, F.explode(p))
    columns = []
    for p, (number, string) in PARTS.items():
        columns.append(F.col(f"{p}.n").alias(number))
        if string:
            columns.append(F.col(f"{p}.s").alias(string))
    return rows.select(*columns, *VERTEX).withColumn("weight", F.coalesce("weight", F.lit(1)))


def csv_updates(rows: DataFrame, template: str, line: str = "value", separator: str = ",") -> DataFrame:
    """Edges of text lines by a template line: columns etype, etype_str, src, src_str, dst, dst_str, weight, time and those of
    VERTEX. No quoting, no trimming of the data; a template's fields are trimmed.

    A field ``$name<group><mode>`` takes the column, ``$name<group>=value`` is a constant. Groups are kinds of edges; in the
    modes default and exact every combination of a record's values is an edge, in mode ordered values combine by position.
    Without a time the column is null. Records that lack an end give no edge. Works on batch and streaming frames.
    """
    fields = F.split(F.col(line), f"\\Q{separator}\\E", -1)
    groups: dict[int, Group] = {}
    for i, text in enumerate(template.strip("\r\n").split(separator)):
        found = _variable(text)
        if found:
            name, group, mode, constant = found
            g = groups.setdefault(group, Group())
            if mode != "default":
                g.mode = mode
            g.add(name, F.array(F.lit(constant) if constant is not None else F.try_element_at(fields, F.lit(i + 1))))
    return _edges(rows, groups)


def _schema(node) -> str:
    if isinstance(node, dict):
        return "struct<" + ",".join(f"`{k}`:{_schema(v)}" for k, v in node.items()) + ">"
    if isinstance(node, list):
        return f"array<{_schema(node[0])}>" if node else "array<string>"
    return "string"


def _leaves(node, path: tuple = ()):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, (*path, k))
    elif isinstance(node, list):
        for v in node[:1]:
            yield from _leaves(v, (*path, None))
    elif isinstance(node, str) and node.startswith("$"):
        yield path, node


def _values(root: Column, path: tuple) -> Column:
    """The texts at a path as an array; None in the path stands for all elements of an array."""
    if not path:
        return F.filter(F.array(root), lambda x: x.isNotNull())
    if path[0] is None:
        rest = F.transform(root, lambda x: _values(x, path[1:]))
        return F.coalesce(F.flatten(F.filter(rest, lambda x: x.isNotNull())), F.array().cast("array<string>"))
    return _values(root.getField(path[0]), path[1:])


def json_updates(rows: DataFrame, templates: list[str], record: str = "value") -> DataFrame:
    """Edges of JSON records by template objects, as csv_updates; $time_ttr and $time_unix become YYYYMMDDHHMMSS.

    A variable in an array stands for all its elements. The record is parsed once for each template, into its fields only.
    """
    out = None
    for template in templates:
        node = json.loads(template)
        parsed = F.from_json(F.col(record), _schema(node))
        groups: dict[int, Group] = {}
        for path, text in _leaves(node):
            if not (found := _variable(text)):
                continue
            name, group, mode, constant = found
            g = groups.setdefault(group, Group())
            if mode != "default":
                g.mode = mode
            g.add(name, F.array(F.lit(constant)) if constant is not None else _values(F.col("_r"), path))
        part = _edges(rows.select(parsed.alias("_r")), groups)
        out = part if out is None else out.unionByName(part)
    return out


def feed_rows(edges: DataFrame, batch_id: int | None = None) -> DataFrame:
    """``edges`` of a template as rows of the update feed: an insertion each, and vertex rows for types and weights.

    All are one batch, by default of a number that nothing else has. Rows of a stream are numbered anew in each micro-batch,
    so it has to be called within foreachBatch.
    """
    if edges.isStreaming:
        raise ValueError("feed_rows numbers the rows of one batch; call it within foreachBatch")
    batch_id = fresh_batch_id() if batch_id is None else batch_id
    blank = lambda t: F.lit(None).cast(t)
    base = edges.withColumn("_seq", F.monotonically_increasing_id() * 3)
    head = [F.lit(batch_id).cast("bigint").alias("batch_id")]
    inserts = base.select(*head, F.col("_seq").alias("seq"), F.lit("insert").alias("op"), "etype", "etype_str", "src", "src_str", "dst", "dst_str", "weight", "time", blank("string").alias("vtype_str"), blank("bigint").alias("set_weight"), blank("bigint").alias("incr_weight"), blank("string").alias("metadata"))
    out = inserts
    for k, (end, short) in enumerate((("source", "src"), ("destination", "dst"))):
        some = base.where(F.coalesce(F.col(f"{end}_type"), F.col(f"{end}_weight"), F.col(f"{end}_weight_incr")).isNotNull())
        out = out.unionByName(some.select(
            *head, (F.col("_seq") + k + 1).alias("seq"), F.lit("vertex").alias("op"), blank("bigint").alias("etype"), blank("string").alias("etype_str"), F.col(short).alias("src"), F.col(f"{short}_str").alias("src_str"), blank("bigint").alias("dst"), blank("string").alias("dst_str"), blank("bigint").alias("weight"), blank("bigint").alias("time"),
            F.col(f"{end}_type").alias("vtype_str"), F.col(f"{end}_weight").try_cast("bigint").alias("set_weight"), F.col(f"{end}_weight_incr").try_cast("bigint").alias("incr_weight"), blank("string").alias("metadata"),
        ))
    return out
