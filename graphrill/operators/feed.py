"""The update feed as resolved changes of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphrill.operators.cowstore import KEY, hot_texts
from graphrill.operators.lookups import heaviest
from graphrill.operators.naming import heavy_names, name_key, named, names_of, partly_named, rest_named, with_epoch

ROW = ["batch_id", "seq"]
#: Stands between the parts of a spelled edge.
BETWEEN = "\u0001"


def side(name: str):
    return name_key(F.col(f"{name}_str"), F.col(name))


def frequent(updates: DataFrame, names: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """What is frequent in ``updates``, from sketches of one pass: source and destination names (see heavy_names), and hot edges
    for a store of so many buckets."""
    rows = updates.where(F.col("op").isin("insert", "delete")).select(side("etype").alias("e"), side("src").alias("s"), side("dst").alias("d"))
    spelled = lambda c: F.when(F.col(c).startswith("s"), F.col(c))
    edge = F.when(F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("d").isNotNull(), F.concat_ws(BETWEEN, "e", "s", "d"))
    texts, top = hot_texts(rows, edge, buckets, heaviest(spelled("s")).alias("s"), heaviest(spelled("d")).alias("d"))
    edges = [t.split(BETWEEN) for t in texts if t.count(BETWEEN) == 2]
    hot = []
    if edges:
        found = names.sparkSession.createDataFrame(edges, "e string, s string, d string")
        for c, kind, into in (("e", "etype", "etype"), ("s", "vertex", "src"), ("d", "vertex", "dst")):
            found = named(found, c, names, kind, into)
        hot = [tuple(r) for r in found.select(*KEY).distinct().collect()]  # no more than hot edges
    return names_of(top["s"] or [], names), names_of(top["d"] or [], names), hot


def resolved_changes(updates: DataFrame, batches: DataFrame, names: DataFrame, heavy: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(op, etype, src, dst, weight, at, batch_id, seq) of every insertion and deletion of ``updates``; rows sent again are here
    again.

    Rows of which a side or the type names nothing are left out. Null weights stay null. Types, numbers and frequent names
    become ids where the rows lie, so only rows with another name move, by that name.
    """
    rows = updates.where(F.col("op").isin("insert", "delete"))
    deletes = F.col("op") == "delete"
    keyed = rows.select(*ROW, "op", "weight", F.when(~deletes, F.col("time")).alias("time"), side("src").alias("s"), side("dst").alias("d"), side("etype").alias("e"))
    keyed = keyed.where(F.col("s").isNotNull() & F.col("d").isNotNull() & F.col("e").isNotNull())
    keyed = named(keyed, "e", names, "etype", "etype")
    for_src, for_dst = heavy or (heavy_names(rows, side("src"), names), heavy_names(rows, side("dst"), names))
    keyed = with_epoch(partly_named(partly_named(keyed, "s", for_src, "src"), "d", for_dst, "dst"), batches)
    columns = ["op", *KEY, "weight", "at", *ROW]
    keyed = keyed.select(*columns, "s", "d")
    spread = F.pmod(F.xxhash64(*ROW), F.lit(65_521))
    done = keyed.where(F.col("s").isNull() & F.col("d").isNull())
    by_src = rest_named(keyed.where(F.col("s").isNotNull()), "s", names, "src", spread)
    by_dst = keyed.where(F.col("s").isNull() & F.col("d").isNotNull()).select(*by_src.columns)
    return done.select(*columns).union(rest_named(by_src.union(by_dst), "d", names, "dst", spread).select(*columns))


def edge_changes(updates: DataFrame, batches: DataFrame, names: DataFrame, identity: bool = False) -> DataFrame:
    """resolved_changes with each row once, and without batch_id and seq unless ``identity`` is set."""
    rows = resolved_changes(updates, batches, names).groupBy("op", *KEY, *ROW).agg(F.max("weight").alias("weight"), F.max("at").alias("at"))
    return rows.select("op", *KEY, "weight", "at", *(ROW if identity else []))
