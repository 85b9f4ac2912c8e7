"""Hand graphs in the notation a>b directed, a-b both ways, a>b:w with a weight."""

import re

from graphrill.model import Graph

PR4 = "0>1 0-2 1>2 3>2"
BC9 = "0>1 1>2 1>3 1>4 2>8 3>5 3>6 4>5 5>6 5>7 7>8"
AA9 = "0-1 0-2 0-3 1-4 2-4 1-5 1-6 1-7 3-8"
AA9_DIRECTED = "0>1 0-2 0>3 1>4 2-4 1>5 6>1 1-7 8>3"
PATH7 = "0>1 0>4 1>3:10 2>1 3>2 4>2 4>5 5>6 6>4"
DAG19 = "0>6 1>2:10 1>3:10 1>4:10 1>5:10 1>6:10 2>7:9 2>8:9 2>9:9 3>10:8 3>11:8 4>12:8 8>18:7 9>16:6 9>17:6 10>15:5 11>14:5 12>13:5"
DIAM7 = PATH7.replace(":10", "")


def edges(text, etype=0):
    rows = {}
    for part in text.split():
        a, way, b, w = re.fullmatch(r"(\d+)([->])(\d+)(?::(\d+))?", part).groups()
        rows[etype, int(a), int(b)] = int(w or 1)
        if way == "-":
            rows[etype, int(b), int(a)] = int(w or 1)
    return [(*k, w) for k, w in rows.items()]


def graph(spark, *parts):
    """A graph of texts (type 0) and lists of edges."""
    rows = [e for p in parts for e in (edges(p) if isinstance(p, str) else p)]
    return Graph.of(spark.createDataFrame(rows, "etype bigint, src bigint, dst bigint, weight bigint"))


def column(df, value, key="id"):
    return {r[key]: r[value] for r in df.collect()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
