import random

import numpy as np
import pytest

from graphrill.llm import groups
from graphrill.llm.groups import group, union_find


def brute(pairs):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if None in (a, b) or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def found(spark, pairs):
    df = spark.createDataFrame([(*p, 0, "x") for p in pairs], "a bigint, b bigint, v int, rep string")
    out = group(df, "a", "b")
    assert out.count() == out.select("id").distinct().count()
    return {r["id"]: r["group_id"] for r in out.collect()}


def shapes(r):
    path = list(range(0, 300))
    r.shuffle(path)
    yield [(a, b) for a, b in zip(path, path[1:])]
    yield [(1000, i) for i in range(400)] + [(2000, 2001)]
    yield [(r.randrange(300), r.randrange(300)) for _ in range(250)]
    yield [(i, i + 1) for i in range(0, 400, 2)] + [(i, i) for i in range(20)] + [(None, 5), (7, None), (8, 9), (9, 8)]
    yield [(-5, 3), (3, 2**62), (2**62, -(2**62))]


@pytest.mark.parametrize("cell", [20, 200_000])
@pytest.mark.parametrize("shape", range(5))
def test_against_brute_force(spark, monkeypatch, cell, shape):
    monkeypatch.setattr(groups, "CELL", cell)
    pairs = list(shapes(random.Random(shape)))[shape]
    assert found(spark, pairs) == brute(pairs)


def test_no_pairs(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1), (None, None)]) == {}


def test_union_find():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 500, 400), r.integers(0, 500, 400)
    ids, least = union_find(a, b)
    want = brute(zip(a.tolist(), b.tolist()))
    assert {i: x for i, x in zip(ids.tolist(), least.tolist()) if i in want} == want
