import random
from collections import Counter

import pytest

from graphrill.llm.frequent import most_frequent


def brute(rows, k, share):
    unique = {}
    for key, s, d in rows:
        unique[key] = max(unique.get(key, (None, None)), (s, d), key=lambda t: [(x is not None, x or "") for x in t])
    out = set()
    for i, field in enumerate(("s", "d")):
        c = Counter(v[i] for v in unique.values() if v[i])
        total = sum(c.values())
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(field, item, n, total) for item, n in top if n >= share * total}
    return out


@pytest.mark.parametrize("seed, k, share", [(1, 5, 0.0), (2, 20, 0.05), (3, 1, 0.0), (4, 1000, 0.0)])
def test_against_brute_force(spark, seed, k, share):
    r = random.Random(seed)
    item = lambda: r.choice([None, "", "hot", "hot", "warm", *[f"x{int(r.paretovariate(0.7)) % 400}" for _ in range(4)]])
    rows = [(i, item(), item()) for i in range(2000)]
    rows += r.sample(rows, 100)
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "key int, s string, d string, n int, node string")
    got = {tuple(x) for x in most_frequent(df, ["key"], ["s", "d"], k, share).collect()}
    assert got == brute(rows, k, share)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate("cbabca ")], "key int, s string, d string")
    assert [(x["item"], x["n"]) for x in most_frequent(df, ["key"], ["s", "d"], 2).orderBy("item").collect()] == [("a", 2), ("b", 2)]
    assert most_frequent(df.limit(0), ["key"], ["s", "d"], 2).count() == 0
    nulls = spark.createDataFrame([(None, "a", ""), (None, "a", "")], "key int, s string, d string")
    assert [tuple(x) for x in most_frequent(nulls, ["key"], ["s", "d"], 3).collect()] == [("s", "a", 1, 1)]
