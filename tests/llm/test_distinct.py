import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphrill.llm import distinct
from graphrill.llm.distinct import EMPTY, REGISTERS, SIGMA, UNIT, WIDTH, _fold, _gamma_quantile, _partial, at_least_twice_the_median, estimates, fill, merge, roll_up, sketch


def items(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64)


def filled(groups, group, item, m=256):
    r = np.full((groups, m), EMPTY, np.int64)
    fill(r, np.asarray(group, np.int64), item)
    return r


@pytest.mark.parametrize("n", [1, 2, 30, 5000])
def test_registers_do_not_depend_on_company(n):
    x = items(n)
    whole = filled(1, np.zeros(n), x)
    parts = np.minimum.reduce([filled(1, np.zeros(len(p)), p) for p in np.array_split(x, 3) if len(p)])
    mixed = filled(3, np.arange(n) % 3, x)
    assert (whole == parts).all() and (mixed.min(axis=0) == whole[0]).all() and (whole < EMPTY).all()
    assert (filled(1, np.zeros(2 * n), np.concatenate([x, x])) == whole).all()


def test_registers_are_exponential():
    """Over many sets the mean of a register times n is 1, its variance too, and neighbours do not go together."""
    n, sets = 50, 400
    r = np.vstack([filled(1, np.zeros(n), items(n, s), 64) for s in range(sets)]) / UNIT * n
    assert abs(r.mean() - 1) < 0.02 and abs(r.var() - 1) < 0.06 and abs(np.corrcoef(r[:, 0], r[:, 1])[0, 1]) < 0.15
    estimate = (64 - 1) / (r.sum(axis=1) / n)
    assert abs(estimate.mean() / n - 1) < 0.03 and abs(estimate.std() / n - 1 / np.sqrt(62)) < 0.02


def test_gamma_quantiles():
    draws = np.random.default_rng(1).gamma(REGISTERS, 1, 200_000)
    for z, p in ((-1.96, 0.025), (0, 0.5), (1.96, 0.975)):
        assert abs(_gamma_quantile(REGISTERS, z) / np.quantile(draws, p) - 1) < 0.001


def test_estimates_and_intervals(spark):
    sizes = {("a", 1): 10, ("a", 2): 1000, (None, 1): 30_000, ("", 2): 1}
    parts = [spark.range(n).select(F.lit(g).cast("string").alias("g"), F.lit(k).alias("k"), F.concat_ws("-", F.lit(str(g)), "id").alias("x"), F.lit(0).alias("registers")) for (g, k), n in sizes.items()]
    df = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    twice = df.unionAll(df).repartition(7)
    got = {(r["g"], r["k"]): r for r in estimates(sketch(twice, ["g", "k"], "x")).collect()}
    assert got.keys() == sizes.keys()
    for k, n in sizes.items():
        assert abs(got[k]["estimate"] / n - 1) < 5 * SIGMA and got[k]["low"] < got[k]["estimate"] < got[k]["high"]
        assert got[k]["low"] / n < 1.08 and got[k]["high"] / n > 0.92


def test_partial_results_merge(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    once = sketch(df, ["g"], "id")
    halves = sketch(df.where("id < 2000"), ["g"], "id").unionAll(sketch(df.where("id >= 1000"), ["g"], "id"))
    key = lambda s: {(r["g"], r["part"]): r["values"] for r in s.collect()}
    assert key(merge(halves, ["g"])) == key(once) and len(key(once)) == 3 * REGISTERS / WIDTH
    rolled = {(r["g"], r["level"], r["part"]): r["values"] for r in roll_up(once, ["g"]).collect()}
    for p in range(REGISTERS // WIDTH):
        assert rolled[None, 1, p] == [min(x) for x in zip(*[key(once)[g, p] for g in range(3)])] and rolled[2, 0, p] == key(once)[2, p]


def test_tasks_that_hold_little(spark, monkeypatch):
    """Items, registers and what is given out early merge to the same."""
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("g"), "id").repartition(3)
    key = lambda s: {(r["g"], r["part"]): r["values"] for r in s.collect()}
    once = key(sketch(df, ["g"], "id"))
    schema = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("values", pa.list_(pa.int64()))])
    rows = df.select("g", F.xxhash64("id").alias("_item")).toPandas()
    for sparse, held, pending in ((5, 2, 100), (1 << 20, 1000, 1 << 20), (0, 1000, 500)):
        monkeypatch.setattr(distinct, "SPARSE", sparse)
        monkeypatch.setattr(distinct, "HELD", held)
        monkeypatch.setattr(distinct, "PENDING", pending)
        batches = [pa.RecordBatch.from_pandas(rows[i : i + 300], preserve_index=False) for i in range(0, len(rows), 300)]
        partial = pa.Table.from_batches(_partial(["g"], schema, REGISTERS)(batches)).sort_by("g").combine_chunks().to_batches()
        got = pa.Table.from_batches(_fold(["g"], schema, REGISTERS)(partial)).to_pylist()
        assert {(r["g"], r["part"]): r["values"] for r in got} == once


def test_medians_from_intervals(spark):
    """The sure rows and an exact count of the needed ones give what all exact counts give."""
    r = np.random.default_rng(5)
    rows = [(g, d, int(n)) for g in range(30) for d, n in enumerate(r.choice([r.integers(1, 30, 9), np.full(9, 10), r.integers(9, 21, 9)][g % 3], r.integers(1, 10)))]
    bound = lambda n, e: (n * (1 - r.random() * e), n * (1 + r.random() * e))
    df = spark.createDataFrame([(g, d, n, *bound(n, 0.2)) for g, d, n in rows], "g int, d int, n int, low double, high double")
    sure, needed = at_least_twice_the_median(df.drop("n"), "g")
    counts, by = {(g, d): n for g, d, n in rows}, {}
    for g, d, n in rows:
        by.setdefault(g, []).append(n)
    want = {(g, d) for g, d, n in rows if n >= 2 * np.median(by[g])}
    needed = needed.collect()
    exact, got = {(x["g"], x["d"]) for x in needed}, {(x["g"], x["d"]) for x in sure.collect()}
    assert got <= want and len(exact) < len(rows)
    for x in needed:
        if x["decides"]:
            # A row that is not needed may have any number within its interval.
            guess = [counts[y["g"], y["d"]] if (y["g"], y["d"]) in exact else y["high"] for y in df.where(F.col("g") == x["g"]).collect()]
            if counts[x["g"], x["d"]] >= 2 * np.median(guess):
                got.add((x["g"], x["d"]))
    assert got == want


def test_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "g string, x string")
    assert sketch(none, ["g"], "x").count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", ""), ("b", None)], "g string, x string")
    assert [(r["g"], round(r["estimate"], 1)) for r in estimates(sketch(nulls, ["g"], "x")).collect()] == [("a", pytest.approx(1, rel=0.15))]
