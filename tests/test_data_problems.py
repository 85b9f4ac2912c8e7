import random
from collections import Counter, defaultdict

import pytest
from hand import column, rows
from pyspark.sql import functions as F

from graphrill.operators import keyed, lookups, naming
from graphrill.operators.feed import edge_changes
from graphrill.operators.rejects import split_lines
from graphrill.plans import data_queries
from graphrill.session import broadcast_if_few, broadcast_if_small, estimated_bytes, shared_dir
from graphrill.sources.generate import FEED

NAMES = "kind string, id bigint, name string"


def names(spark, *extra):
    return spark.createDataFrame([("vertex", 1, "a"), ("vertex", 2, "b"), ("etype", 0, "none"), ("etype", 6, "same_as"), *extra], NAMES)


def feed_row(batch, seq, op="insert", etype=None, etype_str="same_as", src=None, src_str=None, dst=None, dst_str=None, weight=1, time=100, metadata=None):
    return (batch, seq, op, etype, etype_str, src, src_str, dst, dst_str, weight, time, None, None, None, metadata)


def batches(spark):
    return spark.sql("SELECT * FROM VALUES (1L, timestamp_seconds(500)), (2L, timestamp_seconds(900)) AS t(batch_id, sent_at)")


def test_name_key_and_naming(spark):
    cases = [("a", 9), ("", 9), (None, 0), (None, None), ("", None), (" a", 1), ("A", 1), ("n5", 3)]
    df = spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(cases)], "s string, n bigint, i int")
    keyed_ = df.withColumn("k", naming.name_key(F.col("s"), F.col("n")))
    assert [r["k"] for r in keyed_.orderBy("i").collect()] == ["sa", "n9", "n0", None, None, "s a", "sA", "sn5"]
    want = {0: 1, 1: 9, 2: 0}
    assert column(naming.named(keyed_, "k", names(spark), "vertex", "id"), "id", "i") == want
    heavy = naming.heavy_names(keyed_, F.col("k"), names(spark))
    assert column(naming.named_rows(keyed_, "k", names(spark), heavy, "id", F.col("i")), "id", "i") == want


def test_times(spark):
    given = [(7, 7), (1, 500), (None, 500), (20220103000005, 1641168005), (20221303000005, 500), (0, 0), (-5, -5)]
    df = spark.createDataFrame([(1, t) for t, _ in given], "batch_id bigint, time bigint")
    got = {r["time"]: r["at"] for r in naming.with_epoch(df, batches(spark)).collect()}
    assert got == dict(given)
    assert naming.with_epoch(spark.createDataFrame([(77, None)], "batch_id bigint, time bigint"), batches(spark)).head()["at"] is None


def test_once(spark):
    df = spark.createDataFrame([(1, 1, "x", 5), (1, 1, "x", 5), (1, 1, None, 9), (None, None, "y", 1), (None, None, "y", 1)], "batch_id bigint, seq bigint, v string, w int")
    assert rows(naming.once(df, ["batch_id", "seq"], ["v", "w"])) == rows(spark.createDataFrame([(1, 1, "x", 5), (None, None, "y", 1)], df.schema))
    assert naming.once(df, ["batch_id", "seq"], []).count() == 2
    assert naming.once(df.limit(0), ["batch_id", "seq"], ["v"]).count() == 0


def test_lookup_of_hot_and_missing_keys(spark):
    keys = ["hot"] * 500 + [f"k{i}" for i in range(300)] + [None] * 50 + ["0"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int").withColumn("_found", F.lit("clash?")).drop("_found")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 2)] + [(None, 7)], "k string, v bigint")
    heavy = lookups.heavy(df, F.col("key"), table, "k", "v")
    assert heavy.count() <= lookups.HEAVY
    got = lookups.lookup(df, "key", table, "k", "v", "out", heavy)
    assert got.columns == ["key", "i", "out"] and got.count() == len(keys)
    want = {"hot": 1} | {f"k{i}": i for i in range(0, 300, 2)}
    assert all(r["out"] == want.get(r["key"]) for r in got.collect())
    # The spread has to reach the shuffle, else all rows without a lookup meet in one task.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_spread" in [line for line in plan.splitlines() if "hashpartitioning(coalesce(_key" in line][0].split("hashpartitioning")[1]


def brute_profile(pairs, at):
    by = defaultdict(list)
    for k, v in pairs:
        by[k].append(v)
    out = {}
    for k, values in by.items():
        real = sorted(v for v in values if v is not None)
        c = Counter(real)
        mode = min((v for v in c if c[v] == max(c.values())), default=None)
        out[k] = (len(values), len(c), mode, *[real[max(1, -(-len(real) * p // 100)) - 1] if real else None for p in at])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_profile_of_skewed_keys(spark, seed):
    r = random.Random(seed)
    pairs = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None, ""]), r.choice([None, *range(40)])) for _ in range(2000)] + [("only null", None)] * 3
    df = spark.createDataFrame(pairs, "k string, v int").withColumns({"weight": F.lit(1), "part": F.lit(2), "value": F.lit("x")})
    got = {x["key"]: tuple(x)[1:] for x in keyed.profile(df, "k", "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == brute_profile(pairs, [50, 90])


def test_profile_of_nothing(spark):
    assert keyed.profile(spark.createDataFrame([], "k string, v int"), "k", "v", {"p": 0.5}).count() == 0


LINES = {
    "1,2": None, '"1","2"': None, " 1\t,\t2 ": None, '"1" , 2\r': None, "007,9223372036854775807": None, "0009223372036854775807,1": None,
    "9223372036854775808,1": "invalid_value", "00,0": None, "": "column_count", "1": "column_count", "1,2,3": "column_count", "1,2,": "column_count",
    ",": "invalid_value", "1,": "invalid_value", "a,1": "invalid_value", '"1 ",2': "invalid_value", '"1,2"': "column_count", '"1,2",3': "invalid_value",
    '"1': "broken_quoting", '"1"2,3': "broken_quoting", '1"2",3': "broken_quoting", '"a""b",1': "invalid_value", '"a"",1': "broken_quoting", '1,"': "broken_quoting",
    '"1" x,2': "broken_quoting", "1;2": "column_count", "1,2\r\r": "invalid_value", "\r": "column_count", "1,٢": "invalid_value", "+1,2": "invalid_value",
    "-1,2": "invalid_value", "1.0,2": "invalid_value", "1,2\n": "invalid_value", "1 ,2": "invalid_value", '""': "column_count", '"",1': "invalid_value", '"x,1,2,3': "broken_quoting",
    '"' + "9" * 50_000 + '",1': "invalid_value", "1" * 60_000: "column_count", '"' * 20_001 + ",1": "broken_quoting", ("1," * 30_000): "column_count", None: "column_count",
    '1,2"': "broken_quoting", '1,2,"3': "broken_quoting", ' "1" ,\t"2"\t\r': None, "1, ": "invalid_value", " ": "column_count",
}


def test_lines(spark):
    given = list(LINES.items())
    df = spark.createDataFrame([(i, t, "f") for i, (t, _) in enumerate(given)], "record_id bigint, raw_line string, reason string")
    valid, faulty = split_lines(df)
    assert column(faulty, "reason", "record_id") == {i: w for i, (_, w) in enumerate(given) if w}
    pairs = {r["record_id"]: (r["c0"], r["c1"]) for r in valid.collect()}
    assert pairs.keys() == {i for i, (_, w) in enumerate(given) if w is None}
    assert pairs[0] == (1, 2) and pairs[4] == (7, 2**63 - 1)
    none = split_lines(df.limit(0))
    assert none[0].count() == none[1].count() == 0


def scan(line):
    """A plain reading of the rules, character by character."""
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    fields, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j] in " \t":
            j += 1
        if j < n and line[j] == '"':
            j, value = j + 1, ""
            while True:
                if j >= n:
                    return "broken_quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + line[j], j + 1
            j += 1
            while j < n and line[j] in " \t":
                j += 1
            if j < n and line[j] != ",":
                return "broken_quoting"
        else:
            k = j
            while j < n and line[j] != ",":
                j += 1
            value = line[k:j].strip(" \t")
            if '"' in value:
                return "broken_quoting"
        fields.append(value)
        if j >= n:
            break
        i = j + 1
    if len(fields) != 2:
        return "column_count"
    ok = all(f and all(c in "0123456789" for c in f) and int(f) <= 2**63 - 1 for f in fields)
    return None if ok else "invalid_value"


def test_random_lines(spark):
    r = random.Random(5)
    lines = ["".join(r.choice(['"', '"', ",", ",", " ", "\t", "1", "2", "a", "\r"]) for _ in range(r.randrange(9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "record_id bigint, raw_line string")
    got = column(split_lines(df)[1], "reason", "record_id")
    want = {i: w for i, x in enumerate(lines) if (w := scan(x))}
    assert {i: (lines[i], got.get(i), want.get(i)) for i in got.keys() | want.keys() if got.get(i) != want.get(i)} == {}


def test_edge_changes(spark):
    feed = [
        feed_row(1, 1, src=1, dst=2), feed_row(1, 1, src=1, dst=2, metadata="again"),
        feed_row(1, 2, src=9, src_str="a", dst=0, dst_str="b", time=None),
        feed_row(1, 3, src_str="nobody", dst=2), feed_row(1, 4, src=None, dst=2), feed_row(1, 5, src=0, dst=2, etype=6, etype_str=""),
        feed_row(2, 1, "delete", src=1, dst_str="b", time=None, weight=None), feed_row(2, 2, "vertex", src=1), feed_row(2, 3, src=1, dst=2, etype=None, etype_str=None),
    ]
    got = edge_changes(spark.createDataFrame(feed, FEED), batches(spark), names(spark))
    assert rows(got) == sorted([("insert", 6, 1, 2, 1, 100), ("insert", 6, 1, 2, 1, 500), ("insert", 6, 0, 2, 1, 100), ("delete", 6, 1, 2, None, 900)], key=str)
    assert edge_changes(spark.createDataFrame([], FEED), batches(spark), names(spark)).count() == 0


def tables(spark, folder, feed, extra_names=()):
    spark.createDataFrame(feed, FEED).write.parquet(f"{folder}/updates.parquet")
    batches(spark).write.parquet(f"{folder}/batches.parquet")
    names(spark, *extra_names).write.parquet(f"{folder}/name_map.parquet")
    spark.createDataFrame([(6, 1, 2, 4, 10, 20), (6, 2, 1, 4, 10, 2000)], "etype bigint, src bigint, dst bigint, weight bigint, time_first bigint, time_recent bigint").write.parquet(f"{folder}/edges.parquet")


def test_p1_and_p6_on_a_fixture(spark, tmp_path):
    feed = [feed_row(1, i, src=5 if i < 60 else 1000 + i, dst=2) for i in range(200)] + [feed_row(2, 0, "delete", src=1, dst=2, time=None), feed_row(2, 1, "delete", src=2, dst=1, time=None), feed_row(2, 2, src=1, dst=2, time=900), feed_row(2, 2, src=1, dst=2, time=900)]
    tables(spark, tmp_path, feed)
    assert [r["src"] for r in data_queries.p1_found(spark, str(tmp_path)).collect()] == [5]
    assert column(data_queries.p1_counts(spark, str(tmp_path)), "n")[5] == 60
    # The insertion at the time of the deletion comes before it; the edge with a later time stands.
    assert rows(data_queries.p6_found(spark, str(tmp_path))) == [(6, 2, 1)]


def test_broadcast_is_checked(spark):
    small = spark.range(10)
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, limit=1))
    assert hinted(broadcast_if_few(small)) and not hinted(broadcast_if_few(small, most=3))
    assert estimated_bytes(small) > 0 and shared_dir(spark)


def test_times_of_batches_beyond_a_broadcast(spark, monkeypatch):
    given = [(1, 7), (1, 1), (2, None), (77, None), (None, None), (1, 20220103000005)] + [(1, None)] * 40
    df = spark.createDataFrame(given, "batch_id bigint, time bigint")
    want = rows(naming.with_epoch(df, batches(spark)))
    monkeypatch.setattr(naming, "is_small", lambda df: False)
    got = naming.with_epoch(df, batches(spark))
    assert got.columns == ["batch_id", "time", "at"] and rows(got) == want
