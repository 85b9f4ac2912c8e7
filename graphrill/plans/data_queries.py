"""Queries of the general data problems: skewed keys, faulty lines, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.operators.cowstore import EdgeStore, buckets_for
from graphrill.operators.feed import ROW, frequent, resolved_changes, side
from graphrill.operators.keyed import compress, counts, profile_of, rekeyed, totals
from graphrill.operators.naming import named, once
from graphrill.operators.rejects import split_lines
from graphrill.plans import table
from graphrill.session import cut, fresh_path

#: A source is hot if it has at least this share of the insertion rows.
HOT_SHARE = 0.01
PERCENTILES = {"p50": 0.5, "p90": 0.9}


def _source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(key, value, weight): how many insertion rows of each source vertex have each weight.

    The rows are compressed by spelled source and weight, so that a name is looked up once for each of its weights, and then
    by vertex and weight.
    """
    rows = table(spark, d, "updates").where(F.col("op") == "insert").select(*ROW, side("src").alias("s"), "weight").where(F.col("s").isNotNull())
    spelled = compress(once(rows, ROW, ["s", "weight"]), "s", "weight")
    return rekeyed(named(spelled, "key", table(spark, d, "name_map"), "vertex", "id"), "id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    n = totals(_source_pairs(spark, d))
    # A total of at most one row a task; the comparison is between whole numbers.
    total = n.agg(F.sum("rows").alias("total"))
    return n.join(F.broadcast(total), F.col("rows") * 100 >= F.col("total")).select(F.col("key").alias("src"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each source vertex: insertion rows, distinct weights and the most frequent weight."""
    return counts(cut(_source_pairs(spark, d))).select(F.col("key").alias("id"), F.col("rows").alias("n"), "distinct_values", "mode")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The same with exact percentiles of the weights."""
    return profile_of(_source_pairs(spark, d), PERCENTILES).withColumnRenamed("key", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(table(spark, d, "reference_graph_raw"))[1]


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(table(spark, d, "reference_graph_raw"))[0]


def _store(spark: SparkSession, d: str) -> EdgeStore:
    """The state before the first batch and the whole feed: its rows move once, to the buckets of their edges."""
    updates, names, edges = (table(spark, d, n) for n in ("updates", "name_map", "edges"))
    store = EdgeStore(spark, fresh_path(spark, "edges"), buckets_for(updates, edges))
    store.load(edges)
    *heavy, hot = frequent(updates, names, store.buckets)
    store.apply(resolved_changes(updates, table(spark, d, "batches"), names, tuple(heavy)), "feed", ROW, remember=False, hot=hot)
    store.drop_old()
    return store


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The edges in force that keep a deletion from before their last insertions."""
    return _store(spark, d).revived()


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).edges()


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_profile, p5_found, p5_valid, p6_found, p6_state)}

_ID = "CASE WHEN length(u.{0}_str) > 0 THEN {1}.id ELSE u.{0} END"
_ONCE = "u AS (SELECT DISTINCT batch_id, seq, op, etype, etype_str, src, src_str, dst, dst_str, weight, time FROM updates)"
_COUNTS = f"""WITH {_ONCE}, c AS (
  SELECT {_ID.format("src", "m")} AS id FROM u LEFT JOIN name_map m ON m.kind = 'vertex' AND m.name = u.src_str WHERE u.op = 'insert'),
n AS (SELECT id, count(*) AS n FROM c WHERE id IS NOT NULL GROUP BY id) """
_PROFILE = f"""WITH {_ONCE}, c AS (
  SELECT {_ID.format("src", "m")} AS id, weight FROM u LEFT JOIN name_map m ON m.kind = 'vertex' AND m.name = u.src_str WHERE u.op = 'insert'),
w AS (SELECT * FROM c WHERE id IS NOT NULL), f AS (SELECT id, weight, count(*) AS n FROM w WHERE weight IS NOT NULL GROUP BY ALL),
m AS (SELECT id, weight AS mode FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, weight) = 1) """
_LINE = "regexp_replace(coalesce(raw_line, ''), '\\r\\z', '')"
_F = r"""(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)"""
_DIGITS = r"""^[ \t]*(?:"([0-9]+)"|([0-9]+))[ \t]*,[ \t]*(?:"([0-9]+)"|([0-9]+))[ \t]*$"""
_LINES = f"""WITH t AS (SELECT record_id, {_LINE} AS line FROM reference_graph_raw),
v AS (SELECT record_id, line,
  ltrim(regexp_extract(line, '{_DIGITS}', 1) || regexp_extract(line, '{_DIGITS}', 2), '0') AS a,
  ltrim(regexp_extract(line, '{_DIGITS}', 3) || regexp_extract(line, '{_DIGITS}', 4), '0') AS b,
  regexp_matches(line, '{_DIGITS}') AS two FROM t),
w AS (SELECT record_id, line, try_cast(CASE WHEN a = '' THEN '0' ELSE a END AS BIGINT) AS c0, try_cast(CASE WHEN b = '' THEN '0' ELSE b END AS BIGINT) AS c1, two FROM v) """
_EDGES = f"""WITH {_ONCE}, r AS (
  SELECT u.batch_id, u.seq, u.op, {_ID.format("etype", "e")} AS etype, {_ID.format("src", "s")} AS src, {_ID.format("dst", "d")} AS dst, coalesce(u.weight, 1) AS weight,
    CASE WHEN u.op = 'insert' AND u.time <> 1 AND length(u.time::VARCHAR) = 14 THEN epoch(strptime(u.time::VARCHAR, '%Y%m%d%H%M%S'))::BIGINT
      WHEN u.op = 'insert' AND u.time <> 1 THEN u.time ELSE floor(epoch(b.sent_at))::BIGINT END AS ts
  FROM u LEFT JOIN batches b ON b.batch_id = u.batch_id
    LEFT JOIN name_map e ON e.kind = 'etype' AND e.name = u.etype_str
    LEFT JOIN name_map s ON s.kind = 'vertex' AND s.name = u.src_str
    LEFT JOIN name_map d ON d.kind = 'vertex' AND d.name = u.dst_str
  WHERE u.op IN ('insert', 'delete')),
r2 AS (SELECT * FROM r WHERE etype IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL),
del AS (SELECT etype, src, dst, max(ts) AS deleted_at FROM r2 WHERE op = 'delete' GROUP BY ALL),
ins AS (SELECT etype, src, dst, weight, ts AS f, ts AS l FROM r2 WHERE op = 'insert'
  UNION ALL SELECT etype, src, dst, weight, time_first, time_recent FROM edges),
state AS (SELECT i.etype, i.src, i.dst, sum(weight)::BIGINT AS weight, min(f) AS time_first, max(l) AS time_recent, max(deleted_at) AS deleted_at
  FROM ins i LEFT JOIN del USING (etype, src, dst) WHERE deleted_at IS NULL OR l > deleted_at GROUP BY ALL) """
SQL = {
    "p1_found": _COUNTS + "SELECT id AS src FROM n WHERE n * 100 >= (SELECT sum(n) FROM n)",
    "p1_counts": _PROFILE + "SELECT w.id, count(*) AS n, count(DISTINCT weight) AS distinct_values, max(m.mode) AS mode FROM w LEFT JOIN m USING (id) GROUP BY w.id",
    "p1_profile": _PROFILE + """SELECT w.id, count(*) AS rows, count(DISTINCT weight) AS distinct_values, max(m.mode) AS mode, quantile_disc(weight, 0.5) AS p50, quantile_disc(weight, 0.9) AS p90
FROM w LEFT JOIN m USING (id) GROUP BY w.id""",
    "p5_found": _LINES + f"""SELECT record_id, CASE WHEN NOT regexp_full_match(line, '{_F}(?:,{_F})*') THEN 'broken_quoting'
WHEN NOT regexp_full_match(line, '{_F},{_F}') THEN 'column_count' ELSE 'invalid_value' END AS reason FROM w WHERE NOT two OR c0 IS NULL OR c1 IS NULL""",
    "p5_valid": _LINES + "SELECT record_id, c0, c1 FROM w WHERE two AND c0 IS NOT NULL AND c1 IS NOT NULL",
    "p6_found": _EDGES + "SELECT etype, src, dst FROM state WHERE deleted_at IS NOT NULL",
    "p6_state": _EDGES + "SELECT etype, src, dst, weight, time_first, time_recent FROM state",
}
