"""Queries of the training-data problems, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphrill.llm.distinct import SIGMA, at_least_twice_the_median, estimates, roll_up, sketch
from graphrill.llm.encode import encode
from graphrill.llm.frequent import most_frequent
from graphrill.llm.groups import group
from graphrill.llm.leaks import leaks
from graphrill.llm.repeats import STOP_WORDS, THRESHOLDS, flagged, measured
from graphrill.operators.feed import ROW, side
from graphrill.operators.naming import heavy_names, named, named_rows, partly_named, rest_named, with_epoch
from graphrill.plans import table
from graphrill.session import broadcast_if_few, broadcast_if_small, cut, cut_and_count

#: Sketches decide of p2_found where their intervals of so many standard deviations do; the rest is counted.
SURE = 6.0


def _days(spark: SparkSession, d: str) -> DataFrame:
    """(day, etype, s) of the insertions that name a source and a type; s is the spelled source (see name_key)."""
    rows = table(spark, d, "updates").where(F.col("op") == "insert").select("batch_id", "time", side("src").alias("s"), side("etype").alias("e"))
    rows = named(rows.where(F.col("s").isNotNull() & F.col("e").isNotNull()), "e", table(spark, d, "name_map"), "etype", "etype")
    rows = with_epoch(rows, table(spark, d, "batches"))
    return rows.select(F.floor(F.col("at") / 86400).cast("int").alias("day"), "etype", "s")


def _frequent_sources(spark: SparkSession, d: str) -> DataFrame:
    """heavy_names of the sources of insertions, held."""
    return cut(heavy_names(table(spark, d, "updates").where(F.col("op") == "insert"), side("src"), table(spark, d, "name_map")))


def _sources(rows: DataFrame, spark: SparkSession, d: str, frequent: DataFrame) -> DataFrame:
    """``rows`` of _days with the id of the source in place of s; only rows with a name that is not frequent move, by it."""
    names = table(spark, d, "name_map")
    rows = partly_named(rows, "s", frequent, "id")
    rest = rest_named(rows.where(F.col("s").isNotNull()), "s", names, "id", F.col("day"))
    return rows.where(F.col("s").isNull()).select("day", "etype", "id").union(rest.select("day", "etype", "id"))


def _with_names(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "name_map").where("kind = 'etype'").select(F.col("id").alias("etype"), F.col("name").alias("etype_str"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    return rows.join(broadcast_if_small(types), "etype", "left").withColumn("day", day)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The intervals of the sketches decide; of a type with a day in doubt, that day and those that may be the median are
    counted exactly."""
    rows, frequent = _days(spark, d), _frequent_sources(spark, d)
    counted = cut(estimates(sketch(_sources(rows, spark, d, frequent), ["day", "etype"], "id"), SURE))
    sure, needed = at_least_twice_the_median(counted, "etype")
    needed, n = cut_and_count(needed)
    found = sure.select("day", "etype")
    if n:
        some = _sources(rows.join(broadcast_if_few(needed.select("day", "etype")), ["day", "etype"], "left_semi"), spark, d, frequent)
        exact = some.distinct().groupBy("day", "etype").agg(F.count(F.lit(1)).alias("n"))
        # Days that are not counted lie on one side of the median, and so do their estimates.
        known = counted.join(exact, ["day", "etype"], "left").join(needed.select("etype").distinct(), "etype", "left_semi")
        medians = known.groupBy("etype").agg(F.percentile(F.coalesce(F.col("n").cast("double"), "estimate"), F.lit(0.5)).alias("median"))
        doubtful = needed.where("decides").join(exact, ["day", "etype"]).join(medians, "etype").where(F.col("n") >= 2 * F.col("median"))
        found = found.union(doubtful.select("day", "etype"))
    return _with_names(found, spark, d).select("day", "etype_str")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Estimates with 95 % intervals by day and type, by day, by type and over all, from the same partial sketches."""
    rolled = roll_up(sketch(_sources(_days(spark, d), spark, d, _frequent_sources(spark, d)), ["day", "etype"], "id"), ["day", "etype"])
    return _with_names(estimates(rolled), spark, d).select("day", "etype_str", "level", "estimate", "low", "high")


def p2_error(spark: SparkSession, d: str) -> DataFrame:
    """The exact numbers by day, type and both, and whether the estimate is within six standard errors (13 %) of each."""
    rows = _sources(_days(spark, d), spark, d, _frequent_sources(spark, d))
    groups = ["day", "etype"]
    got = estimates(roll_up(sketch(rows, groups, "id"), groups), SURE)
    exact = rows.distinct().select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("level"))
    for i, g in enumerate(groups):
        exact = exact.withColumn(g, F.when(F.col("level").bitwiseAND(1 << i) == 0, F.col(g)))
    exact = exact.distinct().groupBy(*groups, "level").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({g: f"_{g}" for g in [*groups, "level"]})
    same = F.col("level") == F.col("_level")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = (F.abs(F.col("estimate") / F.col("n") - 1) <= SURE * SIGMA) & F.col("n").between(F.col("low"), F.col("high"))
    return _with_names(got.join(exact, same).withColumn("within", within), spark, d).select("day", "etype_str", "level", "n", "within")


def _same(spark: SparkSession, d: str) -> DataFrame:
    updates, names = table(spark, d, "updates"), table(spark, d, "name_map")
    number = names.where("kind = 'etype' AND name = 'same_as'").select("id").head()
    of_type = F.col("etype_str") == "same_as"
    if number is not None:
        of_type = of_type | ((F.coalesce(F.length("etype_str"), F.lit(0)) == 0) & (F.col("etype") == number[0]))
    rows = updates.where((F.col("op") == "insert") & of_type)
    pairs = rows.select(side("src").alias("s"), side("dst").alias("d")).distinct()
    spread = F.xxhash64("s", "d")
    pairs = named_rows(pairs.withColumn("spread", spread), "s", names, heavy_names(rows, side("src"), names), "a", F.col("spread"))
    return named_rows(pairs, "d", names, heavy_names(rows, side("dst"), names), "b", F.col("spread")).select("a", "b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return group(_same(spark, d), "a", "b")


def _inserts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "updates").where(F.col("op") == "insert")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # At most 100 items can each stand in 1 % of the rows.
    return most_frequent(_inserts(spark, d), ROW, ["src_str", "dst_str"], 100, 0.01).select("field", "item")


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    return most_frequent(_inserts(spark, d), ROW, ["src_str", "dst_str"], 50)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    repetition = [t for t in THRESHOLDS if t.name == "repetition"]
    return flagged(table(spark, d, "documents"), "text", repetition).where(F.size("reasons") > 0).select("doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return measured(table(spark, d, "documents"), "text", ["chars", "words", "repeated_words", "lines", "stop_words", "unspaced_share"]).withColumn("unspaced_share", F.round("unspaced_share", 9))


def p9_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(table(spark, d, "documents"), "text").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p2_error, p3_found, p4_found, p4_top, p7_ids, p8_found, p9_found, p9_measures, p9_flags)}

_ID = "CASE WHEN length(u.{0}_str) > 0 THEN {1}.id ELSE u.{0} END"
_TIME = """CASE WHEN u.time <> 1 AND length(u.time::VARCHAR) = 14 THEN epoch(strptime(u.time::VARCHAR, '%Y%m%d%H%M%S'))::BIGINT
  WHEN u.time <> 1 THEN u.time ELSE floor(epoch(b.sent_at))::BIGINT END"""
_WORDS = r"regexp_extract_all(lower(nfc_normalize(replace(coalesce({0}, ''), chr(0), ' '))), '[\p{{L}}\p{{N}}]+')"
_TOP = """WITH u AS (SELECT batch_id, seq, max(src_str) AS src_str, max(dst_str) AS dst_str FROM updates WHERE op = 'insert' GROUP BY ALL),
i AS (SELECT 'src_str' AS field, src_str AS item FROM u UNION ALL SELECT 'dst_str', dst_str FROM u),
c AS (SELECT field, item, count(*) AS n FROM i WHERE length(item) > 0 GROUP BY field, item),
n AS (SELECT field, item, n, sum(n) OVER (PARTITION BY field)::BIGINT AS total FROM c) """
_DAYS = f"""WITH r AS (SELECT strftime(make_timestamp({_TIME} * 1000000), '%Y-%m-%d') AS day, {_ID.format("etype", "e")} AS etype, {_ID.format("src", "s")} AS id
  FROM updates u LEFT JOIN batches b ON b.batch_id = u.batch_id LEFT JOIN name_map e ON e.kind = 'etype' AND e.name = u.etype_str
    LEFT JOIN name_map s ON s.kind = 'vertex' AND s.name = u.src_str WHERE u.op = 'insert'),
"""
SQL = {
    "p2_error": _DAYS + """k AS (SELECT * FROM r WHERE id IS NOT NULL AND etype IS NOT NULL)
SELECT x.day, t.name AS etype_str, x.level, x.n, true AS within FROM (
  SELECT day, etype, 0 AS level, count(DISTINCT id) AS n FROM k GROUP BY ALL UNION ALL SELECT NULL, etype, 1, count(DISTINCT id) FROM k GROUP BY ALL
  UNION ALL SELECT day, NULL, 2, count(DISTINCT id) FROM k GROUP BY ALL UNION ALL SELECT NULL, NULL, 3, count(DISTINCT id) FROM k) x LEFT JOIN name_map t ON t.kind = 'etype' AND t.id = x.etype""",
    "p2_found": _DAYS + f"""n AS (SELECT day, etype, count(DISTINCT id) AS n FROM r WHERE id IS NOT NULL AND etype IS NOT NULL GROUP BY ALL),
m AS (SELECT etype, median(n) AS m FROM n GROUP BY etype)
SELECT n.day, t.name AS etype_str FROM n JOIN m USING (etype) LEFT JOIN name_map t ON t.kind = 'etype' AND t.id = n.etype WHERE n.n >= 2 * m.m""",
    "p3_found": f"""WITH RECURSIVE p AS (SELECT DISTINCT {_ID.format("src", "s")} AS a, {_ID.format("dst", "d")} AS b FROM updates u
    LEFT JOIN name_map s ON s.kind = 'vertex' AND s.name = u.src_str LEFT JOIN name_map d ON d.kind = 'vertex' AND d.name = u.dst_str
  WHERE u.op = 'insert' AND (u.etype_str = 'same_as' OR (coalesce(u.etype_str, '') = '' AND u.etype = (SELECT id FROM name_map WHERE kind = 'etype' AND name = 'same_as')))),
l AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
c(id, g) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, c.g FROM c JOIN l ON l.a = c.id WHERE c.g < l.b)
SELECT id, min(g) AS group_id FROM c GROUP BY id""",
    "p4_found": _TOP + "SELECT field, item FROM n WHERE n * 100 >= total",
    "p4_top": _TOP + "SELECT field, item, n, total FROM n QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, encode(item)) <= 50",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("item_text")} AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
s AS (SELECT doc_id, k FROM g QUALIFY k > min(k) OVER (PARTITION BY doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM s) GROUP BY doc_id)
SELECT doc_id FROM d JOIN c USING (doc_id) WHERE c.n >= 0.3 * len(d.w)""",
    "p9_measures": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
s AS (SELECT doc_id, k FROM g QUALIFY k > min(k) OVER (PARTITION BY doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM s) GROUP BY doc_id)
SELECT doc_id, length(t)::INT AS chars, len(w)::INT AS words, coalesce(c.n, 0)::INT AS repeated_words,
  len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x, ' ')) > 0))::INT AS lines,
  len(list_filter([STOPS], lambda x: list_contains(w, x)))::INT AS stop_words,
  round(CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]', '', 'g')) / length(t) ELSE 0 END, 9) AS unspaced_share FROM d LEFT JOIN c USING (doc_id)""",
    "p9_flags": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
s AS (SELECT doc_id, k FROM g QUALIFY k > min(k) OVER (PARTITION BY doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM s) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))) / len(w), 0) AS l, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains([STOPS], x))) / len(w) ELSE 0 END AS st,
  CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]', '', 'g')) / length(t) ELSE 0 END AS un,
  CASE WHEN length(t) > 0 THEN length(regexp_replace(replace(t, chr(0), '!'), '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(t) ELSE 0 END AS sy,
  list_filter(string_split(t, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS x, CASE WHEN len(w) > 0 THEN coalesce(c.n, 0) / len(w) ELSE 0 END AS r FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN n < 50 THEN 'too_short' END, CASE WHEN (l < 3 OR l > 10) AND un <= 0.2 THEN 'word_length' END, CASE WHEN sy > 0.1 THEN 'symbols' END, CASE WHEN st < 0.05 AND un <= 0.2 THEN 'stop_words' END,
  CASE WHEN len(x) > 0 AND (len(x) - len(list_distinct(x))) / len(x) > 0.3 THEN 'repeated_lines' END,
  CASE WHEN len(x) > 0 AND len(list_filter(x, lambda y: regexp_matches(ltrim(y, ' '), '^[-*•#]'))) / len(x) > 0.9 THEN 'bullet_lines' END,
  CASE WHEN len(x) > 0 AND len(list_filter(x, lambda y: ends_with(rtrim(y, ' '), '...') OR ends_with(rtrim(y, ' '), '…'))) / len(x) > 0.3 THEN 'ellipsis_lines' END,
  CASE WHEN r >= 0.3 THEN 'repetition' END], lambda y: y IS NOT NULL), ',') AS reasons FROM m""",
}
SQL |= {n: SQL[n].replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)) for n in ("p9_measures", "p9_flags")}
