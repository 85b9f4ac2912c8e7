"""Session settings, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if Catalyst's estimate of its size is at most this.
BROADCAST_BYTES = 16 << 20

#: A small filtered table, such as the names of types, is broadcast only if it is counted to have at most so many rows.
FEW_ROWS = 50_000

#: Spark's setting that shuffle files go when the query that wrote them ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("graphrill")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphrill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def releasing(spark: SparkSession):
    """Within it, what ends leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, held in the shared folder, so that it outlives any executor. Its estimated size is that of its files."""
    shared_dir(df.sparkSession)
    with releasing(df.sparkSession):
        return _sized(df.select("*").checkpoint())


def _sized(held: DataFrame) -> DataFrame:
    """A checkpoint with the size of its files instead of the estimate that led to it.

    Estimates multiply over joins, so in a loop their digits double with each round, until the driver spends its memory and
    time on them; and with the true size, joins with what a round has little of are broadcast.
    """
    spark, plan = held.sparkSession, held._jdf.queryExecution().analyzed()
    jvm, rdd = spark.sparkContext._jvm, plan.rdd()
    path = jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    none, session = jvm.scala.Option.empty(), held._jdf.sparkSession()
    # Numbers of 8 bytes have that size; statistics cannot be made from here, as a BigInt arrives as a Python number.
    stats = spark.range(-(-max(size, 1) // 8))._jdf.queryExecution().optimizedPlan().stats()
    sized = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), rdd, plan.outputPartitioning(), plan.outputOrdering(), False, none, session, jvm.scala.Some(stats), none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, sized), spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates of its rows that the same job computes.

    A task that runs twice may count twice, so measures decide only whether a loop goes on or how it spreads its rows.
    """
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(n) for n, c in measures.items()])), seen.get


def cut_and_count(df: DataFrame, condition: Column | str | None = None) -> tuple[DataFrame, int]:
    """cut(df), and how many rows it has, or for how many the condition holds."""
    one = F.lit(True) if condition is None else F.expr(condition) if isinstance(condition, str) else condition
    held, measures = cut_and_measure(df, n=F.count_if(one))
    return held, measures["n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read from there."""
    path = fresh_path(df.sparkSession, name)
    with releasing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; file sizes are of compressed data."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:
        # Estimates multiply over joins; one of thousands of digits cannot even be read.
        return 1 << 62


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Is the estimated size of ``df``, times four for decompression, within ``limit``?"""
    return 4 * estimated_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size, times four for decompression, is within ``limit``.

    Beyond the limit no hint is given and the join shuffles both sides.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def broadcast_counted(df: DataFrame, n: int, most: int = FEW_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted as ``n`` before, are at most ``most``."""
    return F.broadcast(df) if n <= most else df


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``most`` rows; for filtered tables, of which estimates know little."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def top_k(key: Column, k: int, held: int) -> Column:
    """An aggregate: [(item, count)] of about the ``k`` most frequent values of ``key``, from sketches of ``held`` values that
    merge; every value of more than a few in ``held`` of the rows is there."""
    return F.call_function("approx_top_k", key, F.lit(k), F.lit(held))


def let(value, body):
    """``body(value)`` with ``value`` computed once per row, though ``body`` uses it within lambdas."""
    return F.transform(F.array(value), body)[0]
