"""A keyed edge table in buckets of files: changes rewrite only the buckets they touch and commit a new manifest."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from graphrill.session import estimated_bytes, partitions, top_k

KEY = ["etype", "src", "dst"]
#: What buckets are made of. The slot is 0, but the changes of a hot key are in SLOTS slots for each bucket.
SLOTS = 4
PLACE = [*KEY, "slot"]
#: A row is what the insertions of an edge at one time brought (deleted_at is then the last deletion before it, if any), or
#: the last deletion of an edge (weight and times are then null).
STATE = "etype bigint, src bigint, dst bigint, slot bigint, weight bigint, time_first bigint, time_recent bigint, deleted_at bigint"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
#: Buckets are as many as make about so many bytes each.
BUCKET_BYTES = 128 << 20
#: A key is hot if it has so many changes of a set and twice the even share of a bucket; so many may be hot in one set.
HOT_ROWS, HOT_MOST = 100_000, 64
#: So many ledgers are held before they are written as one.
LEDGERS = 16


def buckets_for(*tables: DataFrame) -> int:
    """How many buckets suit the tables that will be in a store: by their bytes, and a task for each core at least."""
    total = sum(4 * estimated_bytes(t) for t in tables)
    return max(partitions(tables[0].sparkSession), math.ceil(total / BUCKET_BYTES))


def bucket_of(buckets: int) -> Column:
    """The bucket of a row with PLACE, by the hash that Spark's bucketed tables and exchanges use."""
    return F.pmod(F.hash(*[F.col(c).cast("bigint") for c in PLACE]), F.lit(buckets))


def hot_texts(rows: DataFrame, key: Column, buckets: int, *others: Column) -> tuple[list[str], Row]:
    """Of a text that stands for the key of each change, those with a hot number of rows, from one bounded sketch; and the row
    of ``others``, aggregates of the same pass. A miss costs balance only, never a row."""
    row = rows.agg(top_k(key, HOT_MOST, 64 * HOT_MOST).alias("_top"), F.count(F.lit(1)).alias("_n"), *others).head()
    least = max(HOT_ROWS, 2 * row["_n"] / buckets)
    return [x["item"] for x in row["_top"] or [] if x["item"] is not None and x["count"] >= least], row


def hot_keys(changes: DataFrame, buckets: int) -> list[tuple[int, int, int]]:
    """The hot keys of ``changes``, at most HOT_MOST."""
    texts, _ = hot_texts(changes.dropna(subset=KEY), F.concat_ws(",", *[F.col(c).cast("bigint") for c in KEY]), buckets)
    return [tuple(int(x) for x in text.split(",")) for text in texts]


def no_slot() -> Column:
    """Zero, but not for the optimizer, which would take a constant out of the grouping and then not see that rows with PLACE
    are where they belong."""
    return F.pmod(F.xxhash64("src"), F.lit(1)).cast("bigint")


def _slots(rows: DataFrame, hot: list[int], buckets: int, by: list[str]) -> DataFrame:
    """``rows`` with their slot; a deletion of a hot key (of the hashes ``hot``) is in all slots, an insertion in one by ``by``."""
    if not hot:
        return rows.withColumn("slot", no_slot())
    none = F.lit(0).cast("bigint")
    is_hot = F.xxhash64(*[F.col(c).cast("bigint") for c in KEY]).isin(hot)
    own = F.pmod(F.xxhash64(*by), F.lit(SLOTS * buckets))
    every = F.sequence(none, F.lit(SLOTS * buckets - 1).cast("bigint"))
    return rows.withColumn("slot", F.explode(F.when(is_hot & F.col("gone"), every).when(is_hot, F.array(own)).otherwise(F.array(none))))


def routed(changes: DataFrame, buckets: int, hot: list[int], identity: list[str] | None) -> DataFrame:
    """``changes`` (KEY, op, weight, at) as rows of STATE, in the task of their bucket: the only time that they move.

    Copies with the same ``identity`` of an edge are one change (of such that differ the greatest time and weight count), the
    insertions of one time are added up, and of deletions the last stays. A null weight counts 1. Keys with a null are left
    out.
    """
    at = [F.col(c).cast("bigint").alias(c) for c in KEY]
    rows = changes.where(F.col("op").isin("insert", "delete")).dropna(subset=KEY)
    rows = rows.select(*at, (F.col("op") == "delete").alias("gone"), F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"), F.col("at").cast("bigint").alias("at"), *(identity or []))
    rows = _slots(rows, hot, buckets, identity or ["at"]).repartition(buckets, *PLACE)
    if identity:
        rows = rows.groupBy(*PLACE, "gone", *identity).agg(F.max("at").alias("at"), F.max("weight").alias("weight"))
    time = F.when(~F.col("gone"), F.col("at"))
    sums = rows.groupBy(*PLACE, "gone", time.alias("time")).agg(F.sum("weight").alias("weight"), F.max("at").alias("last"))
    return sums.select(*PLACE, F.when(~F.col("gone"), F.col("weight")).alias("weight"), F.col("time").alias("time_first"), F.col("time").alias("time_recent"), F.when(F.col("gone"), F.col("last")).alias("deleted_at"))


def merge(rows: DataFrame) -> DataFrame:
    """The rows of STATE that are left of old and new ``rows``, whatever the order in which they arrived.

    An edge is in force if an insertion is later than its last deletion; at equal time the deletion is the later. Insertions
    up to the last deletion are gone; the others stay with their times, so a deletion that arrives later than newer
    insertions takes away just what it should. Deletions stay, so that a late insertion cannot bring an edge back. Of one
    edge and slot there are at most as many rows as times. In rows that are in tasks by PLACE nothing moves.
    """
    marker = F.col("weight").isNull()
    last = F.max(F.when(marker, F.col("deleted_at"))).over(Window.partitionBy(*PLACE))
    rows = rows.withColumn("last", last).where(marker | F.col("last").isNull() | (F.col("time_recent") > F.col("last")))
    kept = rows.groupBy(*PLACE, "time_recent", marker.alias("marker")).agg(F.sum("weight").alias("weight"), F.min("time_first").alias("time_first"), F.max(F.coalesce("last", "deleted_at")).alias("deleted_at"))
    return kept.select(*COLUMNS)


class EdgeStore:
    """The table at ``path``: bucketed files in ``v*/bucket=*``, and manifests that say which version holds each bucket.

    A manifest is written under a name of its own and then renamed to its number, which only the writer may do who created
    the claim of that number; so a reader sees a whole version or the one before, and of two writers one fails. Replaying a
    change set under the id of one already applied does nothing. The folder ``ledger`` has the identities of the changes
    applied so far, if they are to be remembered.

    The buckets of a version are read and written as Spark's bucketed tables, under names in the session's catalog that last
    as long as the job: so a change moves once, to its bucket, and what is in the bucket does not move.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets or partitions(spark)
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._jpath(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{version, buckets, files: {bucket: folder}, applied: ids, hot: keys, ledger: folders, folded: time}; of an empty
        store, version 0."""
        folder = self._jpath(f"{self.path}/manifests")
        numbers = [int(n) for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "files": {}, "applied": [], "streams": {}, "hot": [], "ledger": [], "folded": None}
        return json.loads(self._read_text(f"{self.path}/manifests/{max(numbers)}"))

    def _commit(self, manifest: dict) -> None:
        final = f"{self.path}/manifests/{manifest['version']}"
        try:
            self._fs.create(self._jpath(f"{final}.claim"), False).close()
        except Exception as e:
            raise RuntimeError(f"version {manifest['version']} was committed by another writer") from e
        temporary = self._jpath(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(temporary, self._jpath(final)):
            raise RuntimeError(f"the commit of version {manifest['version']} failed")

    def recover(self) -> None:
        """Takes back the claim of a writer that died before its commit; to be called when no writer runs."""
        claim = self._jpath(f"{self.path}/manifests/{self.manifest()['version'] + 1}.claim")
        if self._fs.exists(claim):
            self._fs.delete(claim, False)

    def _write(self, rows: DataFrame, root: str, buckets: int) -> dict[str, str]:
        """Writes ``rows``, which are in tasks by PLACE; {bucket: folder} of the buckets that have rows."""
        name = f"graphrill_{uuid.uuid4().hex}"
        try:
            rows.withColumn("bucket", bucket_of(buckets)).write.format("parquet").partitionBy("bucket").bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", root).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(root))]
        return {n.split("=")[1]: f"{root}/{n}" for n in names if n.startswith("bucket=")}

    def _bucketed(self, folders: dict[str, str], buckets: int) -> tuple[str, DataFrame]:
        """A bucketed table of the folders, and its name, which the caller drops after use."""
        name = f"graphrill_{uuid.uuid4().hex}"
        quoted = lambda path: "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.spark.sql(f"CREATE TABLE {name} ({STATE}, bucket int) USING parquet PARTITIONED BY (bucket) CLUSTERED BY ({', '.join(PLACE)}) SORTED BY ({', '.join(PLACE)}) INTO {buckets} BUCKETS LOCATION {quoted(self.path + '/none')}")
        if folders:
            self.spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION (bucket = {b}) LOCATION {quoted(p)}" for b, p in folders.items()))
        # Columns under ids of their own: a union of two tables keeps their buckets only then.
        return name, self.spark.table(name).select(*[F.col(c).alias(c) for c in COLUMNS])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def load(self, edges: DataFrame) -> None:
        """Makes ``edges`` (KEY, weight, time_first, time_recent) the first version."""
        m = self.manifest()
        none = F.lit(None).cast("bigint")
        rows = edges.dropna(subset=KEY).select(*[F.col(c).cast("bigint").alias(c) for c in KEY], no_slot().alias("slot"), F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"), "time_first", "time_recent", none.alias("deleted_at"))
        files = self._write(rows.repartition(self.buckets, *PLACE), self._version(m), self.buckets)
        self._commit(m | {"version": m["version"] + 1, "buckets": self.buckets, "files": files})

    def _version(self, m: dict) -> str:
        return f"{self.path}/v{m['version'] + 1}-{uuid.uuid4().hex[:8]}"

    def _fresh(self, changes: DataFrame, identity: list[str], ledger: list[str]) -> DataFrame:
        """``changes`` that no set before has applied. Only the ledger's rows in their range of identities are read."""
        low, high = changes.agg(F.min(identity[0]), F.max(identity[0])).head()
        if low is None or not ledger:
            return changes
        known = self.spark.read.parquet(*ledger).where(F.col(identity[0]).between(low, high))
        return changes.join(known, identity, "left_anti")

    def _noted(self, changes: DataFrame, identity: list[str], ledger: list[str]) -> list[str]:
        """The ledgers with the identities of ``changes``; when they are many they become one, sorted."""
        path = f"{self.path}/ledger/{uuid.uuid4().hex}"
        rows = changes.select(*identity)
        if len(ledger) >= LEDGERS:
            rows, ledger = rows.union(self.spark.read.parquet(*ledger)).repartitionByRange(*identity), []
        rows.sortWithinPartitions(*identity).write.parquet(path)
        return [*ledger, path]

    def _heated(self, m: dict, hot: list[tuple[int, int, int]]) -> tuple[dict, list[int], DataFrame | None]:
        """The manifest with new hot keys, the hashes of all, and the deletions known so far of the new ones, which now belong
        to all slots."""
        new = [list(k) for k in hot if list(k) not in m["hot"]]
        keys = m["hot"] + new
        if not keys:
            return m, [], None
        found = self.spark.createDataFrame([tuple(k) for k in keys], "etype bigint, src bigint, dst bigint").withColumn("slot", F.lit(0).cast("bigint"))
        placed = found.select(*KEY, F.xxhash64(*KEY).alias("h"), bucket_of(m["buckets"]).alias("b")).collect()  # the hot keys
        at = {(r["etype"], r["src"], r["dst"]): r for r in placed}
        folders = {m["files"][b] for k in new if (b := str(at[tuple(k)]["b"])) in m["files"]}
        old = None
        if folders:
            only = F.broadcast(self.spark.createDataFrame([tuple(k) for k in new], "etype bigint, src bigint, dst bigint"))
            old = self._read(sorted(folders)).where("weight IS NULL").join(only, KEY, "left_semi")
        return m | {"hot": keys}, [r["h"] for r in placed], old

    def apply(self, changes: DataFrame, change_id: str | tuple[str, int], identity: list[str] | None = None, remember: bool = True, hot: list[tuple[int, int, int]] | None = None) -> list[int]:
        """Merges ``changes`` (KEY, op, weight, at) into the buckets they touch; the buckets rewritten.

        ``change_id`` names the set; of a pair (stream, number) only the last number of the stream is kept. With ``identity``
        (columns of changes, such as batch and number) copies of a change count once; with ``remember`` those that an
        earlier set brought are left out too, and ``changes`` is then read more than once. ``hot`` are keys with very many
        changes; if it is None, a pass over ``changes`` finds them.
        """
        m = self.manifest()
        stream = change_id if isinstance(change_id, tuple) else None
        if m["streams"].get(stream[0], -1) >= stream[1] if stream else change_id in m["applied"]:
            return []
        ledger, buckets = m["ledger"], m["buckets"]
        if identity and remember:
            changes = self._fresh(changes, identity, ledger)
            ledger = self._noted(changes, identity, ledger)
        m, hashes, old_deletions = self._heated(m, hot_keys(changes, buckets) if hot is None else hot)
        if old_deletions is not None:
            blank = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in identity or []]
            deletions = old_deletions.select(*KEY, F.lit("delete").alias("op"), F.lit(None).cast("bigint").alias("weight"), F.col("deleted_at").alias("at"), *blank)
            changes = changes.select(*deletions.columns).union(deletions)
        parts = f"{self.path}/changes/{uuid.uuid4().hex}"
        new = self._write(routed(changes, buckets, hashes, identity), parts, buckets)
        if m["folded"] is not None:
            early = self._read(list(new.values())).agg(F.min(F.least("time_recent", "deleted_at"))).head()[0]
            if early is not None and early < m["folded"]:
                raise ValueError(f"a change at {early} is from before {m['folded']}, up to which the store is folded")
        touched = sorted(int(b) for b in new)
        names, tables = zip(*[self._bucketed(f, buckets) for f in ({b: m["files"][b] for b in new if b in m["files"]}, new)])
        try:
            files = self._write(merge(tables[0].union(tables[1])), self._version(m), buckets)
        finally:
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._fs.delete(self._jpath(parts), True)
        done = {"streams": m["streams"] | {stream[0]: stream[1]}} if stream else {"applied": [*m["applied"], change_id]}
        self._commit(m | done | {"version": m["version"] + 1, "files": m["files"] | files, "ledger": ledger})
        return touched

    def fold(self, before: int) -> None:
        """Makes the insertions of an edge before a time one row, and forgets the deletions before it. Changes before that time
        are an error from then on."""
        m = self.manifest()
        early = F.col("time_recent") < before
        name, rows = self._bucketed(m["files"], m["buckets"])
        kept = rows.where(F.col("weight").isNotNull() | (F.col("deleted_at") >= before))
        sums = kept.groupBy(*PLACE, F.col("weight").isNull().alias("marker"), F.when(~early, F.col("time_recent")).alias("late")).agg(
            F.sum("weight").alias("weight"), F.min("time_first").alias("time_first"), F.max("time_recent").alias("time_recent"), F.max("deleted_at").alias("deleted_at")
        )
        try:
            files = self._write(sums.select(*COLUMNS), self._version(m), m["buckets"])
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._commit(m | {"version": m["version"] + 1, "files": files, "folded": max(before, m["folded"] or before)})

    def resize(self, buckets: int) -> None:
        """Writes all rows into another number of buckets, as for a table that has grown; hot keys come together first."""
        m = self.manifest()
        rows = self.rows().withColumn("slot", no_slot())
        files = self._write(merge(rows.repartition(buckets, *PLACE)), self._version(m), buckets)
        self._commit(m | {"version": m["version"] + 1, "buckets": buckets, "files": files, "hot": []})

    def rows(self) -> DataFrame:
        """All rows of the last version."""
        return self._read(list(self.manifest()["files"].values()))

    def edges(self) -> DataFrame:
        """The edges in force: KEY, weight, time_first, time_recent."""
        alive = self.rows().where(F.col("weight").isNotNull())
        return alive.groupBy(*KEY).agg(F.sum("weight").alias("weight"), F.min("time_first").alias("time_first"), F.max("time_recent").alias("time_recent"))

    def revived(self) -> DataFrame:
        """The keys of the edges in force that a deletion names."""
        return self.rows().where(F.col("weight").isNotNull() & F.col("deleted_at").isNotNull()).select(*KEY).distinct()

    def drop_old(self) -> None:
        """Deletes the data of versions and the ledgers that the last manifest does not name."""
        m = self.manifest()
        kept = {f.split("/")[-2] for f in m["files"].values()} | {f.split("/")[-1] for f in m["ledger"]}
        for folder in (self.path, f"{self.path}/ledger"):
            for s in self._fs.listStatus(self._jpath(folder)) if self._fs.exists(self._jpath(folder)) else []:
                name = s.getPath().getName()
                if name not in kept and (name.startswith("v") or folder != self.path):
                    self._fs.delete(s.getPath(), True)
