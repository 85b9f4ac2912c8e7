"""The change feed as a stream into a store of buckets: a micro-batch rewrites only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphrill.operators.cowstore import EdgeStore
from graphrill.operators.feed import ROW, frequent, resolved_changes
from graphrill.session import stored


def apply_to(store: EdgeStore, batches: DataFrame, names: DataFrame):
    """The function for foreachBatch: resolves the micro-batch and merges it, leaving out rows that came before.

    Batches and rows may arrive in any order and more than once; a replay of a micro-batch does nothing.
    """

    def run(updates: DataFrame, batch_id: int) -> None:
        *heavy, hot = frequent(updates, names, store.manifest()["buckets"])
        changes = stored(resolved_changes(updates, batches, names, tuple(heavy)), "changes")
        store.apply(changes, ("feed", batch_id), ROW, hot=hot)
        store.drop_old()

    return run


def follow(store: EdgeStore, feed: DataFrame, batches: DataFrame, names: DataFrame, checkpoint: str):
    """Starts a query that keeps ``store`` up to date with a streaming frame of the feed; the caller stops it or waits."""
    return feed.writeStream.foreachBatch(apply_to(store, batches, names)).option("checkpointLocation", checkpoint).start()
