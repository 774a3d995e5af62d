"""Structured Streaming forms of the operators that live in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.changelog import latest


def heartbeat_leases(beats: DataFrame, ttl: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Lease periods of each node (node_id, ts): sessions that end ttl after the last heartbeat. The state is one open session a node."""
    return beats.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), "node_id").agg(F.count(F.lit(1)).alias("beats")).select("node_id", F.col("w.start").alias("since"), F.col("w.end").alias("expires_at"), "beats")


def metric_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by kind in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("since"), "event_type", "n", "total")


def replay_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges log batches into a table of latest rows. A batch that comes twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        rows = batch if old is None else old.unionByName(batch)
        last = rows.groupBy("collection_id", "doc_id").agg(F.max_by(F.struct("seq", "op", "body"), "seq").alias("x")).select("collection_id", "x.seq", "x.op", "doc_id", "x.body")
        write(last)

    return merge


__all__ = ["heartbeat_leases", "latest", "metric_windows", "replay_batches"]
