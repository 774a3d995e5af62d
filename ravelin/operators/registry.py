"""Leases of nodes, elections, quorums and catching up, each as a fold over a table of events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leases(events: DataFrame, ttl: int) -> DataFrame:
    """events (node_id, at, n, kind: register, heartbeat or deregister) with `grp`, the registration each falls under, and
    `accepted`. A heartbeat counts if its registration's lease, ttl after the last that counted, has not ended;
    after a gap or a deregistration nothing counts until the next registration. at is in seconds.
    """
    order = Window.partitionBy("node_id").orderBy("at", "n")
    e = events.withColumn("grp", F.sum((F.col("kind") == "register").cast("int")).over(order))
    within = Window.partitionBy("node_id", "grp").orderBy("at", "n")
    e = e.withColumn("broken", (F.col("kind") != "register") & ((F.col("at") - F.lag("at").over(within) >= ttl) | (F.lag("kind").over(within) == "deregister")))
    return e.withColumn("accepted", (F.col("grp") > 0) & (F.max(F.coalesce(F.col("broken"), F.lit(False)).cast("int")).over(within) == 0)).drop("broken")


def registrations(events: DataFrame, ttl: int) -> DataFrame:
    """(node_id, grp, since, expires_at, gone, replaced_at): one row for each registration."""
    a = leases(events, ttl).filter("accepted").groupBy("node_id", "grp").agg(F.min("at").alias("since"), F.max("at").alias("last"), F.max((F.col("kind") == "deregister").cast("int")).alias("gone"))
    following = F.lead("since").over(Window.partitionBy("node_id").orderBy("grp"))
    return a.select("node_id", "grp", "since", (F.col("last") + ttl).alias("expires_at"), (F.col("gone") == 1).alias("gone"), following.alias("replaced_at"))


def active(events: DataFrame, ttl: int, now: int) -> DataFrame:
    """(node_id, expires_at) of the nodes with a live lease."""
    r = registrations(events.filter(F.col("at") <= now), ttl)
    return r.filter(F.col("replaced_at").isNull() & ~F.col("gone") & (F.col("expires_at") > now)).select("node_id", "expires_at")


def revision(events: DataFrame, ttl: int, now: int) -> DataFrame:
    """registered, deregistered, expired and their sum, the registry's revision at now."""
    r = registrations(events.filter(F.col("at") <= now), ttl)
    lapsed = ~F.col("gone") & (F.col("expires_at") <= F.coalesce("replaced_at", F.lit(now)))
    out = r.agg(F.count(F.lit(1)).alias("registered"), F.count_if("gone").alias("deregistered"), F.count_if(lapsed).alias("expired"))
    return out.withColumn("revision", F.col("registered") + F.col("deregistered") + F.col("expired"))


def elections(campaigns: DataFrame, duration: int, by: str = "group_id") -> DataFrame:
    """campaigns (by, n, node_id, at in seconds) with won and term. The holder keeps its term while its lease runs; others are
    turned down until it ends. The state, a holder, its term and its end, goes from one campaign to the next in the order of (at, n): groups
    are partitions' runs of sorted rows, which stream through a fold, whatever their number and length.
    """

    def run(batches):
        at_group, holder, term, ends = object(), None, 0, 0
        for batch in batches:
            group, at, node = (batch.column(i).to_pylist() for i in (0, 1, 3))
            won, terms = [], []
            for g, t, who in zip(group, at, node, strict=True):
                if g != at_group:
                    at_group, holder, term, ends = g, None, 0, -1
                live = t < ends
                ok = not live or who == holder
                if ok:
                    term += not live
                    holder, ends = who, t + duration
                won.append(ok)
                terms.append(term if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(won, pa.bool_()), pa.array(terms, pa.int64())], [by, "n", "node_id", "won", "term"])

    kind = dict(campaigns.dtypes)[by]
    rows = campaigns.select(by, F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "node_id")
    return rows.repartition(by).sortWithinPartitions(by, "at", "n").mapInArrow(run, f"`{by}` {kind}, n long, node_id string, won boolean, term long")


def held(elected: DataFrame, campaigns: DataFrame, duration: int, now: int, by: str = "group_id") -> DataFrame:
    """(by, holder, term, live): the last holder of each group and whether its lease runs at now."""
    won = elected.filter("won").join(campaigns.select(by, "n", "at"), [by, "n"]).filter(F.col("at") <= now)
    last = won.groupBy(by).agg(F.max_by(F.struct("node_id", "term", "at"), F.struct("at", "n")).alias("x"))
    return last.select(by, F.col("x.node_id").alias("holder"), F.col("x.term").alias("term"), (F.col("x.at") + duration > now).alias("live"))


def quorum(acks: DataFrame) -> DataFrame:
    """acks (offset, replica_id, local, acked, leader): acknowledged, needed and committed of each offset. The local replica counts."""
    peers = F.count_if(~F.col("local"))
    out = acks.groupBy("offset").agg((F.count_if(F.col("acked") | F.col("local"))).alias("acknowledged"), F.floor((peers + 1) / 2).cast("long").alias("h"), F.bool_and("leader").alias("leader"))
    return out.select("offset", "acknowledged", (F.col("h") + 1).alias("needed"), ((F.col("acknowledged") >= F.col("h") + 1) & F.col("leader")).alias("committed"))


def catch_up(source: DataFrame, targets: DataFrame, committed: DataFrame) -> DataFrame:
    """How each target (replica_id, committed, applied) reaches a source whose log (offset, gapless) may have lost its beginning:
    committed is one row (committed, floor). Returns replica_id, action (ahead, none, entries or snapshot), dropped and sent. The log is
    looked at once, for where it ends: entries between two offsets are as many as their difference."""
    ends = source.agg(F.min("offset").alias("first"), F.max("offset").alias("last"))  # one row
    s = targets.crossJoin(committed.select(F.col("committed").alias("goal"), "floor")).crossJoin(ends)  # one row each
    sent = F.greatest(F.lit(0), F.coalesce(F.least("goal", "last") - F.greatest(F.col("committed"), F.col("first") - 1), F.lit(0)))
    action = F.when(F.col("committed") > F.col("goal"), "ahead").when(F.col("committed") == F.col("goal"), "none").when(F.col("committed") < F.col("floor"), "snapshot").otherwise("entries")
    out = s.withColumn("action", action)
    moved = F.col("action").isin("entries", "snapshot")
    return out.select("replica_id", "action", F.when(moved, F.greatest(F.col("applied") - F.col("committed"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("dropped"), F.when(F.col("action") == "entries", sent).otherwise(F.lit(0)).cast("long").alias("sent"))
