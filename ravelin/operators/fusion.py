"""Reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.lexical import ranked

RRF = 60


def fuse(rankings: DataFrame, by: list[str], limit: int = 0) -> DataFrame:
    """rankings (by, list, doc_id, rank): the sum of 1 / (60 + rank) over lists, of a list's first occurrence only; ranks
    are not renumbered for what is skipped. Empty ids don't count."""
    first = rankings.filter(F.col("doc_id") != "").groupBy(*by, "list", "doc_id").agg(F.min("rank").alias("rank"))
    return ranked(first.groupBy(*by, "doc_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score")), by, limit)
