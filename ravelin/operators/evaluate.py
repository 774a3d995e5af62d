"""Retrieval quality: discounted gain and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ndcg(results: DataFrame, judgments: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, ndcg): results (by, doc_id, rank) against judgments (by, doc_id, grade). Unjudged is grade 0, an ideal of 0 gives 0."""
    got = results.filter(F.col("rank") <= k) if k > 0 else results
    got = got.join(judgments, [*by, "doc_id"], "left").groupBy(*by).agg(F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = judgments.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("grade"), "doc_id")))
    best = (best.filter(F.col("r") <= k) if k > 0 else best).groupBy(*by).agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))
    return got.join(best, by, "left").select(*by, F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's first k exact results among the first k found; 0 if k is, 1 if there are none."""
    want = exact.filter(F.col("rank") <= k).select("query_id", "doc_id")
    have = found.filter(F.col("rank") <= k).select("query_id", "doc_id").withColumn("hit", F.lit(1)).distinct()
    got = want.join(have, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    every = exact.select("query_id").distinct().join(got, "query_id", "left")
    return every.select("query_id", F.lit(0.0).alias("recall") if k <= 0 else F.coalesce("r", F.lit(1.0)).alias("recall"))
