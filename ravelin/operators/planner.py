"""Choice of a retrieval strategy from query features, node health and a deadline; observations of past runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import query_features

#: strategy, order, quality, p95 in nanoseconds
PRIORS = [("lexical", 0, 0.78, 15_000_000), ("vector", 1, 0.82, 35_000_000), ("hybrid", 2, 0.91, 60_000_000)]
WINDOW, MARGIN = 256, 0.85


def priors(spark, rows=PRIORS) -> DataFrame:
    return spark.createDataFrame(rows, "strategy string, ord int, quality double, p95_ns long")


def snapshot(observations: DataFrame, base: DataFrame) -> DataFrame:
    """For each strategy of base the mean quality, nearest-rank p95 and number of its last WINDOW valid observations
    (strategy, arrival, latency_ns, quality); base's own where there is none."""
    ok = observations.filter((F.col("latency_ns") > 0) & F.col("quality").between(0, 1))
    last = ok.withColumn("r", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("arrival")))).filter(F.col("r") <= WINDOW)
    seen = last.groupBy("strategy").agg(F.avg("quality").alias("q"), F.expr("percentile_disc(0.95) within group (order by latency_ns)").cast("long").alias("p"), F.count(F.lit(1)).alias("samples"))
    return base.join(seen, "strategy", "left").select("strategy", "ord", F.coalesce("q", "quality").alias("quality"), F.coalesce("p", "p95_ns").alias("p95_ns"), F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))


def estimates(queries: DataFrame, base: DataFrame) -> DataFrame:
    """queries (query_id, text, total, available, vector_ready) by strategies, with quality and latency as they stand."""
    f = query_features(F.col("text"))
    ready = F.col("vector_ready") / F.greatest(F.col("available"), F.lit(1))
    lexical = F.col("strategy") == "lexical"
    by = lambda x, y, z: F.when(lexical, x).when(F.col("strategy") == "vector", y).otherwise(z)
    shift = F.when(f["quoted"] | f["id_like"], by(0.08, -0.08, -0.06)).otherwise(0.0) + F.when(f["natural"], by(-0.02, 0.05, 0.04)).otherwise(0.0)
    quality = (F.col("quality") + shift) * F.when(lexical, 1.0).otherwise(ready)
    healthy = (F.col("available") > 0) & (lexical | (F.col("vector_ready") > 0))
    latency = F.when(lexical | (ready == 0), F.col("p95_ns")).otherwise((F.col("p95_ns") / F.nullif(ready, F.lit(0.0))).cast("long"))
    return queries.crossJoin(base).withColumns({"est_quality": F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality)), "est_latency_ns": latency, "healthy": healthy})


def select(queries: DataFrame, base: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The strategy of greatest quality, then least latency, that is healthy and within the deadline's margin; else lexical."""
    e = estimates(queries, base)
    e = e.withColumn("fits", F.col("healthy") & (F.col("est_latency_ns") <= (F.col("deadline_ns") * margin).cast("long")))
    w = Window.partitionBy("query_id").orderBy(F.desc("fits"), F.when(F.col("fits"), -F.round("est_quality", 9)).otherwise(F.col("ord").cast("double")), F.when(F.col("fits"), F.col("est_latency_ns")).otherwise(F.lit(0)), "ord")
    best = e.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select("query_id", "strategy", "fits", "est_quality", F.when(F.col("fits"), F.col("est_latency_ns")).otherwise(F.col("p95_ns")).alias("est_latency_ns"))


def compare(cases: DataFrame, outcomes: DataFrame, base: DataFrame) -> DataFrame:
    """Adaptive choice against fixed strategies: policy, cases, mean_quality, mean_latency_ns (whole), miss_rate.

    cases as for select(); outcomes (query_id, strategy, latency_ns, result_quality) has every strategy of each case.
    """
    chosen = select(cases, base).select("query_id", "strategy")
    each = outcomes.join(cases.select("query_id", "deadline_ns"), "query_id")
    fixed = each.withColumn("policy", F.col("strategy"))
    adaptive = each.join(chosen, ["query_id", "strategy"]).withColumn("policy", F.lit("adaptive"))
    out = fixed.unionByName(adaptive).groupBy("policy")
    return out.agg(F.count(F.lit(1)).alias("cases"), F.avg("result_quality").alias("mean_quality"), F.expr("sum(latency_ns) div count(*)").alias("mean_latency_ns"), F.avg((F.col("latency_ns") > F.col("deadline_ns")).cast("double")).alias("miss_rate"))


def selections(cases: DataFrame, base: DataFrame) -> DataFrame:
    """(strategy, selected): how often the adaptive choice falls on each strategy, those never chosen as well."""
    n = select(cases, base).groupBy("strategy").agg(F.count(F.lit(1)).alias("selected"))
    return base.select("strategy").join(n, "strategy", "left").select("strategy", F.coalesce("selected", F.lit(0)).alias("selected"))
