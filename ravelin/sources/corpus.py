"""Tables of the data folder as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (collection_id, doc_id, title, body): the first line is the title. A null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("doc_id"), title.alias("title"), F.substring(text, F.length(title) + 2, F.length(text) + 1).alias("body")
    )


def owners(docs: DataFrame, nodes: int = 4) -> DataFrame:
    """(node_id, collection_id): each collection belongs to one node, by the number in its name, or its name's CRC where there is none."""
    return docs.select("collection_id").distinct().select(F.concat(F.lit("node-"), (F.coalesce(F.expr("try_cast(substring(collection_id, 4, 9) as int)"), F.crc32(F.encode("collection_id", "UTF-8"))) % nodes).cast("string")).alias("node_id"), "collection_id")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of document changes: (collection_id, seq, op, doc_id, body), gapless per collection."""
    e = table(spark, sf_dir, "events").withColumn("collection_id", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
    from pyspark.sql import Window

    w = Window.partitionBy("collection_id").orderBy("ts", "event_id")
    return e.select("collection_id", F.row_number().over(w).cast("long").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("doc_id"), F.col("props").alias("body"))


#: The documents that a demo node starts with (id, title, text); {} is the collection.
SEEDS = [
    ("distributed-search", "Distributed search architecture", "The coordinator fans queries out to owning nodes, merges ranked results, and never stores source document content."),
    ("recovery-runbook", "Replica recovery runbook", "A recovering replica replays committed log entries when history is retained and installs a snapshot after compaction."),
    ("local-ownership", "Local ownership boundary", "Documents and indexes remain under the control of the node that owns the {} collection."),
]


def seeds(collections: DataFrame) -> DataFrame:
    """(collection_id, doc_id, title, body): the first documents of each collection (collection_id) in a demonstration."""
    rows = collections.sparkSession.createDataFrame(SEEDS, "doc_id string, title string, t string")
    return collections.crossJoin(F.broadcast(rows)).select("collection_id", "doc_id", "title", F.replace("t", F.lit("{}"), F.col("collection_id")).alias("body"))  # three rows


def relevance_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A JSON file {documents: [{id, title, content}], queries: [{text, grades: {id: grade}}]} as documents, queries and judgments."""
    schema = "documents array<struct<id: string, title: string, content: string>>, queries array<struct<text: string, grades: map<string, double>>>"
    top = spark.read.schema(schema).json(path, multiLine=True)
    docs = top.select(F.explode("documents").alias("d")).select(F.lit("relevance").alias("collection_id"), F.col("d.id").alias("doc_id"), "d.title", F.col("d.content").alias("body"))
    asked = top.select(F.posexplode("queries").alias("k", "q")).select(F.col("k").cast("string").alias("query_id"), "q.text", "q.grades")
    return docs, asked.select("query_id", "text"), asked.select("query_id", F.explode("grades").alias("doc_id", "grade"))


def synthetic(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """The benchmark corpus of n documents, from modular arithmetic."""
    i, s = F.col("id"), F.lit(seed)
    part = lambda name, x, m: F.concat(F.lit(name), (x % m).cast("string"))
    return spark.range(n).select(
        F.lit("bench").alias("collection_id"),
        F.format_string("document-%09d", i).alias("doc_id"),
        F.concat_ws(" ", part("topic", i * 104729 + s, 4096), part("owner", i * 32771 + s * 7, 16384)).alias("title"),
        F.concat_ws(" ", part("region", i * 65537 + s * 3, 256), F.concat(F.lit("record"), i.cast("string"))).alias("body"),
    )


def synthetic_queries(spark: SparkSession, n: int, documents: int, seed: int) -> DataFrame:
    i, s = (F.col("id") * 7919 + F.lit(seed)) % documents, F.lit(seed)
    part = lambda name, x, m: F.concat(F.lit(name), (x % m).cast("string"))
    return spark.range(n).select(F.col("id").cast("string").alias("query_id"), F.concat_ws(" ", part("topic", i * 104729 + s, 4096), part("region", i * 65537 + s * 3, 256)).alias("text"))
