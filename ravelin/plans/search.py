"""Search plans: one collection's strategies, authorization, and the merge over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import clean_list, snippet
from ravelin.operators import fusion, lexical, policy, vector

CANDIDATES, DIMS = 40, 256


def vector_search(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, dims: int = DIMS) -> DataFrame:
    """(query_id, collection_id, doc_id, score, rank) by cosine of hashed embeddings; a text without words is its bias."""
    items = docs.select("collection_id", "doc_id", F.concat_ws("\n", "title", "body").alias("vector"))  # embedded where it is multiplied
    return vector.top_k(items, vector.embed(queries.select("query_id", "text"), F.col("text"), dims), k, ["collection_id"], vectors=lambda texts: vector.embedded(texts, dims))


def search(docs: DataFrame, queries: DataFrame, mode: str, limit: int = 0) -> DataFrame:
    """One ranking a query and collection. mode: lexical, vector (CANDIDATES at most) or hybrid; only what it needs is computed."""
    if mode not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "lexical":
        return lexical.search(docs, queries, "any", limit)
    near = vector_search(docs, queries)
    if mode == "vector":
        return near.filter(F.col("rank") <= limit) if limit else near
    cols = ["query_id", "collection_id", "doc_id", "rank"]
    lists = lexical.search(docs, queries).select(*cols, F.lit("lexical").alias("list")).unionByName(near.select(*cols, F.lit("vector").alias("list")))
    return fusion.fuse(lists, ["query_id", "collection_id"], limit)


def authorized(hits: DataFrame, principals: DataFrame, policies: DataFrame, limit: int) -> DataFrame:
    """Candidates that a walk down each ranking examines until `limit` are allowed: with allowed, reason and rank."""
    asked = hits.join(principals, "query_id")
    return policy.authorized_prefix(policy.decide(asked, policies), ["query_id", "collection_id"], limit)


def hydrate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Titles and snippets of hits; documents that are gone drop out."""
    return hits.join(docs.select("collection_id", "doc_id", "title", snippet(F.col("body")).alias("snippet")), ["collection_id", "doc_id"])


def node_hits(local: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Local rankings as the owning node's answers: (query_id, node_id, collection_id, doc_id, rank)."""
    return local.filter(F.col("rank") <= limit).join(nodes, "collection_id").select("query_id", "node_id", "collection_id", "doc_id", "rank")


def merge(answers: DataFrame, limit: int) -> DataFrame:
    """Answers of all nodes as one ranking a query. What counts is 1 / (60 + rank) in each node's answer, at the first position
    of a document there; a document in several answers is shown from the node of smallest id."""
    first = answers.filter(F.col("doc_id") != "").groupBy("query_id", "node_id", "collection_id", "doc_id").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("query_id", "collection_id", "doc_id").agg(F.sum(1.0 / (fusion.RRF + F.col("rank"))).alias("score"), F.min("node_id").alias("node_id"))
    return lexical.ranked(fused, ["query_id"], limit, ("collection_id", "doc_id"))


def shards(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, node_id, shard_id): the requested collections that a node owns, or the bare node if it owns none; all owned
    ones if none is requested. nodes (node_id, collections), requests (query_id, collections)."""
    own, want = clean_list(F.col("n.collections"), True), clean_list(F.col("r.collections"))
    both = F.when(F.size(want) == 0, own).otherwise(F.array_intersect(own, want))
    name = F.when(F.size(both) == 0, F.array(F.col("n.node_id"))).otherwise(F.transform(both, lambda c: F.concat(F.col("n.node_id"), F.lit(":"), c)))
    return requests.alias("r").crossJoin(nodes.alias("n")).select("r.query_id", "n.node_id", F.explode(F.array_sort(name)).alias("shard_id"))


def coverage(shard_rows: DataFrame, responses: DataFrame, timeout_ms: float) -> DataFrame:
    """(query_id, searched, unavailable, complete): shards of nodes whose response (query_id, node_id, arrival_ms) came in time, and
    the others. A shard without hits is searched all the same."""
    x = shard_rows.join(responses, ["query_id", "node_id"], "left").withColumn("ok", F.coalesce(F.col("arrival_ms") <= timeout_ms, F.lit(False)))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("shard_id"))))
    return x.groupBy("query_id").agg(pick(F.col("ok")).alias("searched"), pick(~F.col("ok")).alias("unavailable"))


def cumulative(answers: DataFrame, responses: DataFrame, limit: int, timeout_ms: float) -> DataFrame:
    """The ranking after each arrival: (query_id, step, collection_id, doc_id, score, rank). Late responses never count."""
    order = Window.partitionBy("query_id").orderBy("arrival_ms", "node_id")
    steps = responses.filter(F.col("arrival_ms") <= timeout_ms).withColumn("step", F.row_number().over(order))
    first = answers.groupBy("query_id", "node_id", "collection_id", "doc_id").agg(F.min("rank").alias("rank"))
    have = first.join(steps.select("query_id", "node_id", F.col("step").alias("since")), ["query_id", "node_id"])
    grown = steps.select("query_id", "step").join(have, "query_id").filter("since <= step")
    fused = grown.groupBy("query_id", "step", "collection_id", "doc_id").agg(F.sum(1.0 / (fusion.RRF + F.col("rank"))).alias("score"))
    return lexical.ranked(fused, ["query_id", "step"], limit, ("collection_id", "doc_id"))
