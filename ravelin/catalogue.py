"""The engine's queries over the data folder; catalogue_sql has their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.catalogue_sql import SQL
from ravelin.functions import text as tx
from ravelin.functions.hashing import fnv1a, level
from ravelin.operators import changelog, evaluate, fusion, lexical, planner, policy, registry, requests, vector
from ravelin.plans import search as plans
from ravelin.sources import corpus as src
from ravelin.sources.shared import fresh_folder
from ravelin.streaming import flows

TEXTS = [("q1", "the of and"), ("q2", "der die und ist"), ("q3", "la que de"), ("q4", "that THE tion ing"), ("q5", " --- ")]
PRINCIPALS = [("q1", "alice", ["engineering"], ["search.execute"]), ("q2", "lead", ["engineering", "leads"], ["search.execute"]), ("q3", "bob", ["sales"], ["search.execute"]), ("q4", "suspended-user", ["engineering"], ["search.execute"]), ("q5", " ", ["engineering"], ["search.execute"])]
KEY = b"audit-key"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "query_id string, text string")


def _principals(spark: SparkSession, action: str = "search") -> DataFrame:
    return spark.createDataFrame(PRINCIPALS, "query_id string, subject string, groups array<string>, scopes array<string>").withColumn("action", F.lit(action))


def _policies(docs: DataFrame) -> DataFrame:
    """Collections below src15 allow engineers with a scope and deny a suspended user; documents whose id ends in 0 are for leads."""
    rule = "struct('allow' as effect, array('search','read') as actions, cast(array() as array<string>) as subjects, array('engineering') as groups, array('search.execute') as scopes)"
    deny = "struct('deny' as effect, array('search','read') as actions, array('suspended-user') as subjects, cast(array() as array<string>) as groups, cast(array() as array<string>) as scopes)"
    lead = "struct('allow' as effect, array('search') as actions, cast(array() as array<string>) as subjects, array('leads') as groups, array('search.execute') as scopes)"
    coll = docs.select("collection_id").distinct().filter("cast(substring(collection_id, 4) as int) < 15").select("collection_id", F.lit(None).cast("string").alias("doc_id"), F.expr(f"array({rule}, {deny})").alias("rules"))
    return coll.unionByName(docs.filter(F.col("doc_id").endswith("0")).select("collection_id", "doc_id", F.expr(f"array({lead})").alias("rules")))


def _r6(c: str):
    return F.round(c, 6).alias(c)


@query
def tokenize_lengths(spark, sf):
    """F-01, F-02, F-04: words of each field and distinct words."""
    w = lexical.analyzed(src.corpus(spark, sf))
    return w.select("doc_id", F.size("title_tokens").cast("long").alias("len_title"), F.size("body_tokens").cast("long").alias("len_body"), F.size(F.array_union("title_tokens", "body_tokens")).cast("long").alias("n_terms"))


@query
def lexical_field_stats(spark, sf):
    """A-03."""
    return lexical.stats(lexical.analyzed(src.corpus(spark, sf))).select("collection_id", "n", _r6("avg_title"), _r6("avg_body"))


@query
def doc_frequency(spark, sf):
    """A-01, A-02, O-22: postings summed up by term."""
    docs = src.corpus(spark, sf).repartition("collection_id", "doc_id")  # whole texts are dealt, so postings, which are larger, are not
    return lexical.postings(lexical.analyzed(docs)).groupBy("collection_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf_title").alias("tf_title"), F.sum("tf_body").alias("tf_body"))


def _lex(spark, sf, mode, limit):
    return lexical.search(src.corpus(spark, sf), _queries(spark), mode, limit)


@query
def lexical_any(spark, sf):
    """C-01, P-01, A-04, W-01, S-01, J-01, U-01."""
    return _lex(spark, sf, "any", 10).select("query_id", "collection_id", "doc_id", _r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def lexical_all(spark, sf):
    """C-01, P-02, J-03, U-02."""
    return _lex(spark, sf, "all", 0).select("query_id", "collection_id", "doc_id", _r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def snippets(spark, sf):
    """F-13."""
    return src.corpus(spark, sf).select("doc_id", tx.snippet(F.col("body")).alias("snippet"))


@query
def feature_hashes(spark, sf):
    """F-07, F-20: FNV-1a and graph level of each document id."""
    return src.corpus(spark, sf).select("doc_id", fnv1a(F.col("doc_id")).alias("hash"), level(F.col("doc_id")).cast("long").alias("level"))


def _vectors(spark, sf):
    e = src.table(spark, sf, "embeddings")
    items = e.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return items, items.filter(F.col("doc_id").cast("long") % 100 == 0).select(F.col("doc_id").alias("query_id"), "vector")


@query
def vector_normalize_check(spark, sf):
    """F-09."""
    v = F.col("embedding")
    n = vector.normalized(v)
    return src.table(spark, sf, "embeddings").select("vec_id", vector.valid(v, 64).alias("ok"), F.round(vector.norm(v), 5).alias("norm"), F.round(F.element_at(n, 1), 6).alias("first"))


@query
def vector_exact_topk(spark, sf):
    """S-02, J-04, F-10, C-17: every hundredth vector against all."""
    items, q = _vectors(spark, sf)
    return vector.top_k(items, q, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def graph_vector_search(spark, sf):
    """S-03 to S-08: the proximity graph, with its recall against the exact result."""
    items, q = _vectors(spark, sf)
    return evaluate.recall(vector.top_k(items, q, 10), vector.graph_top_k(items, q, 10), 10)


@query
def recall_at_k(spark, sf):
    """A-13, J-11: neighbours by coarse vectors (tenths) against the exact ones."""
    items, q = _vectors(spark, sf)
    coarse = lambda d: d.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 1)))
    return evaluate.recall(vector.top_k(items, q, 10), vector.top_k(coarse(items), coarse(q), 10), 10).select("query_id", _r6("recall"))


@query
def rrf_fusion(spark, sf):
    """A-05, W-02, S-09, U-03, J-05: all queries' rankings of a collection as lists of one fusion."""
    hits = _lex(spark, sf, "any", 50).select("collection_id", F.col("query_id").alias("list"), "doc_id", "rank")
    return fusion.fuse(hits, ["collection_id"], 10).select("collection_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def ndcg_at_k(spark, sf):
    """A-12, F-21, J-10: ten results a query and collection against grades 2 * quality + 1 - toxic."""
    docs = src.corpus(spark, sf)
    grades = src.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    judged = docs.join(grades, "doc_id").crossJoin(_queries(spark).select("query_id")).select("query_id", "collection_id", "doc_id", "grade")  # five queries
    return evaluate.ndcg(_lex(spark, sf, "any", 10), judged, ["query_id", "collection_id"], 10).select("query_id", "collection_id", _r6("ndcg"))


def _text(docs):
    return docs.select("collection_id", "doc_id", F.concat_ws("\n", "title", "body").alias("text"))


@query
def hash_embed_features(spark, sf):
    """F-05, F-06, F-08: the signed bag of each document."""
    v = vector.embed(_text(src.corpus(spark, sf)), F.col("text"), plans.DIMS)
    return v.select("doc_id", F.posexplode("vector").alias("slot", "weight")).filter("weight <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.col("weight").cast("double").alias("weight"))


@query
def hash_vector_search(spark, sf):
    """C-02, S-05: forty candidates a query and collection."""
    return plans.vector_search(src.corpus(spark, sf), _queries(spark)).select("query_id", "collection_id", "doc_id", _r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def hybrid_search(spark, sf):
    """C-03."""
    return plans.search(src.corpus(spark, sf), _queries(spark), "hybrid", 10).select("query_id", "collection_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def policy_decisions(spark, sf):
    """C-10, P-06, J-06, J-07, A-08: five principals asking for every document."""
    docs = src.corpus(spark, sf)
    asked = docs.select("collection_id", "doc_id").crossJoin(_principals(spark))  # five principals
    return policy.decide(asked, _policies(docs)).select("collection_id", "doc_id", "query_id", "allowed", "reason")


def _walk(spark, sf):
    docs = src.corpus(spark, sf)
    return docs, plans.authorized(_lex(spark, sf, "any", 0), _principals(spark), _policies(docs), 5)


@query
def authorized_search(spark, sf):
    """S-11, J-02, O-19: five allowed results a query and collection, with titles and snippets."""
    docs, seen = _walk(spark, sf)
    return plans.hydrate(seen.filter("allowed"), docs).select("query_id", "collection_id", "doc_id", F.col("given").cast("long").alias("rank"), "title", "snippet")


@query
def audit_prefix(spark, sf):
    """O-18, F-22, F-23: the candidates examined, as audit records."""
    _, seen = _walk(spark, sf)
    return policy.audit(seen, KEY)


@query
def get_document(spark, sf):
    """C-04, O-04: read requests of the first principal, one for each document and one for an id that isn't there."""
    docs = src.corpus(spark, sf)
    ids = docs.select("collection_id", "doc_id").unionByName(docs.select("collection_id", F.concat("doc_id", F.lit("-gone")).alias("doc_id")))
    asked = ids.crossJoin(_principals(spark, "read").filter("query_id = 'q1'"))
    d = policy.decide(asked, _policies(docs)).join(docs.withColumn("here", F.lit(True)), ["collection_id", "doc_id"], "left")
    status = F.when(F.col("here").isNull(), "not_found").when(~F.col("allowed"), "permission_denied").otherwise("found")
    return d.select("collection_id", "doc_id", status.alias("status"), F.when(status == "found", F.octet_length(F.concat_ws("\n", "title", "body")).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_bytes"))


def _answers(spark, sf):
    docs = src.corpus(spark, sf)
    return docs, plans.node_hits(_lex(spark, sf, "any", 10), src.owners(docs), 10)


@query
def federated_search(spark, sf):
    """C-07, A-06, J-09, S-10: the flagship, one ranking a query over all nodes."""
    docs, answers = _answers(spark, sf)
    return plans.hydrate(plans.merge(answers, 10), docs).select("query_id", "collection_id", "doc_id", "node_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), "title", "snippet")


def _responses(spark, docs):
    nodes = src.owners(docs).select("node_id").distinct()
    return _queries(spark).select("query_id").crossJoin(nodes).select("query_id", "node_id", (20.0 + F.substring("node_id", 6, 9).cast("int") * 30 + F.substring("query_id", 2, 1).cast("int")).alias("arrival_ms"))


def _shards(spark, docs):
    nodes = src.owners(docs).groupBy("node_id").agg(F.collect_set("collection_id").alias("collections"))
    want = spark.createDataFrame([("q1", []), ("q2", ["src1", " src2 ", "src1", ""]), ("q3", ["src0", "src4", "src9"]), ("q4", ["nowhere"]), ("q5", ["src3"])], "query_id string, collections array<string>")
    return plans.shards(nodes, want)


@query
def shard_coverage(spark, sf):
    """F-26, A-07, U-05, J-08, P-04."""
    return _shards(spark, src.corpus(spark, sf))


@query
def deadline_partial(spark, sf):
    """X-02, U-04: shards searched and unavailable at 100 ms."""
    docs = src.corpus(spark, sf)
    out = plans.coverage(_shards(spark, docs), _responses(spark, docs), 100.0)
    return out.select("query_id", F.concat_ws(",", "searched").alias("searched"), F.concat_ws(",", "unavailable").alias("unavailable"))


@query
def cumulative_updates(spark, sf):
    """X-01, X-03, W-07."""
    docs, answers = _answers(spark, sf)
    return plans.cumulative(answers, _responses(spark, docs), 10, 100.0).select("query_id", F.col("step").cast("long").alias("step"), "collection_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def query_features(spark, sf):
    """F-14 to F-16 of every turn."""
    f = tx.query_features(F.col("text"))
    return src.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role"), *[c.cast("long").alias(k) if k in ("tokens", "runes") else c.alias(k) for k, c in f.items()])


def _cases(spark, sf):
    c = src.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("query_id"), "text", "conv_id", "turn")
    return c.groupBy("query_id").agg(F.min("text").alias("text"), F.min("conv_id").alias("c"), F.min("turn").alias("t")).select("query_id", "text", F.lit(3).alias("total"), F.lit(3).alias("available"), (F.col("c") % 4).alias("vector_ready"), ((F.col("t") % 5 + 1) * 25_000_000).alias("deadline_ns"))


@query
def planner_select(spark, sf):
    """C-08, C-09, F-17 to F-19, P-09, S-12."""
    return planner.select(_cases(spark, sf), planner.priors(spark)).select("query_id", "strategy", "fits", _r6("est_quality"), "est_latency_ns")


@query
def tracker_snapshot(spark, sf):
    """A-09, W-03, P-13."""
    e = src.table(spark, sf, "events")
    name = F.element_at(F.array(F.lit("lexical"), F.lit("vector"), F.lit("hybrid")), (F.col("event_id") % 3 + 1).cast("int"))
    obs = e.select(name.alias("strategy"), F.col("event_id").alias("arrival"), F.round(F.col("value") * 1000000).cast("long").alias("latency_ns"), (F.col("event_id") % 101 / 100.0).alias("quality"))
    return planner.snapshot(obs, planner.priors(spark)).select("strategy", _r6("quality"), "p95_ns", "samples")


@query
def planner_compare(spark, sf):
    """C-11, A-10, A-11, J-12."""
    cases, base = _cases(spark, sf), planner.priors(spark)
    n = F.length("text")
    out = cases.crossJoin(base.select("strategy", "ord")).select("query_id", "strategy", (15_000_000 * (F.col("ord") + 1) + n % 97 * 1_000_000).cast("long").alias("latency_ns"), (0.5 + (n + F.col("ord")) % 10 / 20.0).alias("result_quality"))
    return planner.compare(cases, out, base).select("policy", "cases", _r6("mean_quality"), "mean_latency_ns", _r6("miss_rate"))


def _log(spark, sf):
    log = src.change_log(spark, sf)
    return log, log.groupBy("collection_id").agg(F.floor(F.max("seq") * 0.9).cast("long").alias("committed"))


@query
def log_replay(spark, sf):
    """O-01 to O-05, C-05, C-06, P-08, A-15. The binary log (O-06, O-20) is changelog.decode_log, O-07 is changelog.append."""
    return changelog.replay(*_log(spark, sf)).select("collection_id", "doc_id", "seq", "body")


@query
def log_truncate(spark, sf):
    """C-16, W-04, O-21: the log after a checkpoint at a third, and how many gaps it has."""
    log, commits = _log(spark, sf)
    cut = changelog.truncate(log, commits.select("collection_id", F.expr("committed div 3").alias("base")))
    gaps = changelog.gaps(cut).groupBy("collection_id").agg(F.count(F.lit(1)).alias("gaps"))
    return cut.groupBy("collection_id").agg(F.count(F.lit(1)).alias("entries"), F.min("seq").alias("low"), F.max("seq").alias("high")).join(gaps, "collection_id", "left").select("collection_id", "entries", "low", "high", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def _segments(spark, sf):
    log = src.change_log(spark, sf).withColumn("generation", F.expr("(seq - 1) div 50 + 1"))
    w = Window.partitionBy("collection_id", "doc_id", "generation").orderBy(F.desc("seq"))
    return log.withColumn("r", F.row_number().over(w)).filter("r = 1").select("collection_id", "doc_id", "op", "seq", "body", "generation")


@query
def segment_documents(spark, sf):
    """O-09, O-12, U-06."""
    return changelog.segment_documents(_segments(spark, sf)).select("collection_id", "doc_id", "seq", "generation")


@query
def segment_compact(spark, sf):
    """O-08, O-11, O-13, O-14: all generations of the log, written in their order, read, and compacted to one."""
    path = fresh_folder(spark, "segments")
    changelog.publish_all(_segments(spark, sf), path)
    return changelog.compact(changelog.read_segments(spark, path), 2).select("collection_id", "doc_id", "op", "seq", "generation")


def _nodes(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "deregister").when(F.col("event_type").isin("click", "view"), "heartbeat")
    return src.table(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("n"), kind.alias("kind")).filter("kind is not null")


TTL = 43_200


def _now(events):
    return int(events.agg(F.max("at")).first()[0] or 0)


@query
def lease_active_nodes(spark, sf):
    """C-12, P-07, W-05, X-04."""
    e = _nodes(spark, sf)
    return registry.active(e, TTL, _now(e))


@query
def registry_revision(spark, sf):
    """C-12, W-05."""
    e = _nodes(spark, sf)
    return registry.revision(e, TTL, _now(e))


def _campaigns(spark, sf):
    e = src.table(spark, sf, "events").filter("event_type = 'signup'")
    return e.select((F.col("user_id") % 4).alias("group_id"), F.col("event_id").alias("n"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query
def election_terms(spark, sf):
    """C-15, W-06: sign-ups as campaigns, a quarter of the users a group."""
    return registry.elections(_campaigns(spark, sf), 7200)


@query
def quorum_write(spark, sf):
    """C-13, A-14: five replicas, the first local."""
    e = src.table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
    acks = e.select(F.col("event_id").alias("offset"), F.col("r").alias("replica_id"), (F.col("r") == 0).alias("local"), ((F.col("event_id") * 7 + F.col("r") * 13) % 5 < F.col("event_id") % 4).alias("acked"), (F.col("event_id") % 11 != 0).alias("leader"))
    return registry.quorum(acks)


@query
def replica_catch_up(spark, sf):
    """C-14, J-13: a replica for each nation."""
    source = src.table(spark, sf, "events").select((F.col("event_id") + 1).alias("offset"))
    targets = src.table(spark, sf, "nation").crossJoin(source.agg(F.expr("max(offset) div 25").alias("step"))).select(F.col("n_name").alias("replica_id"), (F.col("n_nationkey") * F.col("step")).cast("long").alias("committed"), (F.col("n_nationkey") * F.col("step") + F.col("n_nationkey") % 3).cast("long").alias("applied"))
    return registry.catch_up(source, targets, source.agg(F.expr("max(offset) * 4 div 5").alias("committed"), F.expr("max(offset) div 5").alias("floor")))


@query
def search_metrics(spark, sf):
    """A-17, A-18, X-07: hourly windows by type."""
    e = src.table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), "p95")


@query
def load_report(spark, sf):
    """A-16, F-27, F-28, C-18: latencies by type; both definitions of a percentile."""
    e = src.table(spark, sf, "events").filter("value is not null")
    # Values counted in each task first; ranks run over distinct values only.
    n = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = n.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    p = lambda q: at(F.greatest(F.ceil(F.col("n") * q), F.lit(1)))
    out = n.groupBy("event_type").agg(F.sum("c").alias("requests"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), at(F.floor(0.95 * (F.col("n") - 1) + 0.5) + 1).alias("load_p95"), F.round(F.sum(F.when(F.col("value") > 100, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("slow_share"))
    return out


@query
def benchmark_corpus_search(spark, sf):
    """C-18, O-16 in small: ten queries for all words over two hundred synthetic documents, as the DuckDB form has them."""
    return lexical.search(src.synthetic(spark, 200, 7), src.synthetic_queries(spark, 10, 200, 7), "all", 20).select("query_id", "doc_id", _r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def index_benchmark(spark, sf):
    """C-18, O-16: the reference's benchmark at its defaults, five hundred queries for all words over a million synthetic documents."""
    return lexical.search(src.synthetic(spark, 1_000_000, 20260915), src.synthetic_queries(spark, 500, 1_000_000, 20260915), "all", 20).select("query_id", "doc_id", _r6("score"), F.col("rank").cast("long").alias("rank"))


def _requests(spark, sf):
    """Every turn as a request: modes, limits and timeouts of all kinds, wrong ones too."""
    cases = _cases(spark, sf)
    k = F.pmod(F.crc32(F.encode("query_id", "UTF-8")), F.lit(7)).cast("int")
    mode = F.element_at(F.array(*map(F.lit, ("", " AUTO", "lexical", "Vector ", "hybrid", "fuzzy", "auto"))), k + 1)
    return cases.select("query_id", "text", mode.alias("mode"), (F.length("text") % 107).cast("int").alias("limit"), F.when(k == 6, -5).otherwise((F.col("deadline_ns") / 1_000_000).cast("int")).alias("timeout_ms"), "total", "available", "vector_ready")


@query
def request_modes(spark, sf):
    """P-10, F-29, C-09: requests checked, with the mode asked for or the planner's, and the mode a node runs."""
    out = requests.with_mode(requests.validated(_requests(spark, sf)), planner.priors(spark))
    return out.select("query_id", "limit", "timeout_ms", "error", "chosen", requests.node_mode(F.col("mode")).alias("node_mode"))


@query
def executor_requests(spark, sf):
    """P-15: what the executor refuses."""
    r = _requests(spark, sf).select(F.when(F.length("text") % 13 == 0, " ").otherwise(F.col("query_id")).alias("request_id"), "text", (F.col("limit") - 3).alias("limit"), "timeout_ms", F.array(F.lit(" b"), F.col("mode"), F.lit("a"), F.lit("b ")).alias("collections"), "query_id")
    return requests.executor_errors(r).select("query_id", "request_id", "limit", F.concat_ws(",", "collections").alias("collections"), "error")


@query
def planner_refusals(spark, sf):
    """F-19: requests that the planner refuses, by kind."""
    c = _cases(spark, sf).withColumn("available", (F.length("text") % 5).cast("int")).withColumn("deadline_ns", F.col("deadline_ns") - 50_000_000)
    return requests.planner_errors(c).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def _node_table(spark, sf):
    """Nodes with labels and collections; some say that they have no vectors."""
    own = src.owners(src.corpus(spark, sf)).groupBy("node_id").agg(F.collect_set("collection_id").alias("collections"))
    label = F.when(F.col("node_id") == "node-1", F.create_map(F.lit("vector"), F.lit("disabled"))).when(F.col("node_id") == "node-2", F.create_map(F.lit("zone"), F.lit("z")))
    spare = own.select(F.concat(F.lit("spare-"), "node_id").alias("node_id"), F.slice(F.array_sort("collections"), 1, 2).alias("collections"))
    return own.withColumn("labels", label).unionByName(spare.withColumn("labels", F.lit(None).cast("map<string,string>")))


@query
def node_readiness(spark, sf):
    """P-11: which nodes answer vector queries."""
    return _node_table(spark, sf).select("node_id", requests.vector_ready(F.col("labels")).alias("ready"))


@query
def collection_owners(spark, sf):
    """S-13, A-19: the first owner of each collection, and how many collections there are."""
    first = requests.first_owner(_node_table(spark, sf))
    return first.crossJoin(first.agg(F.count(F.lit(1)).alias("collections")))  # one row


WANTED = [("q1", []), ("q2", ["src1", " src2 ", "src1", ""]), ("q3", ["src0", "src4", "src9"]), ("q4", ["nowhere"]), ("q5", ["src3"])]


def _wanted(spark):
    return spark.createDataFrame(WANTED, "query_id string, collections array<string>")


@query
def catalog_nodes(spark, sf):
    """P-04, J-08: the nodes that a request goes to."""
    return requests.candidates(_node_table(spark, sf), _wanted(spark))


@query
def requested_search(spark, sf):
    """P-03, C-07: the merged ranking of the collections that a request names."""
    docs = src.corpus(spark, sf)
    hits = requests.requested_only(_lex(spark, sf, "any", 10), _wanted(spark))
    return plans.merge(plans.node_hits(hits, src.owners(docs), 10), 10).select("query_id", "collection_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def last_update(spark, sf):
    """X-03: the last of the cumulative rankings of each query, all a caller keeps that waits to the end."""
    docs, answers = _answers(spark, sf)
    steps = plans.cumulative(answers, _responses(spark, docs), 10, 100.0)
    last = steps.groupBy("query_id").agg(F.max_by(F.struct("step"), "step").alias("x")).select("query_id", F.col("x.step").alias("step"))
    return steps.join(last, ["query_id", "step"]).select("query_id", F.col("step").cast("long").alias("step"), "collection_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query
def planner_selections(spark, sf):
    """A-11, C-11: how often each strategy is chosen."""
    return planner.selections(_cases(spark, sf), planner.priors(spark))


def _policy_changes(spark, sf):
    """A policy set at each event, for four collections and some of their documents; every fifth kind is not valid."""
    e = src.table(spark, sf, "events")
    k = (F.col("event_id") % 6).cast("int")
    rule = lambda effect, action: F.struct(effect.alias("effect"), action.alias("actions"))
    acts = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("write"))).otherwise(F.array(F.lit("search"), F.lit("read")))
    rules = F.when(k == 3, F.array().cast("array<struct<effect: string, actions: array<string>>>")).otherwise(F.array(rule(F.when(k == 4, F.lit("maybe")).otherwise(F.lit("allow")), acts)))
    return e.select(F.concat(F.lit(" c"), (F.col("user_id") % 4).cast("string")).alias("collection_id"), F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id").cast("string")).alias("doc_id"), F.when(F.col("event_id") % 35 == 5, " ").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("version"), rules.alias("rules"), F.col("event_id").alias("n"))


@query
def policy_store(spark, sf):
    """O-23: the valid policy last set for each resource."""
    return policy.policy_store(_policy_changes(spark, sf)).select("collection_id", "doc_id", "version", F.size("rules").cast("long").alias("n_rules"))


@query
def policy_refusals(spark, sf):
    """P-12: policies refused, by reason."""
    return policy.policy_errors(_policy_changes(spark, sf)).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


ISSUER, AUDIENCE, SKEW = "https://issuer.example", "search", 30


@query
def token_claims(spark, sf):
    """F-30, P-05: a token a user and event, with its claims checked at one moment, and whether it may write. Signatures are not checked."""
    e = src.table(spark, sf, "events")
    now = 1_700_000_000
    k = (F.col("event_id") % 8).cast("int")
    at = lambda x: F.lit(now) + x
    aud = F.when(k == 1, F.lit('["other","search"]')).when(k == 2, F.lit('"other"')).otherwise(F.lit('"search"'))
    text = F.concat(F.lit('{"sub":"'), F.when(k == 3, F.lit(" ")).otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"))), F.lit('","iss":"https://issuer.example","aud":'), aud, F.lit(',"exp":'), at(F.col("event_id") % 100 - 60).cast("string"), F.lit(',"nbf":'), at(F.when(k == 4, F.lit(31)).otherwise(F.lit(30))).cast("string"), F.lit(',"iat":'), at(F.when(k == 5, F.lit(40)).otherwise(F.lit(-9))).cast("string"), F.lit(',"groups":["b"," a","b"],"scope":"documents.read'), F.when(F.col("user_id") % 2 == 0, F.lit(" documents.write")).otherwise(F.lit("")), F.lit('"}'))
    part = F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    token = F.when(k == 6, F.concat(F.lit("h."), part)).when(k == 7, F.lit("h.e30.s")).otherwise(F.concat(F.lit("h."), part, F.lit(".s")))
    got = requests.principals(e.select("event_id", token.alias("token")), ISSUER, AUDIENCE, now, SKEW)
    return got.select("event_id", "error", "subject", F.concat_ws(",", "groups").alias("groups"), policy.may_write(F.col("scopes")).alias("may_write"))


@query
def metric_rates(spark, sf):
    """A-18: in windows of five minutes, rates a second by type, and increases over fifteen minutes that slide by five."""
    e = src.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = lambda size: e.groupBy(F.window("t", size, "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.end").alias("until"), "event_type", "n")
    return w("15 minutes").withColumnRenamed("n", "increase").join(w("5 minutes"), ["until", "event_type"], "left").select("until", "event_type", "increase", F.round(F.coalesce("n", F.lit(0)) / 300.0, 6).alias("rate"))


@query
def graph_recall_floor(spark, sf):
    """S-03 to S-08 with an oracle: every hundredth vector was asked for, and the mean recall of the graph is 0.9 at least."""
    return graph_vector_search(spark, sf).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("floor_met"))


@query
def election_holders(spark, sf):
    """C-15: each group's holder and term in the middle of the time, and whether its lease runs then."""
    c = _campaigns(spark, sf)
    now = int(c.agg(F.expr("(min(at) + max(at)) div 2")).first()[0] or 0)
    return registry.held(registry.elections(c, 7200), c, 7200, now)


@query
def binary_log(spark, sf):
    """O-06, O-20, C-05: the log written as binary files of fifty thousand changes each, read back with all checks."""
    log = src.change_log(spark, sf)
    return changelog.decode_log(changelog.encode_log(log, 50_000)).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("collection_id"), "seq", "op", "doc_id", F.when(F.col("op") == "upsert", F.col("body")).alias("body"))


@query
def append_log(spark, sf):
    """O-07: the later half of each log, appended to the earlier one, has the numbers it had."""
    log = src.change_log(spark, sf)
    half = log.groupBy("collection_id").agg(F.expr("max(seq) div 2").alias("half"))
    cut = log.join(F.broadcast(half), "collection_id")  # four rows
    old, new = cut.filter("seq <= half").drop("half"), cut.filter("seq > half").withColumnRenamed("seq", "n").drop("half")
    return old.unionByName(changelog.append(old, new)).select("collection_id", "seq", "op", "doc_id", "body")


@query
def seed_documents(spark, sf):
    """O-17: the three documents that a demo node of each collection starts with."""
    return src.seeds(src.corpus(spark, sf).select("collection_id").distinct())


def _drained(spark, sf, flow):
    """The result of a stream over all events, once all are read."""
    schema = src.table(spark, sf, "events").schema
    out, at = fresh_folder(spark, "stream"), fresh_folder(spark, "stream-state")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    q = flow(stream).writeStream.outputMode("complete").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query
def stream_metrics(spark, sf):
    """X-07 as a stream: hourly windows."""
    return _drained(spark, sf, lambda s: flows.metric_windows(s, "1 hour")).select(F.date_format("since", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def stream_leases(spark, sf):
    """X-04 as a stream: sessions that end twelve hours after the last event of a user."""
    beats = lambda s: s.select(F.col("user_id").alias("node_id"), "ts")
    return _drained(spark, sf, lambda s: flows.heartbeat_leases(beats(s), "12 hours")).select("node_id", F.unix_micros("since").alias("since_us"), F.unix_micros("expires_at").alias("expires_us"), "beats")


__all__ = ["QUERIES", "SQL"]
