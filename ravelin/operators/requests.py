"""What a search request must be, which mode it gets, which nodes serve it, and what a token's claims must say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.text import clean_list
from ravelin.operators import planner

MODES = ("lexical", "vector", "hybrid")
LIMIT, MOST = 10, 100
TIMEOUT_MS, MOST_MS = 1500, 10_000


def first_error(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that is broken, null if none is. A rule is (broken, text)."""
    out = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), text).otherwise(out)
    return out


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def validated(requests: DataFrame) -> DataFrame:
    """requests (text, mode, limit, timeout_ms) trimmed, with defaults for a limit or timeout of 0, and `error`."""
    mode = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    out = requests.withColumns({"text": F.trim("text"), "mode": F.when(mode == "", "auto").otherwise(mode), "limit": F.when(F.coalesce("limit", F.lit(0)) == 0, LIMIT).otherwise(F.col("limit")), "timeout_ms": F.when(F.coalesce("timeout_ms", F.lit(0)) == 0, TIMEOUT_MS).otherwise(F.col("timeout_ms"))})
    error = first_error(
        (blank(F.col("text")), "query is required"),
        (~F.col("limit").between(1, MOST), f"limit must be between 1 and {MOST}"),
        (~F.col("timeout_ms").between(1, MOST_MS), f"timeout must be between 1 and {MOST_MS} milliseconds"),
        (~F.col("mode").isin("auto", *MODES), "mode must be auto, lexical, vector, or hybrid"),
    )
    return out.withColumn("error", error)


def vector_ready(labels: Column) -> Column:
    """Whether a node with these labels answers vector queries: one that says nothing does."""
    return F.coalesce(labels["vector"], F.lit("")) != "disabled"


def with_mode(requests: DataFrame, base: DataFrame) -> DataFrame:
    """Validated requests (query_id, text, mode, timeout_ms, error, total, available, vector_ready) with `chosen`: a mode that was
    asked for, or the planner's choice for auto; null where there is an error."""
    auto = requests.filter(F.col("error").isNull() & (F.col("mode") == "auto")).withColumn("deadline_ns", F.col("timeout_ms").cast("long") * 1_000_000)
    picked = planner.select(auto, base).select("query_id", "strategy")
    out = requests.join(picked, "query_id", "left")
    return out.withColumn("chosen", F.when(F.col("error").isNull(), F.coalesce("strategy", "mode"))).drop("strategy")


def node_mode(mode: Column) -> Column:
    """The mode a node runs: auto is hybrid there; an unset or unknown one is refused (null)."""
    m = F.lower(F.trim(mode))
    return F.when(m.isin(*MODES), m).when(m == "auto", "hybrid")


def planner_errors(requests: DataFrame) -> DataFrame:
    """requests (text, deadline_ns, total, available, vector_ready) with `error`, as the planner refuses them."""
    total, here, ready = F.col("total"), F.col("available"), F.col("vector_ready")
    health = (total <= 0) | (here < 0) | (here > total) | (ready < 0) | (ready > here)
    return requests.withColumn("error", first_error((blank(F.col("text")), "query is required"), (F.col("deadline_ns") <= 0, "query deadline must be positive"), (health, "invalid node health")))


def executor_errors(requests: DataFrame) -> DataFrame:
    """requests (request_id, text, limit, timeout_ms, collections) trimmed, collections cleaned and sorted, with `error`."""
    out = requests.withColumns({"request_id": F.trim("request_id"), "text": F.trim("text"), "collections": clean_list(F.col("collections"), True)})
    return out.withColumn("error", first_error((blank(F.col("request_id")), "request ID is required"), (blank(F.col("text")), "query text is required"), (F.col("limit") <= 0, "result limit must be positive"), (F.col("timeout_ms") < 0, "query timeout cannot be negative")))


def serves(collection: Column, requested: Column) -> Column:
    """Whether a request for these collections, or for none in particular, takes this one."""
    return (F.size(requested) == 0) | F.array_contains(F.transform(requested, lambda c: F.trim(c)), collection)


def requested_only(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """hits (query_id, collection_id, ...) of collections that their request (query_id, collections) takes."""
    return hits.join(requests.select("query_id", "collections"), "query_id").filter(serves(F.col("collection_id"), F.col("collections"))).drop("collections")


def candidates(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, node_id): nodes (node_id, collections) that own a requested collection; all for a request of none. By an equi-join on
    collections, so requests meet only nodes that serve them."""
    want = requests.select("query_id", clean_list(F.col("collections")).alias("w"))
    owned = nodes.select("node_id", F.explode(clean_list(F.col("collections"))).alias("c"))
    some = want.select("query_id", F.explode("w").alias("c")).join(owned, "c").select("query_id", "node_id").distinct()
    every = want.filter(F.size("w") == 0).select("query_id").crossJoin(nodes.select("node_id"))  # these ask every node
    return some.unionByName(every)


def first_owner(nodes: DataFrame) -> DataFrame:
    """(collection_id, node_id): the node of least id of each collection."""
    return nodes.select("node_id", F.explode(clean_list(F.col("collections"))).alias("collection_id")).groupBy("collection_id").agg(F.min("node_id").alias("node_id"))


CLAIMS = "sub string, iss string, aud string, exp long, nbf long, iat long, groups array<string>, scope string"


def principals(tokens: DataFrame, issuer: str, audience: str, now: int, skew: int = 30) -> DataFrame:
    """tokens (token: header.claims.signature in URL base64) with subject, groups, scopes and error. Signatures are not checked here.

    Issuer, audience (a name or a list of names) and subject must be right; now, in seconds, must be before the end and not
    before the beginning or the issue, each give or take skew.
    """
    # Each step is a generator of one row: as plain columns, the optimiser would put a copy of the whole parse wherever a claim is used.
    once = lambda df, x, name: df.select("*", F.explode(F.array(x)).alias(name))
    parts = once(tokens, F.split("token", "\\."), "_parts")
    part = F.get("_parts", F.lit(1))
    text = F.try_to_binary(F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), "="), F.lit("base64"))
    read = once(parts, F.from_json(F.try_validate_utf8(text.cast("string")), CLAIMS), "_claims")
    c = F.col("_claims")
    listed = F.when(F.ltrim(c["aud"]).startswith("["), F.from_json(c["aud"], "array<string>"))  # a plain name would be parsed by way of an exception
    heard = F.coalesce(F.array_contains(listed, audience), F.lit(False)) | (c["aud"] == audience)
    zero = lambda x: F.coalesce(c[x], F.lit(0))
    error = first_error(
        (F.size("_parts") != 3, "invalid token"),
        (c.isNull() | ~F.coalesce((c["iss"] == issuer) & heard, F.lit(False)) | blank(c["sub"]), "invalid token"),
        ((zero("exp") == 0) | (zero("exp") + skew <= now), "token expired"),
        ((zero("nbf") != 0) & (zero("nbf") > now + skew), "invalid token"),
        ((zero("iat") != 0) & (zero("iat") > now + skew), "invalid token"),
    )
    empty = F.array().cast("array<string>")
    judged = once(read, error, "error")
    ok = F.col("error").isNull()
    groups = F.when(ok, clean_list(F.coalesce(c["groups"], empty), True)).otherwise(empty)
    scopes = F.when(ok, clean_list(F.split(F.coalesce(c["scope"], F.lit("")), "\\s+"), True)).otherwise(empty)
    return judged.select(*tokens.columns, "error", F.when(ok, F.trim(c["sub"])).alias("subject"), groups.alias("groups"), scopes.alias("scopes"))
