"""Authorization: collection and document policies, decisions, keyed audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.hashing import hmac_sha256

RULE = "array<struct<effect: string, actions: array<string>, subjects: array<string>, groups: array<string>, scopes: array<string>>>"


def _verdicts(asked: DataFrame, policies: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each (keys, principal, action) the policy's allow and deny matches. Rules are theta-joined to the few distinct
    askings, never to candidates."""
    rules = policies.select(*keys, F.explode("rules").alias("r"))
    who = asked.select(*keys, "subject", "groups", "scopes", "action").distinct()
    r = F.col("r")
    fits = F.array_contains(r["actions"], F.col("action")) & (F.size(F.array_except(r["scopes"], "scopes")) == 0)
    fits &= ((F.size(r["subjects"]) == 0) & (F.size(r["groups"]) == 0)) | F.array_contains(r["subjects"], F.col("subject")) | F.arrays_overlap(r["groups"], "groups")
    got = who.join(rules, keys).groupBy(*keys, "subject", "groups", "scopes", "action")
    return got.agg((F.bool_or(fits & (r["effect"] == "allow")) & ~F.bool_or(fits & (r["effect"] == "deny"))).alias(name))


def decide(asked: DataFrame, policies: DataFrame) -> DataFrame:
    """asked (collection_id, doc_id, subject, groups, scopes, action) with allowed and reason.

    policies (collection_id, doc_id, rules): a null doc_id is the collection's policy. The collection's must allow, and
    so must the document's if it has one; a deny that matches overrides. Without a subject nothing is looked up.
    """
    who = ["subject", "groups", "scopes", "action"]
    coll = _verdicts(asked, policies.filter("doc_id is null").drop("doc_id"), ["collection_id"], "c")
    doc = _verdicts(asked, policies.filter("doc_id is not null"), ["collection_id", "doc_id"], "d")
    out = asked.join(coll, ["collection_id", *who], "left").join(doc, ["collection_id", "doc_id", *who], "left")
    reason = (
        F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", "unauthenticated")
        .when(F.col("c").isNull(), "collection_default_deny")
        .when(~F.col("c"), "collection_policy_denied")
        .when(F.col("d").isNotNull() & ~F.col("d"), "document_policy_denied")
        .otherwise("policy_allowed")
    )
    return out.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "policy_allowed").drop("c", "d")


def authorized_prefix(decided: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The ranked candidates that a walk looks at before it has `limit` allowed ones, with the rank among those allowed.

    The first `limit` allowed ranks of each list come from a window that tasks cut down before the shuffle; a list of them is a row, and what
    lies beyond the last of `limit` is left out.
    """
    first = decided.filter("allowed").select(*by, "rank").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("r") <= limit)
    ends = first.groupBy(*by).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # at most `limit` numbers
    out = decided.join(ends, by, "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    out = out.withColumn("given", F.size(F.filter("ranks", lambda x: x <= F.col("rank"))))
    return out.filter((F.size("ranks") < limit) | (F.col("rank") <= F.element_at("ranks", -1))).drop("ranks")


ACTIONS, EFFECTS = ("search", "read"), ("allow", "deny")


def policy_errors(policies: DataFrame) -> DataFrame:
    """policies (collection_id, doc_id, version, rules) with trimmed ids and `error`: a collection, a version and a rule at least; rules
    of known effects with known actions, one at least. A null doc_id is a collection's policy; a blank one is an error."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lambda f: F.exists("rules", f)
    error = (
        F.when(empty(F.col("collection_id")) | (F.col("doc_id").isNotNull() & empty(F.col("doc_id"))), "id is required")
        .when(empty(F.col("version")), "policy version is required")
        .when(F.coalesce(F.size("rules"), F.lit(0)) < 1, "policy must contain at least one rule")
        .when(bad(lambda r: ~F.coalesce(r["effect"].isin(*EFFECTS), F.lit(False))), "policy rule has an invalid effect")
        .when(bad(lambda r: F.coalesce(F.size(r["actions"]), F.lit(0)) < 1), "policy rule must contain an action")
        .when(bad(lambda r: F.exists(r["actions"], lambda a: ~a.isin(*ACTIONS))), "policy rule has an invalid action")
    )
    return policies.withColumns({"collection_id": F.trim("collection_id"), "doc_id": F.trim("doc_id")}).withColumn("error", error)


def policy_store(changes: DataFrame) -> DataFrame:
    """(collection_id, doc_id, version, rules): the last valid policy set for each resource; changes have its order n as well."""
    ok = policy_errors(changes).filter("error is null")
    return ok.groupBy("collection_id", "doc_id").agg(F.max_by(F.struct("version", "rules"), "n").alias("p")).select("collection_id", "doc_id", "p.version", "p.rules")


def may_write(scopes: Column) -> Column:
    return F.coalesce(F.array_contains(scopes, "documents.write"), F.lit(False))


def audit(decided: DataFrame, key: bytes) -> DataFrame:
    """Decisions with subject and resource as keyed digests only."""
    resource = F.concat(F.trim("collection_id"), F.lit("\0"), F.trim("doc_id"))
    return decided.select("action", "allowed", "reason", hmac_sha256(key, F.col("subject")).alias("subject_hash"), hmac_sha256(key, resource).alias("resource_hash"))
