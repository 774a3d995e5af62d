"""Mixing sources to target weights by hierarchical budgeting.

The sources hang in a tree, by default domain - language - source. A token budget goes down from
the root: each node shares it among its children by weight, none beyond what its leaves can give
(their tokens times the allowed epochs); what a child can't take goes to its siblings first, and
what the whole family can't take was never given to the parent, so its siblings have it.
Each leaf then draws whole epochs and, from a seeded order, the token-prefix that is left.

Only DataFrame functions run. Rows are never gathered by leaf: tokens are summed by (leaf, first digits of
the seeded hash), which says in which of those ranges the prefix ends, and only rows of that range are put in order. What is
known of a leaf goes to its rows by a broadcast, so that a leaf with a third of all rows stays where it is; only of more than
LEAVES leaves are rows and leaves dealt out by key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import materialize

WORDS = "[^ \\t\\n\\x0B\\f\\r]+"
LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Leaves that are broadcast at most, a few numbers and names each.
LEAVES = 50_000


def domain_of(source: str = "source") -> Column:
    """The default domain of a source: one of four, by its digest."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(NONE)).cast("binary")), 1, 2), 16, 10).cast("int") % 4).cast("string"))


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    w = F.lit(1.0)
    for value, x in (weights.get(level) or {}).items():
        w = F.when(F.col(level) == value, F.lit(float(x))).otherwise(w)
    return w


def fill(children: DataFrame, parents: list[str]) -> DataFrame:
    """Share `budget` among the rows of equal parents by w, none beyond cap: adds `share`.

    By the level at which children stand full: in the order of cap / w, the first child that the even level of
    what is left doesn't fill gives the level of it and of all after it.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("r", "node")
    x = children.filter((F.col("w") > 0) & (F.col("cap") > 0)).withColumn("r", F.col("cap") / F.col("w"))
    x = x.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    x = x.withColumn("after", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.col("budget") - F.col("before")) / F.col("after"))
    x = x.withColumn("level", F.first(F.when(F.col("level") <= F.col("r"), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.withColumn("share", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))).drop("r", "before", "after", "level")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], fraction: float, epochs: int) -> DataFrame:
    """leaves (levels, tokens) with `target`: tokens to draw, of a budget of `fraction` of all tokens."""
    levels = list(levels)
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    given = None
    for k in range(1, len(levels) + 1):
        nodes = leaves.groupBy(*levels[:k]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("w", _weight(levels[k - 1], weights)).withColumn("node", F.col(levels[k - 1]))
        if given is None:
            total = leaves.agg(F.floor(F.sum(F.col("tokens").cast("double")) * fraction).cast("double").alias("budget"))
            nodes = nodes.crossJoin(total)  # one row
        else:
            nodes = nodes.join(given, levels[: k - 1])
        given = fill(nodes, levels[: k - 1]).select(*levels[:k], F.col("share").alias("budget"))
    return leaves.join(given, levels).select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("target"))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None, fraction: float = 0.5, epochs: int = 2, seed: int = 0, levels: Sequence[str] = LEVELS, domain: Column | None = None, key: str | None = None) -> DataFrame:
    """What to draw of each document: doc_id, the levels, n_tokens (words), copies (whole) and tokens (of all copies and of
    the document in which the prefix ends). Only documents with tokens to draw are returned.

    weights: for each level, the weights of its values; 1 for those not named, 0 draws nothing.
    Null keys count as the value `(none)`; a null text has no tokens and is never drawn; repeated rows
    count as rows of their own; an empty table gives an empty result. Ties of the seeded hash go by doc_id and tokens. key: a column that
    tells rows apart, returned as well. `domain` comes from the source (or is the column given), whatever column of that name docs has.
    """
    levels, keys = list(levels), [key] if key else []
    if len({*levels, *keys, "doc_id", "n_tokens", "copies", "tokens"}) < len(levels) + len(keys) + 4:
        raise ValueError("levels and key are other columns than doc_id, n_tokens, copies and tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = docs.withColumn("domain", domain if domain is not None else domain_of()).select(
        *keys,
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels],
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"),
    )
    meta = materialize(meta.filter("n_tokens > 0"), "mix")
    leaves = materialize(meta.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    near = F.broadcast if leaves.limit(LEAVES + 1).count() <= LEAVES else lambda x: x
    plan = budgets(leaves, levels, weights or {}, fraction, epochs)
    plan = plan.withColumn("full", F.expr("target div tokens")).withColumn("rest", F.expr("target % tokens")).select(*levels, "full", "rest")
    rows = meta.join(near(materialize(plan, "plan")), levels)
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).cast("binary"))).withColumn("b", F.substring("h", 1, 4))
    sums = rows.groupBy(*levels, "b").agg(F.sum("n_tokens").alias("s"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("to", F.sum("s").over(run)).withColumn("from", F.col("to") - F.col("s")).filter((F.col("from") < F.col("rest")) & (F.col("rest") <= F.col("to"))).select(*levels, F.col("b").alias("edge"), "from")
    rows = rows.join(near(materialize(ends, "ends")), levels, "left")
    inner = rows.filter(F.coalesce(F.col("b") != F.col("edge"), F.lit(True))).withColumn("part", F.when(F.col("b") < F.col("edge"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy(*levels).orderBy("h", "doc_id", "n_tokens", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.filter(F.col("b") == F.col("edge"))
    edge = edge.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), F.col("rest") - F.col("from") - F.sum("n_tokens").over(order) + F.col("n_tokens"))))
    cols = [*keys, "doc_id", *levels, "n_tokens", (F.col("full") + (F.col("part") == F.col("n_tokens")).cast("long")).alias("copies"), (F.col("full") * F.col("n_tokens") + F.col("part")).alias("tokens")]
    return inner.select(*cols).unionByName(edge.select(*cols)).filter("tokens > 0")
