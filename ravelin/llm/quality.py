"""Document quality by hierarchical empirical Bayes.

A logistic classifier over surface features gives each document's evidence. Hosts (sources) and paths below them
(source and language) get posteriors of their share of good documents: the global share is the prior
of each host, each host's posterior that of its paths, so sparse sites stay near the level above. How many documents a
prior is worth comes from the data: by moments, from how far the groups' shares lie apart beyond what chance gives. A document's score multiplies the odds of its own evidence by how its path's
odds compare with the global ones. Features and posteriors are DataFrame expressions and grouped sums;
only the classifier's weights are fitted in numpy, on a bounded sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import first_of_each, materialize

NONE = "(none)"
#: Strength of a prior, in documents, where its groups do not differ; and paths that are broadcast at most.
MOST, SITES = 1e6, 100_000


def features() -> dict[str, Column]:
    """Surface features of `text` (never null here)."""
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("double")
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")).cast("double")
    distinct = F.size(F.array_distinct(F.filter(F.split(F.lower("text"), "[ \\t\\n\\r]+"), lambda w: w != ""))).cast("double")
    lines = F.filter(F.split("text", "\\n"), lambda w: w != "")
    return {
        "length": F.log1p(F.length("text").cast("double")),
        "upper": 1 - share("\\p{Lu}+") / n,
        "letters": 1 - share("\\p{L}+") / n,
        "digits": 1 - share("\\p{Nd}+") / n,
        "marks": 1 - share("[!?|#*<>{}=_$%&@\\\\/]+") / n,
        "stops": 1 - share("[.,;:]+") / n,
        "word": n / F.greatest(words, F.lit(1.0)),
        "distinct": distinct / F.greatest(words, F.lit(1.0)),
        "distinct_root": distinct / F.sqrt(F.greatest(words, F.lit(1.0))),
        "lines": F.size(F.array_distinct(lines)).cast("double") / F.greatest(F.size(lines), F.lit(1)),
        "line": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
    }


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on standardised features and their squares, by Newton's steps: mean, scale, weights, intercept."""
    if len(y) == 0 or y.min() == y.max():
        k = x.shape[1] * 2 if x.ndim == 2 else 0
        return np.zeros(k), np.ones(k), np.zeros(k), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
    z = np.hstack([x, x * x])
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = np.hstack([(z - mean) / scale, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w += np.linalg.solve(h, g)
    return mean, scale, w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000):
    """Fit to a bounded sample: of the rows with a quality label and a text, the first `rows` of each class by a hash of doc_id."""
    y = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = first_of_each(y, "quality", rows, "quality")
    f = features()
    got = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(first), "doc_id").select("quality", *[c.alias(k) for k, c in f.items()])  # 2 * rows numbers a feature
    pdf = got.toPandas().sort_values(list(f), kind="stable")
    return fit(pdf[list(f)].to_numpy(float).reshape(-1, len(f)), pdf["quality"].to_numpy(float))


def strengths(groups: DataFrame, given: Column, by: list[str]) -> DataFrame:
    """The documents that a prior is worth, one row for each value of by: groups (n, s, v) of n documents with sum s and v, the
    sum of squares, about the share `given` of the level above.

    By moments: within a group a document's value varies by w around the group's share, groups around `given` by b, and a prior of
    w / b documents is the best linear one. Where chance alone explains the groups, b is 0 and the strength MOST.
    """
    n, s, v = F.col("n").cast("double"), F.col("s"), F.col("v")
    d = s / n - given
    x = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("all"), F.sum(v - s * s / n).alias("within"), F.sum(n * d * d).alias("between"), F.sum(n * n).alias("squares"))
    w = F.greatest(F.col("within"), F.lit(0.0)) / F.greatest(F.col("all") - F.col("k"), F.lit(1.0))
    b = (F.col("between") - (F.col("k") - 1) * w) / F.greatest(F.col("all") - F.col("squares") / F.col("all"), F.lit(1e-9))
    return x.select(*by, F.when((b > 0) & (F.col("k") > 1), F.least(F.greatest(w / F.greatest(b, F.lit(1e-12)), F.lit(1.0)), F.lit(MOST))).otherwise(F.lit(MOST)).alias("strength"))


def score(docs: DataFrame, model, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, classifier, host_rate, path_rate and score (all 0 to 1) and keep (1 if score >= 0.5) of every whole text of docs.

    host and path name the columns of a site's levels. A null text counts as empty, null keys as the value `(none)`; repeated rows
    stay and count; equal texts of one path have equal scores; an empty table gives an empty result. Columns of other names are not read.
    Sums by host and path are made in each task first, so a host with a third of all rows is one row a task; rates are joined by a broadcast
    of at most SITES paths, of more by their keys.
    """
    mean, scale, w, c = model
    f = features()
    names = list(f)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(k).cast("string"), F.lit(NONE)).alias(a) for k, a in ((host, "_host"), (path, "_path"))], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", "_host", "_path", *[x.alias(k) for k, x in f.items()])
    logit = F.lit(float(c))
    for i, k in enumerate(names * 2 if len(w) else []):
        x = F.col(k) if i < len(names) else F.col(k) * F.col(k)
        logit = logit + (x - float(mean[i])) / float(scale[i]) * float(w[i])
    logit = F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))
    base = materialize(base.select("doc_id", "_host", "_path", (1 / (1 + F.exp(-logit))).alias("classifier")), "quality")
    rates = materialize(posteriors(base), "rates")  # a row for each path
    small = rates.limit(SITES + 1).count() <= SITES
    odds = lambda x: F.ln(F.greatest(F.col(x), F.lit(1e-9)) / F.greatest(1 - F.col(x), F.lit(1e-9)))
    out = base.join(F.broadcast(rates) if small else rates, ["_host", "_path"])
    out = out.withColumn("score", 1 / (1 + F.exp(-(odds("classifier") + odds("path_rate") - odds("prior")))))
    return out.select("doc_id", "classifier", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))


def posteriors(base: DataFrame) -> DataFrame:
    """_host, _path, prior, host_rate, path_rate of each path: base (_host, _path, classifier) summed up."""
    paths = base.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("classifier").alias("s"), F.sum(F.col("classifier") * F.col("classifier")).alias("v"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    # The global share: (sum + 1/2) / (count + 1), so that it is never 0 or 1.
    every = hosts.agg(((F.sum("s") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))
    hosts = hosts.crossJoin(every)  # one row
    hosts = hosts.crossJoin(strengths(hosts, F.col("prior"), []))  # one row
    rate = lambda prior: (F.col(prior) * F.col("strength") + F.col("s")) / (F.col("strength") + F.col("n"))
    hosts = hosts.select("_host", "prior", rate("prior").alias("host_rate"))
    paths = paths.join(hosts, "_host")
    # Paths of all hosts say together how far paths lie from their hosts; a host alone has few.
    paths = paths.crossJoin(strengths(paths, F.col("host_rate"), []))  # one row
    return paths.select("_host", "_path", "prior", "host_rate", rate("host_rate").alias("path_rate"))
