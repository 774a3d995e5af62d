"""Posteriors against sums in plain Python, edge cases, and a figure on documents that were not learned from."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, classifier string"


def strength(groups, given):
    """The same moments from lists of values."""
    k, n = len(groups), sum(map(len, groups))
    within = sum((x - sum(g) / len(g)) ** 2 for g in groups for x in g)
    w = within / max(n - k, 1)
    b = (sum(len(g) * (sum(g) / len(g) - p) ** 2 for g, p in zip(groups, given, strict=True)) - (k - 1) * w) / max(n - sum(len(g) ** 2 for g in groups) / n, 1e-9)
    return min(max(w / max(b, 1e-12), 1.0), quality.MOST) if b > 0 and k > 1 else quality.MOST


def rates(rows):
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x)
        paths[h, p].append(x)
    prior = (sum(x for *_, x in rows) + 0.5) / (len(rows) + 1)
    a = strength(list(hosts.values()), [prior] * len(hosts))
    top = {h: (prior * a + sum(g)) / (a + len(g)) for h, g in hosts.items()}
    b = strength(list(paths.values()), [top[h] for h, _ in paths])
    return {(h, p): (prior, top[h], (top[h] * b + sum(g)) / (b + len(g))) for (h, p), g in paths.items()}


def test_posteriors_by_hand(spark):
    for rows in ([(f"h{i % 7}", f"p{i % 3}", (i * i % 11) / 11 if i % 7 < 4 else 0.9) for i in range(400)] + [("sparse", "p", 0.0)], [("h", "p", 0.25)] * 3, [("a", "p", 0.5), ("b", "p", 0.5)]):
        got = quality.posteriors(spark.createDataFrame(rows, "_host string, _path string, classifier double")).collect()
        want = rates(rows)
        assert {(r["_host"], r["_path"]): pytest.approx((r["prior"], r["host_rate"], r["path_rate"]), rel=1e-6) for r in got} == want


def test_sparse_sites_stay_near_the_level_above(spark):
    rows = [(f"h{h}", "p", float(i % 10 < h)) for h in range(10) for i in range(200)] + [("new", "p", 1.0)]
    got = {r["_host"]: r["host_rate"] for r in quality.posteriors(spark.createDataFrame(rows, "_host string, _path string, classifier double")).collect()}
    assert abs(got["h9"] - 0.9) < 0.01 and 0.45 < got["new"] < 0.75


def test_nulls_repeats_ties_and_empty_tables(spark):
    rows = [(1, "Some text. Good.", "s", "en"), (1, "Some text. Good.", "s", "en"), (None, None, None, None), (2, "", None, "en"), (3, "w " * 30_000, "s", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r[c] <= 1 for r in got for c in ("classifier", "host_rate", "path_rate", "score"))
    assert len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert quality.score(docs.limit(0), quality.learn(docs, labels.limit(0))).count() == 0


def test_held_out_documents(spark, sf):
    """Fitted on labels of one half, judged on the other."""
    base = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit("half")) > 0
    got = quality.score(docs, quality.learn(docs, labels.filter(half))).join(labels.filter(~half), "doc_id").select("quality", "keep", "score").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    right = ((got.keep == 1) == (got.quality == 1)).mean()
    print("AUC", auc, "right", right, len(got))
    assert auc > 0.8
