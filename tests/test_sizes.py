"""What grows with the input, and what must not."""

import os
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ravelin import catalogue
from ravelin.operators import changelog, evaluate, requests, vector


def test_generations_share_files(spark, tmp_path):
    """Folders and files are as many as tasks, not as generations; later ones and single ones go on from them."""
    path = str(tmp_path / "segments")
    seg = spark.range(2000).select(F.lit("c").alias("collection_id"), F.col("id").cast("string").alias("doc_id"), F.lit("upsert").alias("op"), F.col("id").alias("seq"), F.lit("x").alias("body"), F.expr("2 * (id div 10) + 1").alias("generation"))
    assert changelog.publish_all(seg, path) == 399
    assert len([f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]) <= 4 and len(os.listdir(path)) == 1
    assert changelog.generations(spark, path) == list(range(1, 400, 2))
    assert changelog.publish(seg.filter("generation = 1").drop("generation"), path) == 400
    assert changelog.publish_all(seg.filter("generation < 4"), path) == 403
    assert changelog.generations(spark, path) == [*range(1, 400, 2), 400, 401, 403]
    read = changelog.read_segments(spark, path)
    assert read.count() == 2030 and read.filter("generation = 400").count() == 10
    assert not [n for n in os.listdir(path) if n.startswith("aside")]


def test_claims_are_parsed_once(spark, sf):
    plan = catalogue.QUERIES["token_claims"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # the claims, and an audience that is a list


def test_tokens_of_other_shapes(spark):
    """Without a dot, null, not base64, with an audience that only looks like a list."""
    import base64
    import json

    claims = lambda aud: "h." + base64.urlsafe_b64encode(json.dumps({"sub": "u", "iss": "i", "aud": aud, "exp": 100, "groups": [" b", "a", "b", ""], "scope": "x  y"}).encode()).decode().rstrip("=") + ".s"
    rows = [(0, "nothing"), (1, None), (2, "h.%%%.s"), (3, claims("s")), (4, claims(["o", "s"])), (5, claims("[s")), (6, claims("o")), (7, claims(None))]
    got = requests.principals(spark.createDataFrame(rows, "n int, token string"), "i", "s", 50).orderBy("n").collect()
    assert [r["n"] for r in got if r["error"] is None] == [3, 4] and {r["error"] for r in got} == {None, "invalid token"}
    assert [(r["subject"], r["groups"], r["scopes"]) for r in got[3:5]] == [("u", ["a", "b"], ["x", "y"])] * 2


def test_graph_finds_copies_and_what_is_far(spark):
    """One vector six hundred times, at other lengths too, among wide vectors without clusters: every query has its neighbours, copies by id."""
    x = np.random.default_rng(3).normal(size=(4000, 64))
    x[::7] = x[0]
    x[::21] *= 2
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)]
    items = spark.createDataFrame([*rows, ("zero", [0.0] * 64), ("none", None), ("nan", [float("nan")] * 64)], "doc_id string, vector array<double>")
    q = items.filter("doc_id like '%50' or doc_id like '%00' or doc_id in ('zero', 'none')").select(F.col("doc_id").alias("query_id"), "vector")
    got = {r["query_id"]: r["recall"] for r in evaluate.recall(vector.top_k(items, q, 10), vector.graph_top_k(items, q, 10), 10).collect()}
    assert len(got) == 80 and sum(got.values()) >= 0.95 * 80
    assert {got[f"{i:05d}"] for i in range(0, 4000, 350)} == {1.0}


def test_cosines_in_memory_are_bounded(monkeypatch):
    """Eight thousand queries by four thousand items, without all products at once, and with the same result however they are cut."""
    rng = np.random.default_rng(5)
    m, x = rng.normal(size=(8192, 16)), rng.normal(size=(4096, 16))
    m, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (m, x))
    x[::5] = x[0]
    names = np.array([f"{i:04d}" for i in range(len(x))], object)
    tracemalloc.start()
    best = vector._Best(10, len(m))
    best.add(m, x[:3000], names[:3000])
    best.add(m, x[3000:], names[3000:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # all cosines are 268 MB, and there were five such arrays
    some = rng.choice(len(m), 50, replace=False)
    key = np.round(m[some] @ x.T, 9)
    for q, row in zip(some, key, strict=True):
        assert best.names[best.rows == q].tolist() == [names[i] for i in np.lexsort((names.astype(str), -row))[:10]]
    monkeypatch.setattr(vector, "TILE", 1000)
    again = vector._Best(10, 50)
    again.add(m[:50], x, names)
    keep = best.rows < 50
    assert again.names.tolist() == best.names[keep].tolist()


def test_words_of_texts_are_folded_by_character():
    """The quick way for each text gives what one character at a time gives, for every character and beside sigma and dotted I."""
    slow = lambda t: vector.WORDS.findall("".join("i" if c == "İ" else c.lower() for c in t))
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    texts = ["", "A-b_C 9z\x85", "\x00\x1c\x1f a\tB", bytes(range(128)).decode(), "ΟΔΥΣΣΕΥΣ ΑΣ. İIıİ ÀΣ", every, every[::-1], "Σ".join(every[:3000])]
    for t in texts:
        assert vector.text_words(t) == slow(t)


def test_texts_are_embedded_once(spark, sf):
    plan = catalogue.QUERIES["hash_embed_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_postings_are_not_dealt(spark, sf):
    """No exchange by document and term: what goes over the network is whole texts and counts of terms."""
    plan = catalogue.QUERIES["doc_frequency"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and not any("doc_id" in line and "term" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)
