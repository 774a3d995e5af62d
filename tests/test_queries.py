"""Each query of the catalogue against its DuckDB form, and operators on small tables with known answers."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin import catalogue
from ravelin.functions.hashing import fnv1a, hmac_sha256
from ravelin.functions.text import query_features, snippet, tokens
from ravelin.operators import changelog, fusion, lexical, planner, policy, registry, vector
from ravelin.streaming import flows

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{sf}/{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert rows or name in ("authorized_search", "audit_prefix")
    if name in catalogue.SQL:
        got = duck.execute(f"select {', '.join(map('"{}"'.format, cols))} from ({catalogue.SQL[name]})").fetchall()
        assert rows == Counter(tuple(map(plain, r)) for r in got)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_words(spark):
    t = lambda s, nfkc=False: one(spark, tokens(F.lit(s), nfkc))[0]
    assert t("Straße, ΣΊΣΥΦΟΣ İx") == ["straße", "σίσυφοσ", "ix"]
    assert t("Ａ½", True) == ["a1", "2"] and t("Ａ½") == ["ａ½"]
    assert t("--- ") == [] and one(spark, tokens(F.lit(None).cast("string")))[0] is None


def test_hashes(spark):
    assert one(spark, fnv1a(F.lit("")))[0] % 2**64 == 0xCBF29CE484222325
    assert one(spark, fnv1a(F.lit("a")))[0] % 2**64 == 0xAF63DC4C8601EC8C
    assert one(spark, hmac_sha256(b"key", F.lit("The quick brown fox jumps over the lazy dog")))[0] == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"


def test_snippet_and_features(spark):
    assert one(spark, snippet(F.lit(" a \n b ")))[0] == "a b"
    assert one(spark, snippet(F.lit("x" * 181)))[0] == "x" * 180 + "…"
    f = lambda q: one(spark, *[c.alias(k) for k, c in query_features(F.lit(q)).items()]).asDict()
    assert f('say "this" now')["quoted"] and not f('say "" now')["quoted"]
    assert f("AB-12")["id_like"] and not f("ab12")["id_like"]
    assert f("How it works")["natural"] and f("it works?")["natural"] and not f("it works")["natural"]


def test_ranking(spark):
    docs = spark.createDataFrame([("c", "2", "local search", "private"), ("c", "1", "local search", "private"), ("c", "3", "", "local things"), ("c", "4", "", "")], "collection_id string, doc_id string, title string, body string")
    q = spark.createDataFrame([("q", "Local local SEARCH")], "query_id string, text string")
    assert [(r["doc_id"], r["rank"]) for r in lexical.search(docs, q).orderBy("rank").collect()] == [("1", 1), ("2", 2), ("3", 3)]
    assert {r["doc_id"] for r in lexical.search(docs, q, "all").collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        lexical.search(docs, q, "some")


def test_fusion_counts_skipped_positions(spark):
    lists = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "", 3), ("a", "y", 4), ("b", "y", 1)], "list string, doc_id string, rank int").withColumn("q", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in fusion.fuse(lists, ["q"]).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 64 + 1 / 61) and len(got) == 2


def test_graph_recall(spark):
    import numpy as np

    x = np.random.default_rng(7).normal(size=(600, 24))
    items = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "doc_id string, vector array<float>")
    q = items.limit(30).select(F.col("doc_id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["doc_id"]) for r in vector.top_k(items, q, 10).collect()}
    for size in (600, 150):
        found = {(r["query_id"], r["doc_id"]) for r in vector.graph_top_k(items, q, 10, size=size).collect()}
        assert len(exact & found) >= 0.9 * len(exact) == 270


def test_policy_reasons(spark):
    rules = [("allow", ["search"], [], ["eng"], ["s"]), ("deny", ["search"], ["eve"], [], [])]
    policies = spark.createDataFrame([("c", None, rules), ("c", "d", [("allow", ["search"], ["ann"], [], [])])], f"collection_id string, doc_id string, rules {policy.RULE}")
    asked = [("c", "d", "ann", ["eng"], ["s"]), ("c", "d", "bob", ["eng"], ["s"]), ("c", "e", "eve", ["eng"], ["s"]), ("x", "d", "ann", ["eng"], ["s"]), ("c", "e", " ", ["eng"], ["s"])]
    df = spark.createDataFrame(asked, "collection_id string, doc_id string, subject string, groups array<string>, scopes array<string>").withColumn("action", F.lit("search"))
    got = {(r["collection_id"], r["doc_id"], r["subject"]): r["reason"] for r in policy.decide(df, policies).collect()}
    assert list(map(got.get, [a[:3] for a in asked])) == ["policy_allowed", "document_policy_denied", "collection_policy_denied", "collection_default_deny", "unauthenticated"]


def test_planner_window(spark):
    obs = spark.range(300).select(F.lit("lexical").alias("strategy"), F.col("id").alias("arrival"), (F.col("id") + 1).alias("latency_ns"), F.lit(0.5).alias("quality"))
    r = planner.snapshot(obs, planner.priors(spark)).filter("strategy = 'lexical'").first()
    assert (r["samples"], r["p95_ns"]) == (256, 288)


def test_log_frames(spark):
    data = changelog.frame(1, 1, b"a") + changelog.frame(2, 1) + changelog.frame(1, 2, b"torn")[:-1]
    assert changelog.crc32c(b"123456789") == 0xE3069283
    rows = changelog.decode_frames(spark.createDataFrame([("p", data)], "path string, content binary")).collect()
    assert [(r["kind"], r["seq"], bytes(r["payload"])) for r in rows] == [(1, 1, b"a"), (2, 1, b"")]


def test_compaction_keeps_the_latest_of_all_generations(spark, sf, tmp_path):
    rows = [("c", "d", "upsert", g, "x", g) for g in range(1, 6)] + [("c", "e", "upsert", 6, "x", 3), ("c", "e", "delete", 7, None, 4), ("c", "f", "delete", 8, None, 3), ("c", "f", "upsert", 9, "x", 4)]
    seg = spark.createDataFrame(rows, "collection_id string, doc_id string, op string, seq long, body string, generation long")
    path = str(tmp_path / "segments")
    assert changelog.publish_all(seg, path) == 5 and changelog.generations(spark, path) == [1, 2, 3, 4, 5]
    got = changelog.compact(changelog.read_segments(spark, path), 2).collect()
    assert sorted((r["doc_id"], r["op"], r["seq"], r["generation"]) for r in got) == [("d", "upsert", 5, 6), ("f", "upsert", 9, 6)]
    assert changelog.publish(seg.filter("generation = 5").drop("generation"), path) == 6
    with pytest.raises(ValueError):
        changelog.publish_all(seg.unionByName(seg), path)
    want = catalogue.QUERIES["segment_documents"](spark, sf)
    top = catalogue._segments(spark, sf).agg(F.max("generation")).first()[0]
    key = lambda df: sorted((r["collection_id"], r["doc_id"], r["seq"]) for r in df.collect())
    got = catalogue.QUERIES["segment_compact"](spark, sf)
    assert top > 3 and key(got) == key(want) and {r["generation"] for r in got.collect()} == {top + 1}


def test_index_benchmark_has_the_reference_defaults(spark, sf):
    """The result's size, from the reference's arithmetic in plain Python."""
    n, seed = 1_000_000, 20260915
    terms = lambda i: ((i * 104729 + seed) % 4096, (i * 65537 + seed * 3) % 256)
    of = Counter(map(terms, range(n)))
    want = {str(k): min(20, of[terms((k * 7919 + seed) % n)]) for k in range(500)}
    assert Counter(r["query_id"] for r in catalogue.QUERIES["index_benchmark"](spark, sf).collect()) == want


def test_binary_log(spark):
    s = lambda *x: b"".join(bytes([len(v)]) + v for v in x)
    up, down, commit = changelog.frame(1, 8, s(b"d", b"t", b"b")), changelog.frame(2, 9, s(b"d")), changelog.frame(3, 8)
    head = changelog.log_header(7)
    rows = changelog.decode_log(spark.createDataFrame([("p", head + up + commit + down + up[:-1])], "path string, content binary")).collect()
    assert [tuple(r) for r in rows] == [("p", 8, "upsert", "d", "t", "b", 8), ("p", 9, "delete", "d", None, None, 8)]
    long = bytes([200, 1]) + b"x" * 200
    assert changelog.scan_log(head + changelog.frame(2, 8, long))[0][0][2] == "x" * 200
    bad = [b"", b"X" + head[1:], head[:9] + b"\2" + head[10:], head[:11] + b"\0" + head[12:], head + down, head + up + up, head + commit, head + up + commit + changelog.frame(3, 7), head + changelog.frame(4, 8), head + changelog.frame(1, 8, s(b"d")), head + changelog.frame(2, 8, s(b"d", b"e")), head + changelog.frame(2, 8, s(b" ")), head + bytes(8), head + up[:-1] + b"z"]
    for data in bad:
        with pytest.raises(ValueError):
            changelog.scan_log(data)


def test_append_and_replayed_batches(spark):
    log = spark.createDataFrame([("c", 4, "upsert", "d", "x")], "collection_id string, seq long, op string, doc_id string, body string")
    new = spark.createDataFrame([("c", 2, "delete", "d", None), ("c", 1, "upsert", "e", "y"), ("k", 1, "upsert", "d", "z")], "collection_id string, n long, op string, doc_id string, body string")
    more = changelog.append(log, new)
    assert sorted((r["collection_id"], r["seq"], r["op"], r["doc_id"]) for r in more.collect()) == [("c", 5, "upsert", "e"), ("c", 6, "delete", "d"), ("k", 1, "upsert", "d")]
    state = {}
    merge = flows.replay_batches(lambda: state.get("t"), lambda df: state.update(t=spark.createDataFrame(df.collect(), df.schema)))
    got = []
    for k, batch in enumerate((log, more, more)):
        merge(batch, k)
        got.append(sorted((r["collection_id"], r["doc_id"], r["seq"], r["op"]) for r in state["t"].collect()))
    assert got[1] == got[2] == [("c", "d", 6, "delete"), ("c", "e", 5, "upsert"), ("k", "d", 1, "upsert")]


def test_lease_ends_and_comes_back(spark):
    e = spark.createDataFrame([("n", 0, 1, "register"), ("n", 10, 2, "heartbeat"), ("n", 30, 3, "heartbeat"), ("m", 0, 4, "register"), ("m", 5, 5, "deregister")], "node_id string, at long, n long, kind string")
    assert [(r["node_id"], r["expires_at"]) for r in registry.active(e, 15, 20).collect()] == [("n", 25)]
    assert registry.active(e, 15, 31).count() == 0


def test_entry_points_without_the_corpus_package(tmp_path):
    """The rest imports when the corpus operators are gone."""
    import shutil

    shutil.copytree(ROOT / "ravelin", tmp_path / "ravelin", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), bool(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.strip() == "True True", out.stderr
