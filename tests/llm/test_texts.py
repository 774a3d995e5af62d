"""Encoding, language, media, fingerprints, archive, toxicity and substring dedup on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import base64
import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from ravelin.llm import bpe, fingerprint, langid, media, mixing, quality, queries, substring, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, run string"
ODD = [(1, None), (2, ""), (3, " "), (4, "it's we'll  they'Ve\n\n  x1y22 ½"), (5, "a" * 3000 + "é" * 500), (6, "same"), (6, "same"), (None, "no id"), (7, "\U0001f600 日本語 'sd 'll'"), (8, "ab " * 40_000)]


def table(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 2 else "src1", 0, 1, "x") for n, (i, t) in enumerate(rows)], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_gives_the_librarys_ids(spark, sf):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), table(spark)):
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in texts.items():
            ids = enc.encode_ordinary(t)
            want[i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t.encode())] += n
        assert Counter(tuple(r) for r in bpe.tokenize(docs, path).collect()) == want
    assert bpe.tokenize(table(spark).limit(0), path).count() == 0


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.learn(docs)
    got = langid.identify(docs, model, ["doc_id", "lang"]).filter("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(table(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= odd and (6, "und") not in odd
    assert {r["lang_pred"] for r in langid.identify(table(spark), "{}").collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == "{}"


def test_media_round_trip(spark):
    docs = table(spark)
    want = Counter()
    for i, t in ODD:
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 if b else 192)
        want[i, len(b), len(p), sha(p), zlib.crc32(p[-16:])] += 1
    for kind in ("ppm", "bmp"):
        rows = media.describe(media.store(docs, kind)).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
        assert len({r["feature"] for r in rows if r["doc_id"] == 6}) == 1
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_fingerprints(spark):
    docs = table(spark)
    rows = fingerprint.compare(docs).collect()
    by = Counter(r["doc_id"] for r in rows)
    assert by == Counter(i for i, _ in ODD)
    ordered = sorted(((i, t or "") for i, t in ODD if i is not None), key=lambda x: (-x[0], x[1])) + [(None, "no id")]
    want = Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 3
        want[i, len(t), sha((t[: len(t) - k] + after[:k]).encode())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprint.compare(docs.limit(0)).count() == 0


def test_archive(spark):
    big = "x" * 100
    rows = [(3, "u", big), (1, None, big), (2, "a\r\nb", big), (4, "v", None), (5, "w", ""), (6, "s", "small"), (7, "s", "small"), (None, "n", big), (9, "l", "é" * 50)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()}
    assert got == {1: (100, "response", None), 2: (100, "revisit", 1), 3: (100, "revisit", 1), None: (100, "revisit", 1), 4: (0, "response", None), 5: (0, "response", None), 6: (5, "response", None), 7: (5, "response", None), 9: (100, "response", None)}
    assert warc.archive(pages.limit(0)).count() == 0


def test_archived_records_come_back(spark, tmp_path):
    """Bytes of each record, by the layout in plain Python; a changed payload or header fails the read."""
    rows = [(1, "u", "x" * 120), (2, "a\r\nb", "x" * 120), (3, None, None), (None, "é", "kurz"), (1, "u", "x" * 120)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record string")
    path = str(tmp_path / "a")
    warc.write(pages, path)
    want, filed = Counter(), Counter()
    for i, u, t in rows:
        body, again = (t or "").encode(), i == 2
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if i is None else i}>"]
        head += ["WARC-Refers-To: <urn:page:1>"] * again + ["WARC-Date: 2024-01-01T00:00:00Z"]
        head += [] if u is None else ["WARC-Target-URI: " + u.replace("\r", "%0D").replace("\n", "%0A")]
        head += [f"WARC-Profile: {warc.PROFILE}"] * again
        head += [f"WARC-Payload-Digest: sha256:{sha(body)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if again else len(body)}", "", ""]
        want[i, u, "\r\n".join(head).encode() + body + b"\r\n\r\n"] += 1
        filed[i, u, "\r\n".join(head).encode() + (b"" if again else body) + b"\r\n\r\n"] += 1
    got = lambda whole: Counter((r["page_id"], r["url"], bytes(r["record"])) for r in warc.records(spark, path, whole).collect())
    assert got(True) == want and got(False) == filed
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for table, change in (("payloads", F.when(F.octet_length("payload") > 99, F.lit(b"y" * 120)).otherwise(F.col("payload")).alias("payload")), ("headers", F.concat("header", F.lit(" ")).alias("header"))):
        other = str(tmp_path / f"b-{table}")
        for t in ("payloads", "headers"):
            df = spark.read.parquet(f"{path}/{t}")
            (df.withColumn(table[:-1], change) if t == table else df).write.parquet(f"{other}/{t}")
        with pytest.raises(Exception, match="stored payload|other bytes"):
            warc.records(spark, other).collect()


def test_toxicity_on_held_out_documents(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = toxicity.detect(docs, model).join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()
    bad, good = [r["predicted"] for r in got if r["toxic"] == 1], [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(bad) / len(bad) > 0.8 and sum(good) / len(good) < 0.02
    rows = toxicity.detect(table(spark), model, spans=True).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["predicted"] for r in toxicity.detect(table(spark), toxicity.learn(docs.limit(0), labels)).collect()} == {0}


def windows(rows, k=13):
    """doc_id, words, removed and kept text by brute force."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out[i, len(w), len(gone), sha(" ".join(x for a, x in enumerate(w) if a not in gone).encode())] += 1
    return out


def test_substring_dedup_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"é{i}" for i in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(i, t) for i, t in ODD if i is not None]
    for i in range(10, 120):
        a = rng.randrange(45)
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + passage[a : a + rng.randrange(30)] + [" ", "b\x0bc"] * rng.randrange(9)
        rows.append((i, " ".join(w)))
    docs = table(spark, rows)
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in substring.dedup(docs).select(*cols).collect()) == windows(rows)
    assert Counter(tuple(r) for r in substring.dedup(docs, block=2000, shard=700).select(*cols).collect()) == windows(rows)
    assert substring.dedup(docs.limit(0)).count() == 0


def test_mixing_and_quality_edge_cases(spark, sf):
    docs = table(spark)
    assert {r["doc_id"] for r in mixing.mix(docs, fraction=1.0, epochs=1).filter("copies > 0").collect()} == {4, 5, 6, None, 7, 8}
    assert mixing.mix(docs.limit(0)).count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.score(docs, quality.learn(real, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.learn(real.limit(0), labels)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)
