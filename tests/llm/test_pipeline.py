"""Stages of the pipeline on rows that are missing, repeated or strange, and the whole against the stages' own rules."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, domain string, block string, kept string"
COLUMNS = cp.COLUMNS


def table(spark, n=60):
    rng = random.Random(7)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(2, 8)))
    words = {k: [word(s) for _ in range(80)] for k, s in (("en", "etaoinshr"), ("de", "äöüßchzgu"))}
    text = lambda k, m: " ".join(rng.choice(words[k]) for _ in range(m))
    rows = [(i, text(("en", "de")[i % 2], 80), ("en", "de")[i % 2], f"src{i % 3}") for i in range(n)]
    passage = text("en", 40)
    rows += [(n + 1, rows[0][1], "en", "src0"), (n + 2, rows[2][1] + " end", None, None), (n + 2, rows[2][1] + " end", None, None), (None, rows[4][1], "en", "src1")]
    rows += [(n + 3, text("en", 30) + " " + passage, "en", "src2"), (n + 4, passage + " " + text("en", 70), "en", "src2"), (n + 5, None, "en", "src0"), (n + 6, "", "de", None), (n + 7, "12 34", "en", "src0"), (n + 8, text("de", 30_000), "de", "src1")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "p", "s", "d", "b", "k") for r in rows], SCHEMA), passage


def test_stages_in_their_order(spark, sf):
    docs, passage = table(spark)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    found = cp.language(spark, docs, sf)
    assert found.columns == COLUMNS and not {65, 66, 67} & set(ids(found)) and len(ids(found)) >= 60
    near = cp.near_duplicates(spark, found, sf)
    gone = ids(found) - ids(near)
    assert near.columns == COLUMNS and gone[61] == 1 and gone[62] == 2 and sum(gone.values()) == 3 and ids(near)[None] == 1
    cut = cp.repeated_passages(spark, near, sf)
    by = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == COLUMNS and passage in by[63]["text"] and passage not in by[64]["text"] and by[64]["n_chars"] == len(by[64]["text"])
    same = {r["doc_id"]: r["text"] for r in near.collect()}
    assert all(r["text"] == same[i] for i, r in by.items() if i not in (None, 64))
    mixed = cp.source_weights(spark, cut, sf)
    assert mixed.columns == COLUMNS and not Counter(map(tuple, mixed.collect())) - Counter(map(tuple, cut.collect()))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    want = Counter((r["doc_id"], b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(r["text"]))) for r in mixed.collect())
    got = cp.tokens(spark, mixed, sf).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert Counter(r["ids_sha256"] for r in got) == Counter(hashlib.sha256(x).hexdigest() for _, x in want.elements())


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_empty_tables(spark, sf, stage):
    assert stage(spark, table(spark, 6)[0].limit(0), sf).count() == 0


def test_the_whole_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert Counter(r["ids_sha256"] for r in cp.run(spark, sf).collect()) == Counter(r["ids_sha256"] for r in docs.collect())
