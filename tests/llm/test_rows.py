"""Rows of null and repeated ids, and languages that have long texts only."""

import json

import corpus_pipeline
from ravelin.llm import langid, mixing, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_weights_draw_rows_and_not_ids(spark, sf):
    rows = [(None, f"n{i} x", "en", "s", 4) for i in range(50)] + [(7, f"r{i} x", "en", "s", 4) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [r["text"] for r in corpus_pipeline.source_weights(spark, docs, sf).collect()]
    assert len(got) == len(set(got)) == 90
    drawn = mixing.mix(docs, fraction=0.9, epochs=1, seed=7).filter("copies > 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in drawn} == {k: sum(t[0] == c for t in got) for k, c in ((None, "n"), (7, "r"))}


def test_each_text_of_a_repeated_id_is_judged_by_itself(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "its own text of this id"), (5, "its own text of this id"), (6, None), (6, None), (9, "its own  text of this id"), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs).collect())
    assert got == [(0, "a b c d e f")] * 2 + [(1, "a b c d e f"), (5, "its own text of this id"), (6, "")]


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "long text " * 500 if i % 2 else "kurz", "xx" if i % 2 else "yy", "s", 1) for i in range(40)]
    rows += [(i, "kurzer text " * 500, "yy", "s", 1) for i in range(40, 80)]
    model = json.loads(langid.learn(spark.createDataFrame(rows, SCHEMA), rows=5))
    assert {k: len(v) for k, v in model.items()} == {"xx": 5, "yy": 5}
