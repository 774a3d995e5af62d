"""Cross-parsing against a parse by string search."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import langid
from ravelin.llm.text import raw

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def codes(text):
    got, _ = langid.letters(*raw(pa.array([text], pa.large_string())))
    return got.tobytes()


def phrases(text, learned):
    """Longest phrases that occur in what was learned, from left to right; a letter that never occurs is one."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in learned and text[at : at + k] in learned:
            k += 1
        n, at = n + 1, at + k
    return n


def sample(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_whole_texts_are_one_parse(monkeypatch):
    rng = random.Random(2)
    texts = {"xx": [sample(rng, "abcde", 150) for _ in range(3)], "yy": [sample(rng, "cdefé", 200)], "zz": ["q"]}
    asked = ["", "a", "zzz zq", "1 2", *(sample(rng, a, n) for a in ("abcde", "abcdefé", "xyz") for n in (3, 80, 300, 2000))]
    asked += [texts["xx"][0] * 3, texts["xx"][1][7:] + "?"]
    want = np.array([[phrases(codes(t), codes("\n".join(texts[x]))) for x in sorted(texts)] for t in asked])
    parser = langid.Parser(texts)
    part = raw(pa.array(asked, pa.large_string()))
    for steps, mark in ((512, 32), (64, 32), (7, 7)):
        monkeypatch.setattr(langid, "STEPS", steps)
        monkeypatch.setattr(langid, "MARK", mark)
        assert (parser.phrases(*langid.letters(*part)) == want).all()


def test_packed_rows_hold_all_edges():
    code = np.frombuffer(codes(sample(random.Random(3), "abcdefgh", 400)), np.uint8)
    rows, c, to, n = langid.automaton(code)
    place, table = langid.pack(rows, c, to, n)
    assert len(set(place.tolist())) == n and (table >= 0).sum() == len(rows)
    assert (table[place[rows] + c] == (place[rows] << 32) + place[to]).all()


def test_ties_empty_tables_and_clashing_names(spark):
    model = json.dumps({"b": ["same text"], "a": ["same text"]})
    docs = spark.createDataFrame([(1, "same", "x", "s", 1), (1, "same", "x", "s", 1), (None, None, None, None, None), (2, "12 !", "x", "s", 1)], SCHEMA).withColumnRenamed("n_chars", "score")
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect())
    assert got == [(0, "und", 0.0), (1, "a", 0.5), (1, "a", 0.5), (2, "und", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0 and langid.learn(docs.limit(0)) == "{}"
    with pytest.raises(ValueError):
        langid.identify(docs, model, ["score"])
