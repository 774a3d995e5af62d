"""Marginals against an enumeration of all paths, and against an uncut chain in plain Python."""

import itertools
import math

import numpy as np
import pytest

from ravelin.llm import toxicity
from ravelin.llm.shared import first_of_each

GO = np.array([[0.7, -1.1], [-0.4, 0.9]])


def enumerated(emit, go):
    """P(1) of each token and the expected transitions, over all paths."""
    p, pairs, z = np.zeros(len(emit)), np.zeros((2, 2)), 0.0
    for path in itertools.product((0, 1), repeat=len(emit)):
        w = math.exp(sum(e * y for e, y in zip(emit, path, strict=True)) + sum(go[a, b] for a, b in zip(path, path[1:], strict=False)))
        z += w
        p += w * np.array(path)
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w
    return p / z, pairs / z


def chain(emit, go):
    """Forward-backward over one whole chain."""
    psi = np.stack([np.ones(len(emit)), np.exp(emit)], 1)
    t = np.exp(go)
    a, b = [psi[0] / psi[0].sum()], [np.ones(2)]
    for p in psi[1:]:
        x = (a[-1] @ t) * p
        a.append(x / x.sum())
    for p in psi[:0:-1]:
        x = t @ (p * b[-1])
        b.append(x / x.sum())
    g = np.array(a) * np.array(b[::-1])
    return g[:, 1] / g.sum(1)


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_all_paths(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    sizes = [0, 1, 9, 3, 0, 7, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(0, 2, first[-1])
    got, pairs = toxicity.marginals(emit, first, GO, True)
    want = [enumerated(emit[a:b], GO) for a, b in zip(first, first[1:], strict=False)]
    assert np.abs(got - np.concatenate([w[0] for w in want])).max() < 1e-12
    assert np.abs(pairs - sum(w[1] for w in want)).max() < 1e-9
    assert np.abs(toxicity.marginals(emit, first, GO) - got).max() < 1e-12


def test_long_texts_are_one_chain():
    rng = np.random.default_rng(2)
    sizes = [1000, 63, 64, 65, 3000, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(0, 3, first[-1])
    want = np.concatenate([chain(emit[a:b], GO) for a, b in zip(first, first[1:], strict=False)])
    assert np.abs(toxicity.marginals(emit, first, GO) - want).max() < 1e-9


def test_samples_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"vile words {i}" if i % 2 else f"fine words {i}", i) for i in range(60)] * 2 + [(None, None, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    rows = toxicity.detect(docs, model, spans=True).collect()
    assert len(rows) == 121 and all(r["predicted"] == (r["doc_id"] or 0) % 2 for r in rows)
    assert {tuple((s["begin"], s["end"]) for s in r["spans"])[:1] for r in rows if r["predicted"]} == {((0, 4),)}
    assert toxicity.detect(docs.limit(0), model).count() == 0
    assert {r["predicted"] for r in toxicity.detect(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0}
    y = spark.range(5000).selectExpr("id as doc_id", "cast(id % 50 = 0 as int) as c")
    for n in (10, 80, 7000):
        got = first_of_each(y, "c", n, "s")
        want = y.selectExpr("doc_id", "c", "row_number() over (partition by c order by xxhash64(doc_id, 's'), doc_id) as r").filter(f"r <= {n}").select("doc_id", "c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
