"""Near-duplicate classes against a comparison of all pairs in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from ravelin.llm import neardup

SCHEMA = "doc_id long, text string, a long, bucket string"


def lcs(a, b):
    """Words matched by the best alignment, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similar(rows):
    """(i, j): the edit similarity of all pairs of ids that have 0.8 at least, equal texts 1."""
    texts = sorted({(i, tuple(x for x in (t or "").replace("\n", " ").split(" ") if x)) for i, t in rows})
    counts = [Counter(w) for _, w in texts]
    out = {}
    for k, (i, a) in enumerate(texts):
        for m, (j, b) in enumerate(texts[:k]):
            n = max(len(a), len(b))
            if a and a == b:
                out[j, i] = 1.0
            elif min(len(a), len(b)) >= max(5, 0.8 * n) and sum((counts[k] & counts[m]).values()) >= 0.8 * n and (s := lcs(a, b) / n) >= 0.8:
                out[j, i] = s
    return out


def brute(rows):
    """doc_id -> class by comparing all pairs."""
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in similar(rows):
        a, b = sorted((root(i), root(j)))
        top[b] = a
    return {i: root(i) for i in top}


def found(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def text(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_recall_by_similarity(spark, sf):
    """All pairs of sf0.01: no link is false, and of true ones few are missed."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs, got = similar(rows), found(neardup.classes(docs))
    top = brute(rows)
    assert set(got) == set(top) and all(top[i] == top[c] for i, c in got.items())
    for low, high, least in ((1.0, 2.0, 1.0), (0.95, 1.0, 0.99), (0.9, 0.95, 0.95), (0.8, 0.9, 0.6)):
        band = [got[i] == got[j] for (i, j), s in pairs.items() if low <= s < high]
        print(low, len(band), sum(band) / max(1, len(band)))
        assert sum(band) >= least * len(band)
    every = [got[i] == got[j] for i, j in pairs]
    assert sum(every) >= 0.9 * len(every)


def test_groups_of_copies_that_leaders_do_not_explain(spark):
    """Chains of edits, one group larger than a tile, and many texts around one passage."""
    rng = random.Random(5)
    base, passage = text(rng, 120), text(rng, 60)
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = text(rng, 80)
    for i in range(700, 720):
        rows.append((i, " ".join(chain)))
        chain[(i - 700) * 4] = f"y{i}"
    rows += [(i, " ".join(text(rng, 20) + passage + text(rng, 20))) for i in range(720, 1100)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    assert found(neardup.classes(docs)) == {i: 0 if i < 700 else 700 if i < 720 else i for i, _ in rows}


def test_alignment_against_the_table():
    rng = random.Random(8)
    for _ in range(400):
        a = [rng.randrange(rng.choice((2, 30))) for _ in range(rng.randrange(5, 60))]
        b = [x for x in a for x in ([x] if rng.random() < 0.8 else [rng.randrange(30)] * rng.randrange(3))]
        n = lcs(a, b)
        for need in range(max(1, n - 2), n + 3):
            assert neardup.aligned(a, b, need) == (n >= need)
        want = len(b) >= 5 and n >= 0.8 * max(len(a), len(b)) or a == b
        assert neardup.alike(np.array(a, np.uint64), np.array(b, np.uint64)) == want


@pytest.mark.parametrize("tile", [2, 16, 256])
def test_rare_words_and_tiles_lose_no_link(spark, monkeypatch, tile):
    """Every link between texts of a bucket is found without leaders, whatever the tiles; hot buckets make no difference."""
    rng = random.Random(11)
    passage, rows = text(rng, 40), []
    for g in range(30):
        base = text(rng, rng.randrange(5, 60)) + passage
        for k in range(4):
            w = [x if rng.random() < 0.97 else f"q{rng.randrange(10**6)}" for x in base]
            rows.append((g * 10 + k, " ".join(w)))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "HOT", 3 if tile == 2 else 1000)
    monkeypatch.setattr(neardup, "sketches", lambda h, first: (np.zeros(((np.diff(first) >= 5).sum(), 1), np.uint64), np.diff(first) >= 5))
    assert found(neardup.classes(docs)) == brute(rows)


def test_tiles_and_leaders_agree(spark, monkeypatch):
    rng = random.Random(9)
    base = text(rng, 60)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), 0, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = found(neardup.classes(docs))
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(neardup, "WORDS", 500)
    assert found(neardup.classes(docs)) == want


def test_edge_cases(spark):
    """Nulls and texts without words are classes of their own; short texts match only exactly; repeated rows are one document."""
    long = " ".join(text(random.Random(1), 30_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one  two"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (None, "one two"), (8, long), (9, long + " end"), (-3, "a b c d  e")]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], SCHEMA)
    assert found(neardup.classes(docs)) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: -3, 8: 8, 9: 8, -3: -3}
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in neardup.keep_one(docs).collect())
    assert [k for k in kept if not k[0]] == [(False, i) for i in (-3, 1, 2, 3, 4, 6, 8)] and kept[-1][0]
    assert neardup.classes(docs.limit(0)).count() == 0


def test_overlaps_count_multisets():
    a, b = np.array([1, 1, 2, 3, 4, 5, 1, 1, 2, 3, 4], np.uint64), np.array([1, 1, 2, 3, 4, 9], np.uint64)
    sets = [neardup.labelled(a), neardup.labelled(b)]
    got = neardup.overlaps(sets)
    assert got[0, 1] == got[1, 0] == 5
    assert neardup.overlaps([sets[0], sets[0]])[0, 1] == len(a)


@pytest.mark.parametrize("steps", [0, 1, None])
def test_classes_of_links_in_parts(spark, steps):
    """Labels of a few steps, brought up to date by further links, are whole after all links were seen again."""
    rng = np.random.default_rng(3)
    parts = [np.concatenate([rng.integers(0, 120, (25, 2)), [(200 + i, 201 + i) for i in range(k, 40, 3)]]) for k in range(3)]
    labels = None
    top = {int(x): int(x) for p in parts for x in p.ravel()}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    tables = [spark.createDataFrame([(int(a), int(b)) for a, b in p], "a long, b long") for p in parts]
    for p, t in zip(parts, tables):
        labels = neardup.merged(labels, t, steps)
        for a, b in p:
            a, b = sorted((root(int(a)), root(int(b))))
            top[b] = a
        assert all(root(r["node"]) == root(r["comp"]) for r in labels.collect())
    got = {r["node"]: r["comp"] for r in neardup.merged(labels, tables[0].union(tables[1]).union(tables[2])).collect()}
    met = {int(x) for p in parts for a, b in p if a != b for x in (a, b)}
    assert met <= set(got) and all(got[x] == root(x) for x in got)
