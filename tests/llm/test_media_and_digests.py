"""Slow forms of area means, difference hashes, rarity, features, filters and likeness."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np

from ravelin.llm import fingerprint as fp
from ravelin.llm import media
from ravelin.llm.text import prefix_sums, span_hashes

SCHEMA = "doc_id long, text string, media string, run string"
TEXTS = ["", "short", "a" * 64, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 9, "".join(chr(33 + i * i % 90) for i in range(700)), "x" * 300 + "The quick brown fox, 1234567890!" * 7, "tail " * 40 + "".join(chr(33 + i * 7 % 90) for i in range(300))]


def means(a, h, w):
    """Means over areas, pixel by pixel in exact fractions."""
    out = []
    for i in range(h):
        for j in range(w):
            top, end, left, right = (Fraction(x) for x in (Fraction(i * a.shape[0], h), Fraction((i + 1) * a.shape[0], h), Fraction(j * a.shape[1], w), Fraction((j + 1) * a.shape[1], w)))
            s = Fraction(0)
            for y in range(int(top), math.ceil(end)):
                for x in range(int(left), math.ceil(right)):
                    s += int(a[y, x]) * (min(end, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
            out.append(s / ((end - top) * (right - left)))
    return np.array(out, object).reshape(h, w)


def test_area_means_and_hashes():
    rng = np.random.default_rng(3)
    for shape in ((1, 64), (5, 64), (13, 7), (8, 9)):
        a = rng.integers(0, 256, shape)
        for h, w in ((8, 9), (8, 8), (3, 2)):
            assert np.abs(media.resize(a, h, w) - means(a, h, w).astype(float)).max() < 1e-8
        m = means(a, 8, 9)
        bits = "".join(str(int(round(m[i, j] * 4096) < round(m[i, j + 1] * 4096))) for i in range(8) for j in range(8))
        assert media.difference_hash(a) == f"{int(bits, 2):016x}"
    assert media.difference_hash(np.full((3, 64), 32)) == "0" * 16


def test_both_forms_in_one_table(spark):
    docs = spark.createDataFrame([(i, t, "m", "r") for i, t in enumerate(TEXTS)] + [(None, None, None, None)], SCHEMA)
    rows = media.store(docs).collect()
    assert {bytes(r["media"][:2]) for r in rows} == {b"P6", b"BM"}
    got = media.describe(media.store(docs)).collect()
    for r in got:
        tile = np.load(__import__("io").BytesIO(r["tile"]))
        data = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        gray = media.luma(np.frombuffer(data, np.uint8).reshape(-1, 64, 3))
        want = means(gray, 8, 8)
        assert tile.shape == (8, 8) and all(abs(int(t) - float(v)) <= 0.5 + 1e-6 for t, v in zip(tile.ravel(), want.ravel(), strict=True))
    assert media.describe(media.store(docs.limit(0))).count() == 0


def level(window):
    s = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    most = round(64 * math.log2(64) * 65536)
    return (most - s) * 511 // most


def slow_features(b, rank):
    """Rarest window of each run of windows, first of equal ones, gains a point; those of 16 points are features."""
    if not b:
        return []
    if len(b) < 64:
        return [(0, len(b))]
    r = [rank[level(b[i : i + 64])] for i in range(len(b) - 63)]
    span = min(64, 1 << (len(r).bit_length() - 1))
    points = Counter(min(range(i, i + span), key=lambda k: (r[k], k)) for i in range(len(r) - span + 1))
    seen, out = set(), []
    for i in sorted(points):
        if points[i] >= min(16, len(r) - span + 1) and b[i : i + 64] not in seen:
            seen.add(b[i : i + 64])
            out.append((i, i + 64))
    return out


def slow_filters(b, rank):
    spans = slow_features(b, rank)
    h = span_hashes(prefix_sums(np.frombuffer(b, np.uint8)), *np.array(spans).T).tolist() if spans else []
    filters = [set() for _ in range(max(1, -(-len(h) // 160)))]
    for k, x in enumerate(h):
        filters[k // 160] |= {(x >> 11 * i) % 2048 for i in range(5)}
    return filters, len(h)


def slow_likeness(a, b):
    (x, n), (y, m) = a, b
    if not n or not m:
        return float(n == m)
    if len(x) > len(y):
        x, y = y, x
    best = [max(min(1, max(0, (len(p & q) - len(p) * len(q) / 2048) / max(min(len(p), len(q)) - len(p) * len(q) / 2048, 1e-9))) for q in y) for p in x]
    return sum(s * len(p) for s, p in zip(best, x, strict=True)) / sum(map(len, x))


def test_fingerprints_by_slow_forms(spark):
    docs = spark.createDataFrame([(i, t, "m", "r") for i, t in enumerate(TEXTS)], SCHEMA)
    counts = Counter(level(t.encode()[i : i + 64]) for t in TEXTS for i in range(len(t.encode()) - 63))
    order = sorted(range(512), key=lambda v: (counts[v], v))
    rank = {v: k for k, v in enumerate(order)}
    assert fp.rarity(docs) == [rank[v] for v in range(512)]
    for r in fp.compare(docs).collect():
        text, after = TEXTS[r["doc_id"]], TEXTS[r["doc_id"] - 1]
        k = len(text) // 3
        mine, new, nxt = (slow_filters(t.encode(), rank) for t in (text, text[: len(text) - k] + after[:k], after))
        for name, (filters, n) in (("fingerprint", mine), ("edited_fingerprint", new)):
            head, *rest = r[name].split(":")
            assert int(head) == n and [{i for i, b in enumerate(np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))) if b} for x in rest] == filters
        if len(mine[0]) != len(nxt[0]):
            assert abs(r["near_next"] - slow_likeness(mine, nxt)) < 1e-6
        if len(mine[0]) == len(new[0]) == 1:
            assert abs(r["near_edited"] - slow_likeness(mine, new)) < 1e-6


def test_chain_over_many_runs(spark, monkeypatch):
    """Next rows whatever the runs: repeated and null ids, gaps, runs without rows."""
    rows = [(i * i if i % 5 else 7, f"t{i}") for i in range(120)] + [(None, "n1"), (None, "n0"), (-(2**62), "low"), (2**62, "high")]
    docs = spark.createDataFrame([(i, t, "m", "r") for i, t in rows], SCHEMA)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((i, t, after) for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    for size, step in ((4000, 10_000), (10, 10_000), (3, 2), (1, 7)):
        monkeypatch.setattr(fp, "STEP", step)
        assert Counter(map(tuple, fp.chain(docs, size).collect())) == want
