"""Contraction against a plain one, cuts of long pieces, colliding hashes."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from ravelin.llm import bpe


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(P.path("byte_bpe_50k.tiktoken"))


def plain(piece, ranks):
    """One pair at a time: the leftmost of least rank."""
    x = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        k, i = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(x, x[1:], strict=False))), default=(1 << 40, 0))
        if k == 1 << 40:
            return b"".join(ranks[t].to_bytes(4, "little") for t in x)
        x[i : i + 2] = [x[i] + x[i + 1]]


def test_pieces_of_all_lengths(model, monkeypatch):
    rng = random.Random(4)
    letters = [b"a", b"ab", b"etaoinshrdlu", "éèñ日本語".encode(), bytes(range(256))]
    pieces = [bytes(rng.choice(s) for _ in range(rng.randrange(1, 160))) for s in letters for _ in range(20)]
    want = [plain(x, model.ranks) for x in pieces]
    assert model.encode(pieces) == want
    monkeypatch.setattr(bpe, "LONG", 0)  # all by the query for long ones
    assert model.encode(pieces[::8]) == want[::8]


def test_no_token_spans_a_cut(model):
    for tok in model.ranks:
        x = np.frombuffer(tok, np.uint8)
        assert model.joined[x[:-1], x[1:]].all()
    assert not model.joined.all()


def test_equal_hashes_of_other_bytes_are_told_apart():
    data, s, e = b"abcaba", np.array([0, 2, 3, 5]), np.array([2, 3, 5, 6])
    pieces, inv = bpe.distinct(data, s, e, np.zeros(4, np.uint64))
    assert [pieces[i] for i in inv] == [b"ab", b"c", b"ab", b"a"] and len(pieces) == 3


def test_decoding_follows_the_ids(model):
    ids = np.frombuffer(b"".join(model.encode([b"some text", b" and more"])), "<u4")
    assert model.decode(ids[::-1], np.array([0, 0, len(ids)])) == [b"", b"".join(k for i in ids[::-1] for k, v in model.ranks.items() if v == i)]
