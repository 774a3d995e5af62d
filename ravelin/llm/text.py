"""Vectorised word and byte primitives shared by the operators of this subpackage.

Everything here works on the UTF-8 bytes of an Arrow string column, a block of
whole documents at a time, so that no Python loop runs per word or character.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte; fixed, as hashes meet across executors.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown on demand."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column with nulls as empty texts."""
    a = batch.column(batch.schema.get_field_index(name))
    return a.fill_null("") if a.null_count else a


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins, with the end."""
    wide = pa.types.is_large_string(a.type)
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def blocks(batch: pa.RecordBatch, size: int = 1 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about size bytes of text each; a longer text stands alone."""
    _, o = raw(column(batch, name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(b: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (with the end).
    between: for each byte, whether it parts words."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    s = between[b]
    first = s.copy()
    first[1:] = s[:-1]
    inner = off[(off < len(b))]
    first[inner] = True
    last = np.empty_like(s)
    last[:-1] = s[1:]
    last[-1] = True
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(first & ~s)
    ends = np.flatnonzero(last & ~s) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of byte values by powers, for span_hashes."""
    p, _ = _power_tables(len(b) + 1)
    out = np.zeros(len(b) + 1, U64)
    np.cumsum(BYTE_VALUES[b] * p[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    _, inv = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64))


def word_hashes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the first word of each text (with the end)."""
    b, off = raw(a)
    starts, ends, first = word_bounds(b, off)
    return span_hashes(prefix_sums(b), starts, ends), first


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; grams may cross texts, see inside()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= BASE
        out += h[i : i + n]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each word on are in one text, for len(h)-k+1 words."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(int(first[-1]), bool)
    ends = first[1:]
    for i in range(1, k):
        at = ends - i
        ok[at[at >= first[:-1]]] = False
    return ok[:n]
