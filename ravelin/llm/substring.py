"""Substring dedup over compressed FM-indexes.

A window is WINDOW consecutive words of one document. Every window has an anchor: the GRAM words in it of
least hash. Equal windows have equal anchors, so windows are dealt to shards by their anchors, and neighbours
with one anchor go as one segment. Each shard keeps its distinct segments in an FM-index - the
Burrows-Wheeler transform of their words in a wavelet matrix of packed bits with sampled ranks - and
backward search streams every window through it: the interval in which the matching statistics reach
WINDOW words is the same for equal windows and for no others, and the least doc_id of its segments decides.

Documents are dealt once to blocks by doc_id; the plan reads that exchange again for each step:
  1. blocks send their distinct anchors to shards; shards tell blocks which ones other blocks have too;
  2. blocks send the distinct segments of repeated anchors, with the least doc_id of each;
  3. shards index and search them, and send back the least doc_id of each window;
  4. blocks remove the words that windows of smaller documents cover.
A passage in very many documents is one anchor and one segment a block, so nothing grows with a
passage's copies but the blocks that hold them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import release, ship
from ravelin.llm.text import BASE, U64, _power_tables, blocks, column, gram_hashes, inside, mix, owners, prefix_sums, raw, span_hashes, word_bounds

WINDOW = 13
GRAM = 6
LAST = np.iinfo(np.int64).max
#: The lowest 0 to 63 bits.
MASKS = (U64(1) << np.arange(64, dtype=U64)) - U64(1)


class FmIndex:
    """An FM-index of word sequences, sorted to a depth of at least `depth` words.

    seqs: words (uint64) of all sequences one after the other; cut: where each begins, with the end.
    """

    def __init__(self, seqs: np.ndarray, cut: np.ndarray, depth: int = WINDOW):
        size = np.diff(cut)
        words, code = np.unique(seqs, return_inverse=True)
        self.words = words
        n = len(seqs) + len(size)
        text = np.zeros(n, np.int64)  # 0 parts sequences
        self.place = np.arange(len(seqs)) + np.repeat(np.arange(len(size)), size)
        text[self.place] = code + 1
        self.code = code + 1
        rank, step = text, 1
        while step < depth:
            key = rank * (int(rank.max()) + 2)
            key[:-step] += rank[step:] + 1
            sa = np.argsort(key)
            s = key[sa]
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(s[1:] != s[:-1])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            step *= 2
        self.n = n
        self.begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=len(words) + 1))])
        bwt = text[sa - 1]
        self.levels = max(1, int(len(words)).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        symbols = np.arange(len(words) + 1)
        self.low = self._down(symbols, np.zeros(len(symbols), np.int64))  # where each symbol's range begins below the last level

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i symbols of the transform lead, following the bits of c."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            w = i >> 6
            ones = self.ranks[k][w] + np.bitwise_count(self.bits[k][w] & MASKS[i & 63])
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The number of c among the first i symbols of the transform."""
        return self._down(c, i) - self.low[c]

    def search(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each k words of the indexed sequences that begin at `at` (in seqs), by backward search.
        A search stops when one occurrence, the window itself, is left: then the interval is empty (-1, -1)."""
        low, high = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        c = self.code[at + k - 1]
        lo, hi = self.begin[c], self.begin[c + 1]
        for i in range(k - 2, -2, -1):
            more = hi - lo > 1
            left, lo, hi = left[more], lo[more], hi[more]
            if i < 0 or not len(left):
                break
            c = self.code[at[left] + i]
            lo, hi = self.begin[c] + self._rank(c, lo), self.begin[c] + self._rank(c, hi)
        low[left], high[left] = lo, hi
        return low, high


def least_by_window(seqs: np.ndarray, cut: np.ndarray, doc: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each window of each sequence (of k words at least), the least doc of the sequences that hold it."""
    size = np.diff(cut) - k + 1
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cut[:-1], size)
    out = doc[owner]
    index = FmIndex(seqs, cut, k)
    for a in range(0, len(at), 1 << 18):
        low, _ = index.search(at[a : a + (1 << 18)], k)
        if a == 0:
            found = np.empty(len(at), np.int64)
        found[a : a + (1 << 18)] = low
    if len(at):
        hit = np.flatnonzero(found >= 0)
        best = np.full(index.n, LAST, np.int64)
        np.minimum.at(best, found[hit], out[hit])
        out[hit] = best[found[hit]]
    return out


class Segments:
    """The segments of a record batch: runs of windows of one document with one anchor."""

    def __init__(self, part: pa.RecordBatch):
        self.b, self.off = raw(column(part))
        self.s, self.e, self.first = word_bounds(self.b, self.off)
        self.doc = part.column(part.schema.get_field_index("doc_id")).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.h = span_hashes(prefix_sums(self.b), self.s, self.e) if len(self.b) else np.zeros(0, U64)
        ok = inside(self.first, WINDOW)
        g = gram_hashes(self.h, GRAM)
        n = len(ok)
        if n:
            best, arg = g[:n].copy(), np.arange(n)
            for i in range(1, WINDOW - GRAM + 1):
                x = g[i : i + n]
                less = x < best
                best[less] = x[less]
                arg[less] = np.flatnonzero(less) + i
            at = np.flatnonzero(ok)  # windows
            arg, best = arg[at], best[at]
            new = np.ones(len(at), bool)
            # A window's anchor is a place; neighbours with the same one, in one document, are a segment.
            new[1:] = (arg[1:] != arg[:-1]) | (at[1:] != at[:-1] + 1)
            k = np.flatnonzero(new)
        else:
            at, k, best = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),)
        self.anchor = best[k]
        self.begin = at[k]  # first word
        self.windows = np.diff(np.append(k, len(at)))
        self.words = self.windows + WINDOW - 1
        self.owner = owners(self.first)[self.begin] if n else np.zeros(0, np.int64)

    def keys(self) -> np.ndarray:
        """A hash of each segment's words."""
        p, inv = _power_tables(len(self.h) + 1)
        sums = np.zeros(len(self.h) + 1, U64)
        np.cumsum(self.h * p[:-1], out=sums[1:])
        return mix((sums[self.begin + self.words] - sums[self.begin]) * inv[self.begin] + self.words.astype(U64))

    def text(self, which: np.ndarray) -> bytes:
        """The words of the named segments, each followed by a blank, and each segment by a line feed."""
        n = self.words[which]
        word = np.arange(n.sum()) + np.repeat(self.begin[which] - np.cumsum(n) + n, n)
        end = np.zeros(len(word), bool)
        end[np.cumsum(n) - 1] = True
        return spell(self.b, self.s[word], self.e[word], np.where(end, 10, 32).astype(np.uint8))


def spell(b: np.ndarray, s: np.ndarray, e: np.ndarray, after: np.ndarray) -> bytes:
    """The spans of b, one after the other, each followed by its byte of after."""
    n = e - s + 1
    to = np.cumsum(n)
    out = np.append(b, np.uint8(0))[np.arange(to[-1] if len(to) else 0) + np.repeat(s - to + n, n)]
    out[to - 1] = after
    return out.tobytes()


def _pack(**arrays) -> bytes:
    """Arrays of 8-byte numbers and byte strings as one value."""
    out = []
    for a in arrays.values():
        x = a if isinstance(a, bytes) else a.tobytes()
        out += [len(x).to_bytes(8, "little"), x]
    return b"".join(out)


def _unpack(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _deal(key: np.ndarray, shards: int):
    """The shards that have keys, each with the places of its keys."""
    if not len(key):
        return
    shard = (key % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for x, y in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(shard[order[x]]), order[x:y]


def _table(**columns) -> pa.Table:
    return pa.table(columns)


SIZE = 1 << 19


def _parts(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        for part in blocks(batch, SIZE):
            yield part, Segments(part)


def _anchors(shards: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        block = table.column("block")[0].as_py() if table.num_rows else 0
        found = np.unique(np.concatenate([np.zeros(0, U64), *(x.anchor for _, x in _parts(table))]))
        rows = [(k, found[at].tobytes()) for k, at in _deal(found, shards)]
        return _table(shard=pa.array([r[0] for r in rows], pa.int64()), block=pa.array([block] * len(rows), pa.int64()), data=pa.array([r[1] for r in rows], pa.binary()))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    data = [np.frombuffer(x, U64) for x in table.column("data").to_pylist()]
    every = np.concatenate([np.zeros(0, U64), *data])
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = [(b, x[np.isin(x, twice, assume_unique=True)].tobytes()) for b, x in zip(table.column("block").to_pylist(), data, strict=True)]
    out = [r for r in out if r[1]]
    return _table(block=pa.array([r[0] for r in out], pa.int64()), data=pa.array([r[1] for r in out], pa.binary()))


def _send(shards: int):
    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        release()
        block = table.column("block")[0].as_py() if table.num_rows else 0
        twice = np.unique(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in flags.column("data").to_pylist())]))
        parts = [x for _, x in _parts(table)]
        # Anchors that two documents of this block share count as well.
        a = np.concatenate([np.zeros(0, U64), *(x.anchor for x in parts)])
        d = np.concatenate([np.zeros(0, np.int64), *(x.doc[x.owner] for x in parts)])
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        twice = np.union1d(twice, a[1:][(a[1:] == a[:-1]) & (d[1:] != d[:-1])])
        pick = [np.flatnonzero(np.isin(x.anchor, twice)) for x in parts]
        keys = [x.keys()[i] for x, i in zip(parts, pick, strict=True)]
        key = np.concatenate([np.zeros(0, U64), *keys])
        doc = np.concatenate([np.zeros(0, np.int64), *(x.doc[x.owner[i]] for x, i in zip(parts, pick, strict=True))])
        seen, first, inv = np.unique(key, return_index=True, return_inverse=True)
        least = np.full(len(seen), LAST, np.int64)
        np.minimum.at(least, inv, doc)
        rows: dict[int, list] = {}
        base = 0
        for x, i, own in zip(parts, pick, keys, strict=True):
            mine = first[(first >= base) & (first < base + len(i))] - base  # the first of equal segments is sent
            base += len(i)
            for k, at in _deal(x.anchor[i[mine]], shards):
                w = i[mine[at]]
                slot = np.searchsorted(seen, own[mine[at]])
                rows.setdefault(k, []).append((seen[slot], least[slot], x.text(w)))
        out = [(k, _pack(a=np.concatenate([r[0] for r in v]), b=np.concatenate([r[1] for r in v]), c=b"".join(r[2] for r in v))) for k, v in rows.items()]
        return _table(shard=pa.array([r[0] for r in out], pa.int64()), block=pa.array([block] * len(out), pa.int64()), data=pa.array([r[1] for r in out], pa.binary()))

    return run


def _search(table: pa.Table) -> pa.Table:
    release()
    key, doc, text = [], [], []
    for x in table.column("data").to_pylist():
        k, d, t = _unpack(x)
        key.append(np.frombuffer(k, U64))
        doc.append(np.frombuffer(d, np.int64))
        text.append(t)
    b = np.frombuffer(b"".join(text), np.uint8)
    if not len(b):
        return _table(block=pa.array([], pa.int64()), data=pa.array([], pa.binary()))
    s, e, _ = word_bounds(b, np.array([0, len(b)]))
    h = span_hashes(prefix_sums(b), s, e)
    cut = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(b[e] == 10) + 1])
    every = np.concatenate(key)
    seen, first, inv = np.unique(every, return_index=True, return_inverse=True)
    least = np.full(len(seen), LAST, np.int64)
    np.minimum.at(least, inv, np.concatenate(doc))
    size = np.diff(cut)[first]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    words = h[np.arange(to[-1]) + np.repeat(cut[first] - to[:-1], size)]
    best = least_by_window(words, to, least)
    n = size - WINDOW + 1
    end = np.cumsum(n)
    out, at = [], 0
    for block, k in zip(table.column("block").to_pylist(), key, strict=True):
        i = inv[at : at + len(k)]
        at += len(k)
        w = np.arange(n[i].sum()) + np.repeat((end - n)[i] - np.cumsum(n[i]) + n[i], n[i])
        out.append((block, _pack(a=k, b=n[i], c=best[w])))
    return _table(block=pa.array([r[0] for r in out], pa.int64()), data=pa.array([r[1] for r in out], pa.binary()))


def _remove(keep: list[str], texts: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        release()
        got = [[np.frombuffer(x, t) for x, t in zip(_unpack(d), (U64, np.int64, np.int64), strict=True)] for d in found.column("data").to_pylist()]
        key = np.concatenate([np.zeros(0, U64), *(g[0] for g in got)])
        n = np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)])
        best = np.concatenate([np.zeros(0, np.int64), *(g[2] for g in got)])
        begin = np.cumsum(n) - n
        order = np.argsort(key)
        key, begin = key[order], begin[order]
        out: list[pa.RecordBatch] = []
        for part, x in _parts(table):
            gone = np.zeros(len(x.h) + 1, np.int64)
            if len(key) and len(x.begin):
                k = x.keys()
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                hit = np.flatnonzero(key[at] == k)
                m = x.windows[hit]
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                least = best[np.repeat(begin[at[hit]], m) + step]
                w = (np.repeat(x.begin[hit], m) + step)[least < np.repeat(x.doc[x.owner[hit]], m)]
                np.add.at(gone, w, 1)
                np.add.at(gone, w + WINDOW, -1)
            kept = np.cumsum(gone[:-1]) == 0
            words = np.flatnonzero(kept)
            data = spell(x.b, x.s[words], x.e[words], np.full(len(words), 32, np.uint8))
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(x.e[words] - x.s[words] + 1)])[np.searchsorted(words, x.first)].tolist()
            left = [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]
            total = np.diff(x.first)
            count = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[x.first])
            cols = {c: part.column(part.schema.get_field_index(c)) for c in keep}
            cols |= {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(total - count, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in left])}
            if texts:
                cols["kept"] = pa.array([t.decode() for t in left], pa.string())
            out.append(pa.RecordBatch.from_pydict(cols))
        return pa.Table.from_batches(out)

    return run


def dedup(docs: DataFrame, texts: bool = False, keep: list[str] | None = None, block: int = 8 << 20, shard: int = 4 << 20) -> DataFrame:
    """Remove every word that a window covers whose words also start in a document of smaller doc_id.

    Returns keep (doc_id by default), n_words, n_removed, kept_sha256 and, if asked, kept: the words left, joined by
    blanks. A null text has no words. A null doc_id counts as larger than all others; rows of equal doc_id remove nothing
    from each other. block and shard: bytes of text of a block and for each shard; they change no result.
    """
    keep = keep or ["doc_id"]
    types = dict(docs.dtypes) | {"doc_id": "bigint"}
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, shards = max(1, -(-total // block)), max(1, -(-total // shard))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(max(min(n, 10_000), min(spread, n)), "block")
    ship(docs.sparkSession)
    pair, send = "shard long, block long, data binary", "block long, data binary"
    flags = src.groupBy("block").applyInArrow(_anchors(shards), pair).groupBy("shard").applyInArrow(_repeated, send)
    sent = src.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_send(shards), pair)
    found = sent.groupBy("shard").applyInArrow(_search, send)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return src.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(keep, texts), schema)
