"""Vectors: normalisation, exact nearest neighbours by cosine, hashed embeddings, a proximity graph."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.lexical import ranked


def valid(v: Column, dims: int) -> Column:
    """Of the right length, finite, and not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    return F.coalesce((F.size(v) == dims) & ~F.exists(d, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()) & F.exists(d, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, none null, as a matrix; no Python object a number is made."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(flat)
    if n and pc.count_distinct(flat.value_lengths()).as_py() > 1:
        raise ValueError("vectors of different lengths")
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return x.reshape(n, len(x) // max(n, 1))


def usable(x: np.ndarray) -> np.ndarray:
    """Rows that are neither zero nor have a number that isn't finite."""
    size = np.linalg.norm(x, axis=1)
    return np.isfinite(size) & (size > 0)


#: Queries of a block, which goes to the tasks whole; cosines that a task has in memory; candidates it keeps before it hands them on.
BLOCK, TILE, HELD = 8192, 1 << 20, 1 << 19


class _Best:
    """The k best items so far of each query, equal ones by id."""

    def __init__(self, k: int, n: int):
        self.k, self.edge = k, np.full(n, -np.inf)  # what the k-th has, as far as there are k
        self.rows, self.names, self.score = np.empty(0, np.int64), np.empty(0, object), np.empty(0)

    def add(self, m: np.ndarray, x: np.ndarray, names: np.ndarray) -> None:
        rows, cols, score = [], [], []
        step = max(1, TILE // len(x))
        for a in range(0, len(m), step):
            cos = m[a : a + step] @ x.T
            fit = cos >= self.edge[a : a + step, None] - 1e-9  # the key is rounded; ties at the edge stay in
            if np.count_nonzero(fit) > 4 * self.k * len(cos) and cos.shape[1] > self.k:
                fit &= cos >= np.partition(cos, cos.shape[1] - self.k, axis=1)[:, -self.k, None] - 2e-9
            r, c = np.nonzero(fit)
            rows.append(r + a)
            cols.append(c)
            score.append(cos[r, c])
        rows = np.concatenate([self.rows, *rows])
        names = np.concatenate([self.names, names[np.concatenate(cols)]])
        score = np.concatenate([self.score, *score])
        key = np.round(score, 9)
        order = np.lexsort((names.astype(str), -key, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows = order[place < self.k], rows[place < self.k]
        self.rows, self.names, self.score = rows, names[order], score[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.edge[rows[last]] = key[order[last]]


def top_k(items: DataFrame, queries: DataFrame, k: int, by: list[str] | None = None, block: int = BLOCK, vectors=None) -> DataFrame:
    """(query_id, by, doc_id, score, rank): the k items (doc_id, vector, by) of greatest cosine to each query
    (query_id, vector), for each value of by if there are such columns. Vectors that are zero or not finite are no one's neighbours.
    vectors: a function that makes a matrix of an Arrow column, for items whose column `vector` isn't one yet.

    Queries go in blocks of `block`, each a matrix that tasks get once by a broadcast of that many vectors. A task multiplies its items, a few at
    a time, so that no more than TILE cosines are in memory, and keeps the k best of each query; that is what is shuffled. Items stay where
    they are; each block reads them again.
    """
    by = by or []
    spark = items.sparkSession
    types = dict(items.dtypes)
    schema = "query_id string, " + "".join(f"{c} {types[c]}, " for c in by) + "doc_id string, score double"
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").filter(F.col("vector").isNotNull())
    blocks = max(1, -(-asked.count() // block))
    some_rows, make = (256, vectors) if vectors else (4096, matrix)

    def near(sent):
        def local(batches):
            ids, m = sent.value
            best: dict[tuple, _Best] = {}
            names = ["query_id", *by, "doc_id", "score"]
            kinds: list = []

            def close():
                for key, b in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b.rows], pa.string()), *[pa.array([v] * len(b.rows), t) for v, t in zip(key, kinds, strict=True)], pa.array(b.names, pa.string()), pa.array(b.score)], names)
                best.clear()

            for batch in batches:
                kinds = [batch.schema.field(c).type for c in by]
                for a in range(0, batch.num_rows if len(ids) else 0, some_rows):
                    part = batch.slice(a, some_rows)
                    x = make(part.column("vector"))
                    ok = np.flatnonzero(usable(x))
                    doc = part.column("doc_id").cast(pa.string()).to_numpy(zero_copy_only=False).astype(object)[ok]
                    x = x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
                    groups: dict[tuple, list[int]] = {}
                    keys = list(zip(*[part.column(c).take(pa.array(ok)).to_pylist() for c in by], strict=True)) if by else [()] * len(ok)
                    for i, key in enumerate(keys):
                        groups.setdefault(key, []).append(i)
                    for key, at in groups.items():
                        best.setdefault(key, _Best(k, len(ids))).add(m, x[at] if by else x, doc[at] if by else doc)
                    if len(best) * len(ids) * min(k, 64) > HELD and len(best) > 1:
                        yield from close()
            yield from close()

        return local

    found = None
    some = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    for b in range(blocks):
        rows = some.filter(F.col("b") == b).select("query_id", "vector").toArrow()  # about `block` vectors
        m = matrix(rows.column("vector"))
        ok = usable(m)
        m = m[ok] / np.linalg.norm(m[ok], axis=1, keepdims=True)
        ids = np.array(rows.column("query_id").to_pylist(), object)[ok]
        part = items.select(*by, "doc_id", "vector").filter(F.col("vector").isNotNull()).mapInArrow(near(spark.sparkContext.broadcast((ids, m))), schema)
        found = part if found is None else found.unionByName(part)
    return ranked(found, ["query_id", *by], k)


WORDS = regex.compile(r"[\p{L}\p{N}]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def text_words(text: str) -> list[str]:
    """Runs of letters and numbers, in lower case character by character: no final sigma, and dotted I as i."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return WORDS.findall(text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower())  # lower() treats no other character by what is around it


_PRIME = np.uint64(0x100000001B3)


def _fnv(b: bytes, h: int = 0xCBF29CE484222325) -> int:
    for x in b:
        h = (h ^ x) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _fnv_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, prefix: bytes) -> np.ndarray:
    """FNV-1a of prefix and each span of data, all spans a byte at a time."""
    h = np.full(len(begin), _fnv(prefix), np.uint64)
    order = np.argsort(begin - end, kind="stable")  # the longest first
    b, n = begin[order], (end - begin)[order]
    out = h[order]
    for i in range(int(n[0]) if len(n) else 0):
        w = int(np.searchsorted(-n, -i, "left"))
        out[:w] = (out[:w] ^ data[b[:w] + i]) * _PRIME
    h[order] = out
    return h


def word_features(words: list[str], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and signed weights of the features of each word, one after the other, and where each word's begin, with the end."""
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode(), np.uint8)
    char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    chars = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(chars) - chars
    grams = chars - 2
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(grams + 1)])  # the word itself, then its grams
    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first, grams)
    h = np.empty(int(to[-1]), np.uint64)
    h[to[:-1]] = _fnv_spans(data, char[first] + 1, char[first + chars] - 1, b"word:")
    rest = np.ones(len(h), bool)
    rest[to[:-1]] = False
    h[rest] = _fnv_spans(data, char[at], char[at + 3], b"gram:")
    weight = np.where(rest, 0.5, 2.0)
    return (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), -weight, weight), to


def hash_embed(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """Bags of signed features, a row a text: words weigh 2, trigrams of ^word$ a half, slot 0 has 1. Sums are exact. Features are made once for each
    distinct word of a few hundred texts."""
    out = np.zeros((len(texts), dims))
    for a in range(0, len(texts), 256):
        some = texts[a : a + 256]
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        tokens: list[int] = []
        n = []
        for t in some:
            words = text_words(t or "")
            tokens.extend(map(seen.__getitem__, words))
            n.append(len(words))
        if seen:
            slot, weight, to = word_features(list(seen), dims)
            # Words of a text, with how often each is there.
            pair, times = np.unique(np.repeat(np.arange(len(some)), n) * len(seen) + np.array(tokens), return_counts=True)
            doc, word = pair // len(seen), pair % len(seen)
            f, size = _spread(to[word], np.diff(to)[word]), np.diff(to)[word]
            out[a : a + 256] = np.bincount(np.repeat(doc * dims, size) + slot[f], weight[f] * np.repeat(times, size), len(some) * dims).reshape(-1, dims)
    out[:, 0] += 1.0
    return out


def embedded(texts: pa.Array, dims: int = 256) -> np.ndarray:
    """hash_embed of an Arrow column."""
    return hash_embed(texts.to_pylist(), dims)


def embed(df: DataFrame, text: Column, dims: int = 256, name: str = "vector") -> DataFrame:
    """df with the hashed embedding of text."""

    @F.arrow_udf("array<float>")
    def run(s: pa.Array) -> pa.Array:
        parts = [hash_embed(s.slice(a, 256).to_pylist(), dims).astype(np.float32).ravel() for a in range(0, len(s), 256)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * dims), pa.array(np.concatenate([np.empty(0, np.float32), *parts])))

    # Otherwise a filter that the optimiser infers from an explode of the vectors would compute them a second time.
    return df.withColumn(name, run.asNondeterministic()(text))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of all runs (start, count), one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Graph:
    """A hierarchical proximity graph: ids set the levels, so equal items give equal graphs.

    Items of equal direction are one node, at the level of the highest of them. In each layer every node is linked with its m nearest there (twice as many in the
    lowest), both ways, without pruning, so that no node is cut off. The nearest are found by products of matrices, a block of nodes at a time.
    """

    BLOCK = 256

    def __init__(self, ids: list[str], x: np.ndarray, m: int = 16, width: int = 40):
        if m < 2 or width < m:
            raise ValueError("a node has two neighbours at least, and upper layers are searched as wide as they are many")
        self.width = width
        x = np.asarray(x, np.float64).reshape(len(ids), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        order = sorted(range(len(ids)), key=ids.__getitem__)
        _, first, node = np.unique(np.ascontiguousarray(np.round(x[order], 9) + 0.0).view(f"V{8 * x.shape[1]}").ravel() if len(ids) else np.empty(0), return_index=True, return_inverse=True)
        self.x = x[np.array(order, np.int64)[first]]
        self.members: list[list[str]] = [[] for _ in first]
        level = np.zeros(len(first), np.int64)
        for i, n in zip(order, node.tolist(), strict=True):
            self.members[n].append(ids[i])
            h = _fnv(ids[i].encode())
            level[n] = max(level[n], min(16, ((h & -h).bit_length() - 1) // 2 if h else 16))
        self.layers = []  # (nodes, where their links begin, links), the lowest first; nodes are numbers, links are places among nodes
        for n in range(17):
            nodes = np.flatnonzero(level >= n)
            if n and (not len(nodes) or len(nodes) == len(self.layers[-1][0])):
                break
            self.layers.append((nodes, *self._links(self.x[nodes].astype(np.float32), m if n else 2 * m)))
            if len(nodes) <= width:
                break

    def _links(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(x), min(m, len(x) - 1)
        if m < 1:
            return np.zeros(n + 1, np.int64), np.empty(0, np.int32)
        to = np.empty((n, m), np.int64)
        for a in range(0, n, self.BLOCK):
            s = x[a : a + self.BLOCK] @ x.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
            to[a : a + self.BLOCK] = np.argpartition(s, n - m, axis=1)[:, n - m :]
        pairs = np.repeat(np.arange(n), m) * n + to.ravel()
        pairs = np.unique(np.concatenate([pairs, pairs % n * n + pairs // n]))
        return np.searchsorted(pairs, np.arange(n + 1) * n), (pairs % n).astype(np.int32)

    def _beam(self, q: np.ndarray, at: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes (places in the layer, -1 where there are none) of each query and their cosines, from the places `at` on: as long as
        a query's beam holds nodes that weren't visited, the neighbours of the best of them come in."""
        nodes, begin, links = self.layers[layer]
        x = self.x[nodes]
        seen = np.zeros((len(q), len(nodes)), bool)
        rows, cols = np.nonzero(at >= 0)
        seen[rows, at[rows, cols]] = True
        best = np.full((len(q), max(width, at.shape[1])), -1, np.int64)
        score = np.full(best.shape, -np.inf)
        best[rows, cols] = at[rows, cols]
        score[rows, cols] = np.einsum("ij,ij->i", x[at[rows, cols]], q[rows])
        todo = best >= 0
        live = np.arange(len(q))
        while len(live):
            waiting = np.where(todo[live], score[live], -np.inf)
            place = waiting.argmax(axis=1)
            go = waiting[np.arange(len(live)), place] > -np.inf
            live, place = live[go], place[go]
            if not len(live):
                break
            todo[live, place] = False
            here = best[live, place]
            count = begin[here + 1] - begin[here]
            near = links[_spread(begin[here], count)]
            row = np.repeat(np.arange(len(live)), count)
            new = ~seen[live[row], near]
            row, near = row[new], near[new]
            seen[live[row], near] = True
            s = np.einsum("ij,ij->i", x[near], q[live[row]])
            fit = s > score[live].min(axis=1)[row]
            row, near, s = row[fit], near[fit], s[fit]
            if not len(row):
                continue
            some, n = np.unique(row, return_counts=True)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            r = np.repeat(np.arange(len(some)), n)
            extra, extra_s = np.full((len(some), n.max()), -1, np.int64), np.full((len(some), n.max()), -np.inf)
            extra[r, slot], extra_s[r, slot] = near, s
            which = live[some]
            all_s = np.concatenate([score[which], extra_s], axis=1)
            keep = np.argpartition(-all_s, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
            score[which] = np.take_along_axis(all_s, keep, 1)
            todo[which] = np.take_along_axis(np.concatenate([todo[which], extra >= 0], axis=1), keep, 1)
            best[which] = np.take_along_axis(np.concatenate([best[which], extra], axis=1), keep, 1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(best, keep, 1), np.take_along_axis(score, keep, 1)

    def search_all(self, q: np.ndarray, k: int, width: int = 40) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Rows of q, ids and cosines: the k found of greatest cosine to each, equal ones by id; k = 0 gives as many as the beam holds."""
        if width < 1 or k < 0:
            raise ValueError("a search is one wide at least, and k is not negative")
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q) if len(self.x) else 0, self.BLOCK):
            some = q[a : a + self.BLOCK]
            some = some / np.linalg.norm(some, axis=1, keepdims=True)
            top = len(self.layers) - 1
            at = np.broadcast_to(np.arange(min(len(self.layers[top][0]), self.width)), (len(some), min(len(self.layers[top][0]), self.width)))
            for layer in range(top, 0, -1):
                at, _ = self._beam(some, at, self.width, layer)
                at = np.where(at >= 0, np.searchsorted(self.layers[layer - 1][0], self.layers[layer][0][at]), -1)
            at, score = self._beam(some, at, max(width, k), 0)
            most = k or width
            for r in range(len(some)):
                found = sorted((-round(s, 9), i, s) for n, s in zip(at[r].tolist(), score[r].tolist(), strict=True) if n >= 0 for i in self.members[self.layers[0][0][n]][:most])[:most]
                out[0].extend([a + r] * len(found))
                out[1].extend(i for _, i, _ in found)
                out[2].extend(s for _, _, s in found)
        return np.array(out[0], np.int64), out[1], np.array(out[2], np.float64)

    def search(self, q: np.ndarray, k: int, width: int = 40) -> list[tuple[str, float]]:
        """search_all for one query."""
        _, ids, score = self.search_all(np.asarray(q, np.float64).reshape(1, -1), k, width)
        return list(zip(ids, score.tolist(), strict=True))


def graph_top_k(items: DataFrame, queries: DataFrame, k: int, width: int = 120, size: int = 20_000) -> DataFrame:
    """Approximate top_k: every item is in the graph of one hash partition of about `size` items; every query goes to each
    graph, and the k best of all count. Equal items and size give equal results. What is no one's neighbour in top_k isn't here either."""

    def build(items_: pa.Table, queries_: pa.Table) -> pa.Table:
        found: list = [[], [], []]
        if items_.num_rows and queries_.num_rows:
            x, q = matrix(items_.column("vector")), matrix(queries_.column("asked"))
            ok, asked = usable(x), usable(q)
            names = np.array(queries_.column("query_id").to_pylist(), object)[asked]
            g = Graph(np.array(items_.column("doc_id").to_pylist(), object)[ok].tolist(), x[ok])
            row, ids, score = g.search_all(q[asked], k, width)
            found = [names[row], ids, score]
        return pa.table({"query_id": pa.array(found[0], pa.string()), "doc_id": pa.array(found[1], pa.string()), "score": pa.array(found[2], pa.float64())})

    parts = max(1, -(-items.count() // size))
    a = items.select("doc_id", "vector", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")).filter(F.col("vector").isNotNull())
    # New names and keys: both sides may come from one table, and a cogroup tells columns apart by what they come from.
    b = queries.select("query_id", F.col("vector").alias("asked")).filter(F.col("vector").isNotNull()).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return ranked(a.groupBy("part").cogroup(b.groupBy("part")).applyInArrow(build, "query_id string, doc_id string, score double"), ["query_id"], k)
