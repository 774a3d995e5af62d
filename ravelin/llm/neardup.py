"""Near-duplicate detection by Order MinHash.

A document's shingles are K consecutive words, each labelled with how often it occurred before in the document. For
each of BANDS seeds the ELL labelled shingles of least hash are taken and put back into text order; the hash of that
sequence is a bucket. Documents of one bucket are candidates. Two candidates are near copies if a banded alignment of
their words matches at least LIKE of the words of the longer one, in order.

Equal word sequences are one class from the start and go on as one document. Pairs are never listed by bucket: in each of
ROUNDS rounds a bucket's first document that has not led yet is compared with the members that are not yet of its class,
and buckets of one class are done. Members that no leader explains are compared with each other inside tasks that
return links only: those of buckets of up to TILE members directly. Members of larger buckets meet where they share one of their
rarest words: texts that have LIKE of their words in common share one of the rarest 1 - LIKE, whatever order says what
is rare, so no link is lost, and texts with one passage in common don't meet. Groups that are large even so are cut by length
and compared tile by tile.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import map_texts, materialize, release, ship
from ravelin.llm.text import BASE, U64, blocks, column, gram_hashes, inside, mix, owners, prefix_sums, raw, span_hashes, word_bounds, word_hashes

K, ELL, BANDS, LIKE = 5, 2, 24, 0.8
ROUNDS, TILE = 3, 2048
#: Steps that labels take between rounds: classes may come in parts there, which costs comparisons only. The last labels are whole.
STEPS = 1
#: Words of the texts of a tile, but for one longer text.
WORDS = 2_000_000
#: Counters that say how rare words are, of a fixed size whatever the input, and the spans of them that are added up apart.
COUNTERS, SPANS = 1 << 22, 64
#: What a counter has: hits, the least and the greatest class.
COUNTED = "span int, salt int, at binary, n binary, low binary, high binary"
#: Buckets of more members than HOT are joined by a broadcast of at most MANY of them.
HOT, MANY = 1000, 100_000
MOST = U64(2**64 - 1)


def sequence_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence."""
    pos = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(U64)
    out = []
    for k in (1, 2):
        x = mix(h ^ mix(pos + U64(k << 40)))
        s = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])[first]
        out.append(mix(s[1:] - s[:-1] + np.diff(first).astype(U64)))
    return np.stack(out)


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text (texts x BANDS), and which texts have any: those of K words at least."""
    ok = inside(first, K)
    g, own = gram_hashes(h, K)[ok], owners(first)[: len(ok)][ok]
    has = np.zeros(len(first) - 1, bool)
    has[own] = True
    if not len(g):
        return np.zeros((0, BANDS), U64), has
    order = np.lexsort((g, own))
    new = np.ones(len(g), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (own[order][1:] != own[order][:-1])
    at = np.flatnonzero(new)
    label = np.empty(len(g), U64)
    label[order] = mix(g[order] + (np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))).astype(U64) * BASE)
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    size = np.diff(np.append(begin, len(g)))
    out = np.empty((len(begin), BANDS), U64)
    for band in range(BANDS):
        x = mix(label ^ mix(np.full(1, band + 1, U64) * BASE))
        places = np.full((ELL, len(begin)), len(g), np.int64)
        for j in range(ELL):
            least = np.minimum.reduceat(x, begin)
            hit = np.flatnonzero(x == np.repeat(least, size))
            hit = hit[x[hit] != MOST]
            who = np.searchsorted(begin, hit, "right") - 1
            places[j, who[::-1]] = hit[::-1]
            x[hit] = MOST
        places.sort(axis=0)
        key = np.full(len(begin), band, U64)
        every = np.append(label, U64(0))
        for row in places:
            key = mix(key * BASE + every[row])
        out[:, band] = key
    return out, has


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two multisets of hashes."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def aligned(a: list, b: list, need: int) -> bool:
    """Whether an alignment matches `need` words of a and b, in order.

    Such an alignment leaves len(a) - need words of a and len(b) - need of b over, so it stays in a band of as many diagonals. A row of the
    band is one integer: bit i is 0 where the best alignment up to there has one match more than before it.
    """
    n, m = len(a), len(b)
    over, under = n - need, m - need
    if over < 0 or under < 0 or need <= 0:
        return need <= 0
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    width = over + under + 1
    full = (1 << width) - 1
    row, low, gone = full, -under, 0  # bit 0 of row stands for word `low` of a; `gone` are the matches left of the band
    for j, w in enumerate(b):
        if j:
            gone += ~row & 1
            row = row >> 1 | 1 << width - 1
            low += 1
        x = masks.get(w)
        if x:
            x = (x >> low if low > 0 else x << -low) & full
            hit = row & x
            row = (row + hit | row - hit) & full
        if not j & 63 and gone + width - row.bit_count() + m - j - 1 < need:
            return False
    return gone + width - row.bit_count() >= need


def needed(n: int, m: int) -> int:
    """The words that near copies of n and m words have in common."""
    return int(np.ceil(LIKE * max(n, m) - 1e-9))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences (hashes) are near copies. What has fewer than K words has equal ones only."""
    n, m = len(a), len(b)
    if min(n, m) < K:
        return n == m and bool((a == b).all())
    need = needed(n, m)
    if min(n, m) < need or shared(a, b) < need:
        return False
    # What both begin and end with is part of a best alignment.
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(differ[0]) if len(differ) else k - head
    return aligned(a[head : n - tail].tolist(), b[head : m - tail].tolist(), need - head - tail)


def _sketch(docs: DataFrame) -> DataFrame:
    def run(part: pa.RecordBatch) -> dict:
        h, first = word_hashes(column(part))
        keys = sequence_keys(h, first).view(np.int64)
        n = np.diff(first)
        words = n > 0
        got, has = sketches(h, first)
        rows = np.cumsum(has) - 1
        out = {"doc_id": part.column(0), "n": pa.array(n, pa.int64())}
        for i in (0, 1):
            out[f"k{i + 1}"] = pa.array(keys[i], mask=~words)
        return out | {"buckets": pa.array([got[r].view(np.int64) if x else None for r, x in zip(rows, has, strict=True)], pa.list_(pa.int64()))}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    return map_texts(src, ["doc_id", "text"], run, "doc_id long, n long, k1 long, k2 long, buckets array<long>", 512 << 10)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1 << 20, "ta"):
                ha, fa = word_hashes(column(part, "ta"))
                hb, fb = word_hashes(column(part, "tb"))
                ok = [alike(ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (part.column(0), part.column(1))], ["a", "b"])
        release()

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    ship(pairs.sparkSession)
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """node, comp of each end of the links (a, b): the least node reachable. Labels spread along links and then jump to
    the label of their label, until nothing changes. After a number of `steps` instead, comp is a node that is reachable, the least one
    maybe not; the least node's comp is itself even then."""
    ends = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialize(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while steps is None or steps:
        near = ends.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = new.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = materialize(new.join(up, "comp", "left").select("node", "old", F.coalesce("top", "comp").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if steps is not None:
            steps -= 1
        elif not new.filter("old <> comp").limit(1).count():
            break
    return labels


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b) as links of the comps of their ends, without those inside one."""
    x = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("c")), "a", "left")
    x = x.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("d")), "b", "left")
    return x.select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b")).filter("a <> b")


def merged(labels: DataFrame | None, links: DataFrame, steps: int | None = None) -> DataFrame:
    """labels (node, comp) after further links (a, b): only the comps that links join are labelled anew."""
    if labels is None:
        return components(links, steps)
    between = materialize(_between(links, labels), "between")
    if not between.limit(1).count():
        return labels
    new = components(between, steps)
    old = labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return materialize(old.unionByName(new.join(labels.select("node"), "node", "left_anti").select("node", "comp")), "labels")


def labelled(h: np.ndarray) -> np.ndarray:
    """The words of one text, the k-th occurrence of each as a value of its own: common values count a multiset's intersection."""
    g = np.sort(h)
    at = np.flatnonzero(np.diff(g, prepend=g[:1] + U64(1)))
    return mix(g + (np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))).astype(U64) * BASE)


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The size of the intersection of each two sets, as products of 0/1 matrices of the values that two sets have."""
    own = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(n > 1) - 1
    keep = (n > 1)[col]
    own, col = own[keep], name[col[keep]]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        x, y = np.searchsorted(col, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[own[x:y], col[x:y] - at] = 1
        out += m @ m.T
    return out


def with_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with table (bucket, n, ...), a row for each bucket. The members of buckets of over HOT members stay where they are."""
    table = materialize(table, "table")
    hot = table.filter(F.col("n") > HOT)
    if not 0 < hot.limit(MANY + 1).count() <= MANY:
        return rows.join(table, "bucket")
    marked = rows.join(F.broadcast(hot.select("bucket", F.lit(True).alias("hot"))), "bucket", "left")
    cold = marked.filter("hot is null").drop("hot").join(table.filter(F.col("n") <= HOT), "bucket")
    return cold.unionByName(marked.filter("hot").drop("hot").join(F.broadcast(hot), "bucket"))


def _places(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each value."""
    down = U64(65 - COUNTERS.bit_length())
    return (g >> down).astype(np.int64), (mix(g) >> down).astype(np.int64)


def _no_hits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(size, np.int64), np.full(size, 2**63 - 1), np.full(size, -(2**63))


def _hit_rows(span: int, n: np.ndarray, low: np.ndarray, high: np.ndarray, salt: int):
    """One row of the counters of a span that were hit, if any was."""
    at = np.flatnonzero(n)
    if len(at):
        arrays = {"at": at.astype(np.int32), "n": n[at], "low": low[at], "high": high[at]}
        yield pa.RecordBatch.from_pydict({"span": pa.array([span], pa.int32()), "salt": pa.array([salt], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})


def _summed(batches) -> dict:
    """The counters of each span of a task's rows."""
    spans: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            n, low, high = spans.setdefault(row["span"], _no_hits(COUNTERS // SPANS))
            at = np.frombuffer(row["at"], np.int32)
            n[at] += np.frombuffer(row["n"], np.int64)
            low[at] = np.minimum(low[at], np.frombuffer(row["low"], np.int64))
            high[at] = np.maximum(high[at], np.frombuffer(row["high"], np.int64))
    return spans


def _added(batches):
    for span, of in _summed(batches).items():
        yield from _hit_rows(span, *of, 0)


def _levels(batches):
    """span, level: 0 where a counter's hits are of one class, or else their number, 255 at most."""
    for span, (n, low, high) in _summed(batches).items():
        level = np.where(low == high, 0, np.minimum(n, 255)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"span": pa.array([span], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})


def rarest(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, rep, comp, n): the reps (rep, comp, n) by those of their rarest words that another one may have as well.

    Two multisets of n and m values with LIKE of the greater number in common share one of the first n - LIKE n + 1 of the one and
    as many of the other, by any order of the values. Values of one class come first: they take up places but no row, as they are in no text
    of another class. A value is of one class if one of its two counters was hit by one class only. The others are in the order of how often
    the counters were hit, then by value.
    """
    src = texts.withColumnRenamed("doc_id", "rep").join(reps, "rep").select("rep", "comp", "n", "text")

    def values(part: pa.RecordBatch) -> list[np.ndarray]:
        h, first = word_hashes(column(part))
        return [labelled(h[first[i] : first[i + 1]]) for i in range(part.num_rows)]

    def hits(batches):
        n, low, high = _no_hits(COUNTERS)
        some, salt = 0, 0
        for batch in batches:
            for part in blocks(batch, 1 << 20):
                sets = values(part)
                comp = part.column(part.schema.get_field_index("comp")).to_numpy()
                some, salt = some + part.num_rows, int(comp[0]) % 32
                comp = np.repeat(comp, [len(v) for v in sets])
                for at in _places(np.concatenate(sets)):
                    np.add.at(n, at, 1)
                    np.minimum.at(low, at, comp)
                    np.maximum.at(high, at, comp)
        size = COUNTERS // SPANS
        for span in range(SPANS if some else 0):
            yield from _hit_rows(span, *(x[span * size : (span + 1) * size] for x in (n, low, high)), salt)
        release()

    spark = src.sparkSession
    counts = src.select("comp", "text").mapInArrow(hits, COUNTED)
    counts = counts.repartition("span", "salt").mapInArrow(_added, COUNTED).repartition("span").mapInArrow(_levels, "span int, level binary")
    often = np.zeros((SPANS, COUNTERS // SPANS), np.uint8)
    for r in counts.collect():  # a byte a counter
        often[r["span"]] = np.frombuffer(r["level"], np.uint8)
    often = spark.sparkContext.broadcast(often.reshape(-1))

    def first_values(part: pa.RecordBatch) -> dict:
        c = often.value
        rows, keys = [], []
        for i, g in enumerate(values(part)):
            f = np.minimum(*(c[at] for at in _places(g)))
            at = np.lexsort((g, f))[: len(g) - needed(len(g), len(g)) + 1]
            at = at[f[at] > 0]
            rows.append(np.full(len(at), i))
            keys.append(g[at])
        i = pa.array(np.concatenate(rows))
        return {"bucket": np.concatenate(keys).view(np.int64)} | {k: part.column(part.schema.get_field_index(k)).take(i) for k in ("rep", "comp", "n")}

    return map_texts(src, ["rep", "comp", "n", "text"], first_values, "bucket long, rep long, comp long, n long")


def _sized(members: DataFrame) -> DataFrame:
    """(bucket, parts) of buckets with members of several classes: the tiles whose members and words are bounded."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / WORDS)).cast("long")
    return members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), parts.alias("parts"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", F.col("size").alias("n"), "parts")


def _tiles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within buckets (bucket, rep, comp, n), between members of different comp.

    A bucket of one tile is one task's; a larger one is cut by length (near copies are of one length class or of two next to each
    other) and each class, with the one below it, into tiles that meet each other.
    """
    sizes = _sized(members.select("bucket", "rep", "comp", "n"))
    sizes = sizes.withColumnRenamed("n", "size")
    x = members.select("bucket", "rep", "comp", F.col("n").alias("words")).join(sizes, "bucket")
    step = F.floor(F.log(F.col("words").cast("double")) / float(-np.log(LIKE)) + 1e-9).cast("long")
    low = x.filter("parts = 1").select("bucket", F.lit(-1).cast("long").alias("cls"), F.lit(-1).cast("long").alias("own"), "rep", "comp", "words")
    high = x.filter("parts > 1").withColumn("own", step).withColumn("cls", F.explode(F.array(F.col("own"), F.col("own") + 1))).select("bucket", "cls", "own", "rep", "comp", "words")
    again = high.groupBy("bucket", "cls").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("words") / WORDS)).cast("long").alias("parts"), F.max("own").alias("top"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b and top = cls").select("bucket", "cls", "parts")
    high = high.join(again, ["bucket", "cls"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("parts")))
    high = high.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cols = ["bucket", "cls", "own", "rep", "comp", "x", "y"]
    high = high.withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other")).select(*cols)
    zero = F.lit(0).cast("long")
    every = low.withColumn("x", zero).withColumn("y", zero).select(*cols).unionByName(high)
    every = every.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def run(table: pa.Table) -> pa.Table:
        part = table.combine_chunks().to_batches()[0]
        h, first = word_hashes(column(part))
        rep, comp, own, cls = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("rep", "comp", "own", "cls"))
        words = [h[first[i] : first[i + 1]] for i in range(len(rep))]
        n = np.array([len(v) for v in words])
        top = {int(c): int(c) for c in comp}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        need = np.ceil(LIKE * np.maximum(n[:, None], n[None]) - 1e-9)
        new = (own == cls)[:, None] | (own == cls)[None]  # two of the class below meet there
        found = np.argwhere(np.triu((overlaps([labelled(w) for w in words]) >= need) & (comp[:, None] != comp[None]) & new, 1))
        out = []
        for i, j in found:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and alike(words[i], words[j]):  # one link joins two classes
                top[a] = b
                out.append(sorted((int(rep[i]), int(rep[j]))))
        release()
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    ship(members.sparkSession)
    return every.groupBy("bucket", "cls", "x", "y").applyInArrow(run, "a long, b long")


def _unexplained(work: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of different comp of the buckets of work (bucket, rep, comp, n, size), that no leader gave."""
    small = work.filter(F.col("size") <= TILE).select("bucket", "rep", "comp", "n")
    reps = materialize(work.filter(F.col("size") > TILE).select("rep", "comp", "n").distinct(), "reps")
    if reps.limit(1).count():
        small = small.unionByName(materialize(rarest(reps, texts), "rarest"))
    return _tiles(small, texts)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (rep, lead) whose ends are not of one class."""
    x = pairs.join(labels.select(F.col("node").alias("rep"), F.col("comp").alias("c")), "rep", "left")
    x = x.join(labels.select(F.col("node").alias("lead"), F.col("comp").alias("d")), "lead", "left")
    return x.filter(F.coalesce("c", "rep") != F.coalesce("d", "lead")).select("rep", "lead")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id of its near-duplicate class, of each document.

    A document without words, a null text among them, is a class of its own, as is one with no near copy. Rows of
    equal doc_id are one document, with one row in the result; a null doc_id has none. An empty table gives an empty result.
    Near copies that share none of the BANDS buckets, with each other or over others of their class, are missed: few above 0.9, more towards LIKE.
    """
    sk = materialize(_sketch(docs), "sketch")
    exact = materialize(sk.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("words"), F.first("buckets").alias("buckets")), "exact")
    rows = exact.filter("buckets is not null").select("rep", "words", F.explode("buckets").alias("bucket")).distinct()
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(with_table(rows, many), "members")
    # A text in whose buckets many others are is near the middle of its group and explains most of it.
    central = materialize(members.groupBy("rep").agg(F.sum("n").alias("weight")), "central")
    members = members.drop("n").join(central, "rep").select("bucket", "rep", "words", "weight")
    wanted = central.select(F.col("rep").alias("doc_id"))
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id"), "texts")
    left = members.withColumn("comp", F.col("rep"))
    links, labels = [], None
    for turn in range(ROUNDS + 1):
        # Only buckets of several classes have something to compare; those that have led are done with every other.
        order = -F.col("weight") if turn < ROUNDS - 1 else F.xxhash64("rep")
        open_ = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(order.alias("order"), "rep", "comp", "words")).alias("lead")).filter("low <> high")
        open_ = open_.select("bucket", "n", F.col("lead.rep").alias("lead"), F.col("lead.comp").alias("lead_comp"), F.col("lead.words").alias("lead_words"), F.col("lead.order").alias("order"))
        work = materialize(with_table(left, open_), "work")
        if not work.limit(1).count():
            break
        if turn == ROUNDS:
            found = _unexplained(work.select("bucket", "rep", "comp", F.col("words").alias("n"), F.col("n").alias("size")), texts)
        else:
            near = F.least("words", "lead_words") >= F.ceil(LIKE * F.greatest("words", "lead_words") - 1e-9)
            pairs = materialize(work.filter((F.col("comp") != F.col("lead_comp")) & near).groupBy("rep", "lead").agg(F.min("order").alias("order")), "pairs")
            # Each member meets its first leader; then only pairs that are not of one class yet meet, so that a large group has few links.
            found = materialize(_verify(_ordered(pairs.groupBy("rep").agg(F.min_by("lead", F.struct("order", "lead")).alias("lead"))), texts), "found")
            if found.limit(1).count():
                links.append(found)
                labels = merged(labels, found, STEPS)
            found = _verify(_ordered(pairs if labels is None else _apart(pairs, labels)), texts)
        found = materialize(found.distinct(), "found")
        if found.limit(1).count():
            links.append(found)
            labels = merged(labels, found, STEPS) if turn < ROUNDS else labels
        if turn < ROUNDS:
            left = work.filter("rep <> lead").select("bucket", "rep", "words", "weight", "comp")
            if labels is not None:
                left = left.drop("comp").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "words", "weight", F.coalesce("comp", "rep").alias("comp"))
            left = materialize(left, "left")
    if links:  # what the labels of the rounds left apart
        labels = merged(labels, reduce(DataFrame.unionByName, links))
    else:
        labels = exact.select(F.col("rep").alias("node"), F.col("rep").alias("comp"))
    top = exact.select("k1", "k2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("class_id"))
    return sk.select("doc_id", "k1", "k2").join(top, ["k1", "k2"], "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose class has one of smaller doc_id. Rows without doc_id stay.

    Where ids repeat, each distinct text of an id is judged by itself, and one row of each stays at most.
    """
    known = docs.filter(F.col("doc_id").cast("long").isNotNull())
    if not known.groupBy(F.col("doc_id").cast("long")).count().filter("count > 1").limit(1).count():
        gone = classes(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    # Keys of rows in the order of ids; the hash deals out what one id has.
    order = [F.col("doc_id").cast("long"), F.xxhash64("text")]
    keyed = known.dropDuplicates(["doc_id", "text"]).repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = materialize(keyed.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    gone = classes(keyed.select(F.col("_key").alias("doc_id"), "text")).filter("class_id <> doc_id").select(F.col("doc_id").alias("_key"))
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))
