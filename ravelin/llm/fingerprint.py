"""Fingerprints of improbable features, in the manner of similarity digests for files.

Every WINDOW bytes of a text have an entropy. How rare each entropy is over all windows of all texts gives a
window's rank; in each run of SPAN windows the rarest, first of equal ones, gains a point, and windows
with at least POINTS points are the text's features. Their hashes go into chained Bloom filters of
FILTER_BITS bits, FULL features each. Two fingerprints are compared filter by filter: the
overlap of bits beyond what chance gives, over the most there could be.

Entropies are sums of integers, moved along by the byte that comes and the one that goes, whose counts within
the window come from comparing the text with itself at each distance: no sort, no loop over bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import map_texts, materialize, release, ship
from ravelin.llm.text import U64, blocks, column, prefix_sums, raw, span_hashes

WINDOW = 64
SPAN = 64
POINTS = 16
FILTER_BITS = 2048
HASHES = 5
FULL = 160
LEVELS = 512
CUTS = 256
#: A list of at most so many runs, three numbers each, is broadcast.
MANY = 100_000
#: Runs whose heads one task puts in order.
STEP = 10_000

_c = np.arange(1, WINDOW + 1)
_f = np.concatenate([[0], np.round(_c * np.log2(_c) * 65536).astype(np.int64)])
#: What the sum of c log2 c gains when a byte's count goes from c to c + 1.
GAIN = (_f[1:] - _f[:-1]).astype(np.int32)
_MOST = int(_f[WINDOW])


def entropies(b: np.ndarray) -> np.ndarray:
    """The entropy level (0 to LEVELS - 1) of each window of b; none if b is shorter than a window."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    out = np.empty(n - WINDOW + 1, np.int16)
    step = 1 << 15
    for at in range(0, len(out), step):  # what the processor's cache holds
        part = b[at : at + step + WINDOW - 1]
        m = len(part)
        came, went = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
        for d in range(1, WINDOW):
            same = (part[d:] == part[:-d]).view(np.uint8)
            came[d:] += same
            went[:-d] += same
        s = np.cumsum(GAIN[came], dtype=np.int64)
        s[WINDOW:] -= np.cumsum(GAIN[went[: m - WINDOW]], dtype=np.int64)
        out[at : at + step] = ((_MOST - s[WINDOW - 1 :]) * (LEVELS - 1) // _MOST).astype(np.int16)
    return out


def features(b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes of the selected windows, in order. A text shorter than a window is one feature; an empty one has none."""
    n = len(b)
    if not n:
        return np.zeros(0, U64)
    sums = prefix_sums(b)
    if n < WINDOW:
        return span_hashes(sums, np.array([0]), np.array([n]))
    key = (rank[entropies(b)].astype(np.int64) << 32) + np.arange(n - WINDOW + 1)
    wide, least = 1, key
    while wide * 2 <= SPAN and len(least) > wide:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    points = np.bincount((least & 0xFFFFFFFF).astype(np.int64), minlength=len(key))
    at = np.flatnonzero(points >= min(POINTS, len(least)))
    h = span_hashes(sums, at, at + WINDOW)
    return h[np.sort(np.unique(h, return_index=True)[1])]


def digest(h: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (filters x bytes) of the features, in their order."""
    k = max(1, -(-len(h) // FULL))
    bits = np.zeros((k, FILTER_BITS), np.uint8)
    row = np.arange(len(h)) // FULL
    for i in range(HASHES):
        bits[row, ((h >> U64(11 * i)) & U64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    """0 to 1: the mean over the filters of the shorter chain of the best normalised bit overlap with one of the other.

    Two texts without features are alike; one without and one with are not.
    """
    if not na or not nb:
        return float(na == nb)
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    both, p, q = x @ y.T, x.sum(1)[:, None], y.sum(1)[None]
    least = np.minimum(p, q)
    chance = p * q / FILTER_BITS
    best = np.clip((both - chance) / np.maximum(least - chance, 1e-9), 0, 1).max(1)
    return float(np.average(best, weights=p[:, 0]))


def encode(filters: np.ndarray, n: int) -> str:
    """A fingerprint as text: the number of features, then each filter in hexadecimal."""
    return f"{n}:" + ":".join(row.tobytes().hex() for row in filters)


def rarity(docs: DataFrame) -> list[int]:
    """The rank of each entropy level: 0 for the rarest, over all windows of all texts. At most LEVELS counts reach the driver."""

    def run(part: pa.RecordBatch) -> dict:
        b, off = raw(column(part))
        e = entropies(b)
        ok = np.ones(len(e), bool)
        for end in off[1:-1]:
            ok[max(0, end - WINDOW + 1) : end] = False
        n = np.bincount(e[ok], minlength=LEVELS)
        at = np.flatnonzero(n)
        return {"level": at.astype(np.int32), "n": n[at]} if len(at) else {}

    counts = map_texts(docs.select(F.col("text").cast("string").alias("text")), ["text"], run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in counts:
        n[r["level"]] = r["n"]
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return rank.tolist()


def edited(text: str, after: str) -> str:
    """text with its last third of code points replaced by the first as many of after, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def chain(docs: DataFrame, size: int = 4000) -> DataFrame:
    """Each row with the text of the next by descending doc_id (equal ids by text, null ids last; after the last the first).

    The ids are cut at up to CUTS quantiles, and evenly between those, into runs of about `size` rows. Each run is
    sorted on its own with one more row, the first of the next run, so no order is global and a task
    streams through its run. Equal ids stay in one run.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    n = src.count()
    runs = max(1, -(-n // size))
    cuts = min(runs, CUTS)
    fine = -(-runs // cuts)
    at = src.filter(F.col("doc_id").isNotNull()).select(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 100_000).alias("q")).first()["q"] if runs > 1 else None
    where = F.lit(0).cast("long")
    if at:  # at[i] <= key <= at[i + 1]; null ids come before all
        edge = F.array(*[F.lit(c).cast("long") for c in at])
        i = F.aggregate(F.array(*[F.lit(c).cast("long") for c in at[1:-1]]) if cuts > 1 else F.array().cast("array<long>"), F.lit(0), lambda s, c: s + (key > c).cast("int"))
        low, high = F.element_at(edge, i + 1).cast("double"), F.element_at(edge, i + 2).cast("double")
        part = F.least(F.greatest(F.floor((key.cast("double") - low) * fine / F.greatest(high - low, F.lit(1.0))), F.lit(0)), F.lit(fine - 1))
        where = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(i.cast("long") * fine + part)
    # A head is a run's first row; what stands after a run is the head of the next run that has rows. Runs are numbered from 0 (null
    # ids: -1), so heads of STEP numbers are put in order together, and the group's own first head goes on to the next groups.
    src = src.withColumn("run", where)
    heads = materialize(src.groupBy("run").agg(F.max(key).alias("k")).withColumn("g", F.expr(f"(run + 1) div {STEP}")), "heads")  # a row for each run
    tops = heads.groupBy("g").agg(F.max(F.struct("run", "k")).alias("top"))  # a row for each STEP runs
    every = tops.agg(F.max("top").alias("last"), F.array_sort(F.collect_list(F.struct("g", "top"))).alias("tops"))
    below = F.lag(F.struct("run", "k")).over(Window.partitionBy("g").orderBy("run"))
    heads = heads.withColumn("after", below).crossJoin(F.broadcast(every))  # one row, of one number for each STEP runs
    earlier = F.filter("tops", lambda t: t["g"] < F.col("g"))
    heads = heads.select(F.col("run").alias("to"), F.coalesce("after", F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["top"]), "last").alias("after"))
    heads = heads.select("to", F.col("after.run").alias("run"), F.col("after.k").alias("k"))
    heads = F.broadcast(heads) if runs <= MANY else heads
    extra = src.withColumn("k", key).join(heads, ["run", "k"]).groupBy("to").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("run"), F.lit(1).alias("tail"))

    def run(batches):
        held = None
        for batch in batches:
            ids, texts, which, tail = (batch.column(i).to_pylist() for i in range(4))
            out = ([], [], [])
            for row in zip(ids, texts, which, tail, strict=True):
                if held is not None and held[2] == row[2]:
                    for to, v in zip(out, (held[0], held[1], row[1]), strict=True):
                        to.append(v)
                held = None if row[3] else row
            for at in range(0, len(out[0]), 500):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out[0][at : at + 500], pa.int64()), "text": out[1][at : at + 500], "next": out[2][at : at + 500]})

    rows = src.withColumn("tail", F.lit(0)).unionByName(extra)
    dealt = rows.repartition(min(runs, 100_000), "run").sortWithinPartitions("run", "tail", F.desc_nulls_last("doc_id"), "text")
    ship(docs.sparkSession)
    return dealt.select("doc_id", "text", "run", "tail").mapInArrow(run, "doc_id long, text string, next string")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of docs (null: empty), its edited text, and how alike they and the next document's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Repeated rows stay;
    a table of one row has itself for its next.
    """
    ranks = rarity(docs)

    def run(batches):
        rank = np.array(ranks)
        known: dict[str, tuple] = {}

        def of(text: str) -> tuple:
            if text not in known:
                h = features(np.frombuffer(text.encode(), np.uint8), rank)
                f = digest(h)
                if len(known) > 64:
                    known.clear()
                known[text] = f, len(h), encode(f, len(h))
            return known[text]

        for batch in batches:
            for part in blocks(batch):
                ids, texts, after = (part.column(i).to_pylist() for i in range(3))
                rows = []
                for i, text, nxt in zip(ids, texts, after, strict=True):
                    new = edited(text, nxt)
                    a, b, c = of(text), of(new), of(nxt)
                    rows.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a[2], b[2], likeness(*a[:2], *b[:2]), likeness(*a[:2], *c[:2])))
                names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
                cols = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                yield pa.RecordBatch.from_pydict(cols | {"doc_id": pa.array(cols["doc_id"], pa.int64())})
        release()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return chain(docs).mapInArrow(run, schema)
