"""Toxic spans by a linear-chain conditional random field over words.

Tokens are runs of letters, digits and bytes of longer characters, lower-cased. Their features are the
word and its first 3 to 6 bytes, hashed into 2**BITS weights. The chain has two states. Labelled
tokens come from labelled documents: a token of a toxic one is a toxic token if a feature of it occurs
in far more toxic than other training documents. The chain is fitted to those labels by gradient steps
on the exact log-likelihood (forward-backward); marginals of all tokens add up to a document's
score by a logistic curve fitted to the documents' labels.

A text is one chain. All chains of a block advance together in stretches of STRETCH tokens, so that no loop runs along
a very long text: what a stretch does to the messages is a 2 x 2 matrix, the product of its steps, so those at
the ends of stretches come from a scan over a text's stretches. The marginals are those of the uncut chain.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import first_of_each, map_texts, models, remainder
from ravelin.llm.text import U64, column, mix, prefix_sums, raw, span_hashes, word_bounds

BITS = 19
STRETCH = 64
SHARE = 0.02
PREFIXES = (3, 4, 5, 6)
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def tokens(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (features x tokens), starts, ends, and the first token of each text (with the end)."""
    low = FOLD[b]
    s, e, first = word_bounds(low, off, BETWEEN)
    sums = prefix_sums(low)
    rows = [span_hashes(sums, s, e)]
    for k in PREFIXES:
        rows.append(mix(span_hashes(sums, s, np.minimum(s + k, e)) + U64(k)))
    return np.stack([(r >> U64(64 - BITS)).astype(np.int32) for r in rows]) if len(s) else np.zeros((len(rows), 0), np.int32), s, e, first


def stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token and length of each stretch, and its number within its text."""
    n = np.diff(first)
    parts = -(-n // STRETCH)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(first[:-1], parts) + nth * STRETCH, np.minimum(STRETCH, np.repeat(n, parts) - nth * STRETCH), nth


def _joints(m: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward message at the token before each stretch and the backward one at its last token, from what stretches do (2 x 2 x stretches)."""
    into, after = np.full((2, len(nth)), 0.5), np.ones((2, len(nth)))
    by = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[by], np.arange(1, nth.max() + 2))
    turns = [by[x:y] for x, y in zip(cut, cut[1:], strict=False)]
    for at in turns:
        x = np.einsum("ijw,iw->jw", m[:, :, at - 1], into[:, at - 1])
        into[:, at] = x / x.sum(0)
    for at in reversed(turns):
        x = np.einsum("ijw,jw->iw", m[:, :, at], after[:, at])
        after[:, at - 1] = x / x.sum(0)
    return into, after


def marginals(emit: np.ndarray, first: np.ndarray, go: np.ndarray, pairs: bool = False):
    """P(toxic) of each token, by forward-backward in the scaled (probability) domain.

    emit: the log-odds of the toxic state from each token alone; go: 2 x 2 transition scores.
    With pairs, also the expected number of each transition.
    """
    begin, size, nth = stretches(first)
    out = np.zeros(len(emit))
    trans = np.exp(go)
    count = np.zeros((2, 2))
    if not len(begin):
        return (out, count) if pairs else out
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    wide = np.searchsorted(-size, -np.arange(STRETCH), "left")
    wide = wide[wide > 0].tolist()
    e = np.clip(emit, -30, 30)
    psi = np.stack([np.exp(np.minimum(-e, 0)), np.exp(np.minimum(e, 0))])  # each over the larger, so none overflows
    # The step to the first token of a text says nothing of either state.
    enter = np.where(nth[order] > 0, trans[:, :, None], 1.0)
    into, after = np.full((2, len(begin)), 0.5), np.ones((2, len(begin)))
    if nth.any():
        m = enter * psi[:, begin]
        for i, w in enumerate(wide[1:], 1):
            x = np.einsum("aiw,ij->ajw", m[:, :, :w], trans) * psi[:, begin[:w] + i]
            m[:, :, :w] = x / x.sum((0, 1))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        into, after = (x[:, order] for x in _joints(m[:, :, back], nth))
    alphas, scales = [], []
    for i, w in enumerate(wide):
        x = (trans.T @ alphas[-1][:, :w] if i else np.einsum("ijw,iw->jw", enter, into)) * psi[:, begin[:w] + i]
        scales.append(x.sum(0))
        alphas.append(x / scales[-1])
    beta = np.zeros((2, len(begin)))
    done = 0
    for i in range(len(alphas) - 1, -1, -1):
        w = alphas[i].shape[1]
        ends = slice(done, w)
        beta[:, ends] = after[:, ends] / (alphas[i][:, ends] * after[:, ends]).sum(0)
        done = w
        g = alphas[i] * beta[:, :w]
        out[begin[:w] + i] = g[1] / g.sum(0)
        x = psi[:, begin[:w] + i] * beta[:, :w] / scales[i]
        if i:
            if pairs:
                count += (alphas[i - 1][:, :w] @ x.T) * trans
            beta[:, :w] = trans @ x
        elif pairs:
            inner = nth[order] > 0
            count += (into[:, inner] @ x[:, inner].T) * trans
    return (out, count) if pairs else out


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The log of the toxic tokens of each text: marginals of a half at least are added up."""
    mass = np.concatenate([np.zeros(1), np.cumsum(np.where(p >= 0.5, p, 0.0))])[first]
    return np.log1p(np.maximum(np.diff(mass), 0))


class Model:
    """Weights of the features, transitions, and the curve from marginals to scores."""

    def __init__(self, w: np.ndarray, bias: float, go: np.ndarray, curve: tuple[float, float]):
        self.w, self.bias, self.go, self.curve = w, bias, go, curve

    @classmethod
    def of(cls, data: bytes) -> Model:
        kept, key = models("toxicity"), hash(data)
        if key not in kept:
            x = np.load(io.BytesIO(data))
            w = np.zeros(1 << BITS, np.float32)
            w[x["at"]] = x["w"]
            kept.clear()
            kept[key] = cls(w, float(x["bias"]), x["go"], tuple(x["curve"]))
        return kept[key]

    def dump(self) -> bytes:
        at = np.flatnonzero(self.w)
        f = io.BytesIO()
        np.savez_compressed(f, at=at, w=self.w[at], bias=self.bias, go=self.go, curve=np.array(self.curve))
        return f.getvalue()

    def tag(self, b: np.ndarray, off: np.ndarray):
        """P(toxic) of each token, its bytes, and the first token of each text (with the end)."""
        x, s, e, first = tokens(b, off)
        emit = np.full(x.shape[1], self.bias)
        for row in x:
            emit += self.w[row]
        return marginals(emit, first, self.go), s, e, first

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A document's score from the marginals of its tokens."""
        a, c = self.curve
        return 1 / (1 + np.exp(-(a * evidence(p, first) + c)))


def fit(texts: list[str], toxic: list[int], steps: int = 40) -> Model:
    """Fit to whole labelled documents, of equal ones only the first. With one class only, every score is its constant."""
    seen: dict[str, int] = {}
    for t, v in zip(texts, toxic, strict=True):
        seen.setdefault(t, v)
    texts, y = list(seen), np.array(list(seen.values()), bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(1 << BITS, np.float32), -10.0, np.zeros((2, 2)), (0.0, 4.0 if len(y) and y.all() else -4.0))
    b, off = raw(pa.array(texts, pa.large_string()))
    x, _, _, first = tokens(b, off)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    df = np.zeros((2, 1 << BITS))
    for row in x:
        pair = np.unique(row.astype(np.int64) * len(y) + doc)
        for k in (0, 1):
            df[k] += np.bincount((pair // len(y))[y[pair % len(y)] == k], minlength=1 << BITS)
    odds = np.log((df[1] + 0.1) / (y.sum() + 1)) - np.log((df[0] + 0.1) / ((~y).sum() + 1))
    # Features of fewer documents than SHARE of a class say more about those documents than about the class.
    wanted = (df[1] >= np.maximum(3, SHARE * y.sum())) | (df[0] >= np.maximum(3, SHARE * (~y).sum()))
    odds[~wanted] = 0
    label = (odds[x].max(0) > 4.0) & y[doc]
    # Penalised maximum likelihood by Adagrad: the gradient is observed less expected counts.
    used = np.flatnonzero(wanted)
    slot = np.full(1 << BITS, len(used), np.int32)  # the last weight stays 0
    slot[used] = np.arange(len(used))
    xs = slot[x]
    used = np.append(used, -1)
    w, bias, go = np.append(np.clip(odds[used[:-1]] * 0.3, -1, 2), 0.0), -4.0, np.zeros((2, 2))
    gw, gb, gg = np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    inner = np.ones(len(label), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(label[at - 1].astype(int) * 2 + label[at], minlength=4).reshape(2, 2)
    n = len(label)
    for _ in range(steps):
        p, pairs = marginals(bias + w[xs].sum(0), first, go, True)
        r = label - p
        d = np.zeros(len(used))
        for row in xs:
            d += np.bincount(row, r, len(used))
        d -= 0.1 * w
        d[-1] = 0
        db, dg = r.sum() / n, (seen - pairs) / n
        gw, gb, gg = gw + d * d, gb + db * db, gg + dg * dg
        w, bias, go = w + 0.5 * d / np.sqrt(gw), bias + 0.5 * db / np.sqrt(gb), go + 0.1 * dg / np.sqrt(gg)
    full = np.zeros(1 << BITS, np.float32)
    full[used[:-1]] = w[:-1]
    model = Model(full, float(bias), go, (1.0, 0.0))
    p = marginals(bias + w[xs].sum(0), first, go)
    mass = evidence(p, first)
    a, c = 1.0, -1.0
    for _ in range(300):  # Newton's steps on two numbers, with a little shrinkage
        q = 1 / (1 + np.exp(-(a * mass + c)))
        h = q * (1 - q) + 1e-6
        g = np.array([((y - q) * mass).sum() - 0.01 * a, (y - q).sum() - 0.01 * c])
        hess = np.array([[(h * mass * mass).sum() + 0.01, (h * mass).sum()], [(h * mass).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, c = a + np.clip(step[0], -1, 1), c + np.clip(step[1], -1, 1)
    model.curve = (float(a), float(c))
    return model


def learn(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> Model:
    """Fit on a bounded sample: of the rows with a label, non-null text and crc32(doc_id) mod 3 other than 1, the first
    `rows` of each class by a hash of doc_id, with whole texts of any length. Of repeated labels of an id the greatest counts, of repeated
    texts of an id the least. Ties of the hash go by doc_id. Without labels of both classes every score is a constant.
    """
    y = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    y = y.filter(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = first_of_each(y, "toxic", rows, "toxic")
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(first), "doc_id")  # at most 2 * rows ids
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    return fit(got["text"].tolist(), got["toxic"].tolist())


def detect(docs: DataFrame, model: Model, spans: bool = False, cut: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.7 on) of every whole text of docs (null: empty).

    With spans, also the offending byte offsets: runs of tokens whose marginal is at least cut. Repeated rows and null ids stay, equal
    texts have equal scores, an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    data = model.dump()

    def run(part: pa.RecordBatch) -> dict:
        m = Model.of(data)
        p, s, e, first = m.tag(*raw(column(part)))
        score = m.score(p, first)
        out = {"doc_id": part.column(0), "score": score, "predicted": (score >= 0.7).astype(np.int32)}
        if spans:
            base = raw(column(part))[1]
            found = []
            for i in range(part.num_rows):
                hit = np.flatnonzero(p[first[i] : first[i + 1]] >= cut) + first[i]
                cuts = np.flatnonzero(np.diff(hit) > 1)
                found.append([{"begin": int(s[hit[x]] - base[i]), "end": int(e[hit[y]] - base[i])} for x, y in zip([0, *(cuts + 1)], [*cuts, len(hit) - 1], strict=True)] if len(hit) else [])
            out["spans"] = pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        return out

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(src, ["doc_id", "text"], run, "doc_id long, score double, predicted int" + ", spans array<struct<begin: long, end: long>>" * spans, of="toxicity")
