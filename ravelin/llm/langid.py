"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed from left to right
into the longest phrases that occur in a language's text; the language whose phrases, weighed by
the bits that name one, take the fewest bits a letter wins. A state is named by the place of its row in one
packed table of edges, so all texts of a block and all languages advance together, a letter at a time, in numpy.

A text is one parse from its first letter to its last. So that no loop runs along a very long text, it is parsed
in stretches of STEPS letters at once, first each from the root; then each stretch whose start was not
where the one before it ended is parsed again from there, to where both parses are in one state, until all fit
together. The result is that of the uncut parse.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.shared import map_texts, models, remainder
from ravelin.llm.text import column, raw

STEPS, MARK = 512, 32
LETTERS = 64
#: Letters that scores are read off from at most: beyond it a text is as sure as it gets.
SURE = 48


def _codes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for i in range(26):
        t[97 + i] = t[65 + i] = 1 + i
    t[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)
    return t


CODES = _codes()


def letters(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes under LETTERS of all texts, with each run of other ASCII as one 0, and where each text's begin."""
    c = CODES[b]
    if not len(c):
        return c, off
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[off[off < len(b)]] = True
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    return c[keep], before[off]


def automaton(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The edges (state, letter, next state) of the suffix automaton, and its number of states. State 0 is the root."""
    size = 2 * len(code) + 2
    blank = array("i", [-1]) * LETTERS
    nxt, states = blank[:], 1
    link, length, last = array("i", [-1]) * size, array("i", [0]) * size, 0
    for c in code.tolist():
        cur, states = states, states + 1
        nxt.extend(blank)
        length[cur], p = length[last] + 1, last
        while p >= 0 and nxt[p * LETTERS + c] < 0:
            nxt[p * LETTERS + c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p * LETTERS + c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin, states = states, states + 1
                nxt.extend(nxt[q * LETTERS : (q + 1) * LETTERS])
                length[twin], link[twin] = length[p] + 1, link[q]
                while p >= 0 and nxt[p * LETTERS + c] == q:
                    nxt[p * LETTERS + c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    every = np.frombuffer(nxt, np.int32)
    at = np.flatnonzero(every >= 0)
    return at // LETTERS, at % LETTERS, every[at].astype(np.int64), states


def pack(rows: np.ndarray, code: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges in one array, rows over each other where they leave room: where each state's row begins, no two at one place,
    and at begin + letter the row's place (high half) and the next state's. Rows of many edges are placed first, at random, by a fixed seed."""
    size = 2 * len(rows) + n + LETTERS
    rng = np.random.default_rng(1)
    owner, taken, place = np.full(size + LETTERS, -1, np.int64), np.zeros(size, bool), np.full(n, -1, np.int64)
    degree = np.bincount(rows, minlength=n)
    cut = np.searchsorted(rows, np.arange(n + 1))
    for low in (16, 8, 4, 2, 1, 0):
        left = np.flatnonzero((degree >= low) & (place < 0))
        while len(left):
            at = rng.integers(0, size, len(left))
            d = degree[left]
            edge = np.arange(d.sum()) + np.repeat(cut[left] - np.cumsum(d) + d, d)
            who = np.repeat(np.arange(len(left)), d)
            slot = at[who] + code[edge]
            ok = ~taken[at]
            ok[np.setdiff1d(np.arange(len(left)), np.unique(at, return_index=True)[1])] = False
            ok[who[owner[slot] >= 0]] = False
            ok[who[np.setdiff1d(np.arange(len(slot)), np.unique(slot, return_index=True)[1])]] = False
            place[left[ok]] = at[ok]
            taken[at[ok]] = True
            owner[slot[ok[who]]] = at[who[ok[who]]]
            left = left[~ok]
    table = np.full(size + LETTERS, -1, np.int64)
    table[place[rows] + code] = (place[rows] << 32) | place[to]
    return place, table


class Parser:
    """The automata of all languages in one table."""

    @classmethod
    def of(cls, model: str) -> Parser:
        kept, key = models("langid"), hashlib.sha256(model.encode()).hexdigest()
        if key not in kept:
            kept.clear()
            kept[key] = cls(json.loads(model))
        return kept[key]

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        tables, roots, bits, fresh, base = [], [], [], [], 0
        for lang in self.langs:
            joined = np.frombuffer("\n".join(texts[lang]).encode(), np.uint8)
            code, _ = letters(joined, np.array([0, len(joined)]))
            rows, c, to, n = automaton(code)
            inner = rows > 0  # the root's edges are in `fresh`: a letter from the root begins a phrase, as one that no edge takes does
            place, table = pack(rows[inner], c[inner], to[inner], n)
            tables.append(np.where(table >= 0, table + (base << 32) + base, -1))
            first = np.full(LETTERS, place[0])  # a letter that the language doesn't have is a phrase by itself
            first[c[rows == 0]] = place[to[rows == 0]]
            fresh.append(first + base)
            roots.append(place[0] + base)
            bits.append(np.log2(max(len(code), 2)))
            base += len(table)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.roots, self.bits = np.array(roots, np.int64), np.array(bits)
        self.fresh = np.stack(fresh) if fresh else np.zeros((0, LETTERS), np.int64)

    def _parse(self, grid: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Move the states (languages x stretches) along the stretches (columns of grid, the longest first); how many phrases began."""
        begun = np.zeros(state.shape, np.int32)
        wide = np.searchsorted(-size, -np.arange(len(grid)), "left")
        for row, w in zip(grid, wide.tolist(), strict=True):
            if not w:
                break
            c, s = row[:w].astype(np.int64), state[:, :w]
            v = self.table.take(s + c)
            lang, at = np.nonzero((v >> 32) != s)
            v &= 0xFFFFFFFF
            v[lang, at] = self.fresh[lang, c[at]]
            begun[lang, at] += 1
            state[:, :w] = v
        return begun

    def phrases(self, code: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of phrases of each text by each language."""
        n = np.diff(off)
        parts = -(-n // STEPS)
        total, k = int(parts.sum()), len(self.langs)
        owner = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(STEPS, n[owner] - nth * STEPS)
        grid = np.zeros((STEPS, total), np.uint8)
        grid[np.arange(len(code)) - np.repeat(off[owner] + nth * STEPS, size), np.repeat(np.arange(total), size)] = code
        start = np.repeat(self.roots[:, None], total, 1)
        # For each MARK letters the state after them and the phrases that began in them: a parse that comes to the state of the one before goes on like it.
        marks, begun = np.full((STEPS // MARK, k, total), -1, np.int64), np.zeros((STEPS // MARK, k, total), np.int32)
        todo, later = np.arange(total), np.flatnonzero(nth > 0)
        while len(todo):
            at = todo[np.argsort(-size[todo], kind="stable")]
            state = start[:, at]
            for m in range(STEPS // MARK):
                begun[m][:, at] = self._parse(grid[m * MARK : (m + 1) * MARK, at], size[at] - m * MARK, state)
                new = (state != marks[m][:, at]).any(0)
                marks[m][:, at] = state
                at, state = at[new], state[:, new]
                if not len(at):
                    break
            todo = later[(start[:, later] != marks[-1][:, later - 1]).any(0)]
            start[:, todo] = marks[-1][:, todo - 1]
        begun = begun.sum(0)
        out = np.zeros((len(n), k))
        for j in range(k):
            out[:, j] = np.bincount(owner, begun[j], len(n))
        return out

    def predict(self, part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its share of the evidence; ties go to the first in order."""
        code, off = letters(*raw(column(part)))
        if not self.langs:
            return ["und"] * part.num_rows, np.zeros(part.num_rows)
        n = np.maximum(np.diff(off), 1)[:, None]
        cost = self.phrases(code, off) * self.bits / n
        best = cost.argmin(1)
        p = np.exp2(-(cost - cost.min(1, keepdims=True)) * np.minimum(n, SURE))
        return [self.langs[i] for i in best], 1 / p.sum(1)


def learn(docs: DataFrame, rows: int = 40) -> str:
    """The labelled text to parse against, as JSON: lang -> texts.

    A bounded sample: of the labelled rows (non-null text with a letter, lang and doc_id, crc32(doc_id) mod 4 other than 2),
    the `rows` of each language that come first by a hash of doc_id, of any length, with their whole texts. Ties go by doc_id and text. Only
    (lang, hash) are ranked, within each task first. Without labelled rows there is no language.
    """
    ok = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2))
    ok = ok.filter(F.col("text").rlike("\\p{L}")).select("doc_id", "lang", "text", F.xxhash64("doc_id", F.lit("langid")).alias("h"))
    first = ok.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= rows)
    texts: dict[str, list[str]] = {}
    for row in first.select("lang", "text", "r").orderBy("lang", "r").toLocalIterator():
        texts.setdefault(row["lang"], []).append(row["text"])
    return json.dumps(texts, ensure_ascii=False)


def identify(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score (0 to 1) of every whole text of docs; neither lang, source nor doc_id is read for it.

    A null text, or one without a letter, is `und` with score 0; so is all if nothing was learned. Repeated
    rows stay, each with its own prediction; an empty table gives an empty result. Ties of languages go to the first by name.
    keep: the columns to carry along, doc_id by default; those of a name of this result's own (lang_pred, score) are refused.
    """
    keep = keep or ["doc_id"]
    if {"lang_pred", "score", "_has_letter"} & set(keep):
        raise ValueError("lang_pred, score and _has_letter are names of the result's own")
    types = dict(docs.dtypes)

    def run(part: pa.RecordBatch) -> dict:
        lang, score = Parser.of(model).predict(part)
        has = part.column(part.schema.get_field_index("_has_letter")).to_pylist()
        out = {c: part.column(part.schema.get_field_index(c)) for c in keep}
        return out | {"lang_pred": [x if h else "und" for x, h in zip(lang, has, strict=True)], "score": np.where(has, score, 0.0)}

    src = docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("_has_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double"
    return map_texts(src, src.columns, run, schema, 2 << 20, "langid")
