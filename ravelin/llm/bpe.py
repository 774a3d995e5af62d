"""Byte-level BPE: encoding by recursive DuckDB queries, decoding by ordered aggregation.

Each task holds an in-memory DuckDB. Texts are cut into pieces as the pattern of the rank
file says; the distinct pieces of a block go to DuckDB as rows (piece, position, token), and
a recursive query contracts the leftmost pair of least rank of each piece until no pair of
the piece is in the merge table. Ids of pieces met before come from a bounded memo of the worker, by the
pieces' bytes, which changes no result. Decoding takes the id sequence of each document: its tokens, as rows
(document, position, id), meet the vocabulary, and their bytes are aggregated in order.

Long pieces are first cut where no token of the vocabulary has those two bytes side by side, as no token can
span such a place. What is still longer than LONG bytes takes the same contraction by a query whose steps
contract every occurrence of the least pair at once, from the left, where that gives what one by one would: no token
that has the new one for a half ranks below it. One pair a step would take steps in proportion to the
piece, over all its rows.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import map_texts, models
from ravelin.llm.text import blocks, column, prefix_sums, raw, span_hashes

LONG = 128
MEMO = 300_000
AT_ONCE = 20_000

#: The pattern that piece_starts() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ENCODE = """
with recursive s(i, w, p, t) as (
  select 0, w, p, t from pieces
  union all
  select c.i + 1, c.w, c.p - (c.p > b.q)::int, case when c.p = b.q then b.m else c.t end
  from s c join (
    select w, (min(c) >> 32)::int as m, (min(c) & 4294967295)::bigint as q
    from (select a.w, (g.m::bigint << 32) | a.p as c
          from s a join s n on n.w = a.w and n.p = a.p + 1 join merges g on g.l = a.t and g.r = n.t)
    group by w) b on c.w = b.w
  where c.p <> b.q + 1)
select s.w, s.p, s.t from s join (select w, max(i) as z from s group by w) e on e.w = s.w and e.z = s.i order by s.w, s.p
"""
#: Keyed rows: a step replaces those it changes, so that memory is a piece's, not a piece's for each step. -1: gone into its left neighbour.
ENCODE_LONG = """
with recursive s(w, p, t) using key (w, p) as (
  select w, p, t from pieces
  union all
  select w, p, case when gone then -1 when hit then m else t end
  from (
    select *, coalesce(lag(hit) over (partition by w order by p), false) as gone
    from (
      select *, best and case when alone then row_number() over (partition by w, isle order by p) % 2 = 1 else p = min(case when best then p end) over (partition by w) end as hit
      from (
        select *, case when best then row_number() over (partition by w order by p) - row_number() over (partition by w, best order by p) else -1 end as isle
        from (
          select a.*, g.m, g.alone, min(g.m) over (partition by a.w) as least, coalesce(g.m = least, false) as best
          from (select *, lead(t) over (partition by w order by p) as u from s where t >= 0) a left join merges g on g.l = a.t and g.r = a.u)
        where least is not null))))
select w, p, t from s where t >= 0 order by w, p
"""
#: Whether no merge that takes the token m for a half gives a token of smaller rank than m.
ALONE = """
create or replace temp table merges as
with next as (select x, min(m) as least from (select l as x, m from given union all select r, m from given) group by x)
select l, r, m, (least is null or least > m) as alone from given left join next on next.x = m
"""
DECODE = "select x.d as d, string_agg(v.h, '' order by x.p) as h from x join vocab v on v.id = x.t group by x.d order by x.d"


class Bpe:
    """A rank file's merges in DuckDB, and the memo of pieces."""

    @classmethod
    def of(cls, path: str) -> Bpe:
        kept = models("bpe")
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(a, b, k) for tok, k in self.ranks.items() for i in range(1, len(tok)) if (a := self.ranks.get(tok[:i])) is not None and (b := self.ranks.get(tok[i:])) is not None]
        self.con = duckdb.connect()
        self.con.execute("set threads = 1; set memory_limit = '300MB'; set preserve_insertion_order = false")
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True)) if rows else (pa.array([], pa.int32()),) * 3
        self._load("given", pa.table({"l": l, "r": r, "m": m}))
        self.con.execute(ALONE)
        self._load("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "h": [k.hex() for k in self.ranks]}))
        self.joined = np.zeros((256, 256), bool)
        for tok in self.ranks:
            x = np.frombuffer(tok, np.uint8)
            self.joined[x[:-1], x[1:]] = True
        # A piece that is a token has that id, even where contraction ends in other tokens.
        every = list(self.ranks)
        got = self.encode(every)
        self.whole = {tok: self.ranks[tok].to_bytes(4, "little") for tok, ids in zip(every, got, strict=True) if ids != self.ranks[tok].to_bytes(4, "little")}
        self.memo: dict[bytes, bytes] = {}

    def _load(self, name: str, table: pa.Table) -> None:
        self.con.register("incoming", table)
        self.con.execute(f"create or replace temp table {name} as select * from incoming")
        self.con.unregister("incoming")

    def _contract(self, parts: list[bytes], query: str) -> list[bytes]:
        n = np.array([len(x) for x in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        w = np.repeat(np.arange(len(parts), dtype=np.int32), n)
        p = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        self._load("pieces", pa.table({"w": w, "p": p, "t": self.bytes[flat]}))
        got = self.con.execute(query).fetchnumpy()
        data, at = got["t"].astype("<u4").tobytes(), (np.searchsorted(got["w"], np.arange(len(parts) + 1)) * 4).tolist()
        return [data[x:y] for x, y in zip(at, at[1:], strict=False)]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 4 bytes each) of each piece."""
        parts, owner = [], []
        for k, x in enumerate(pieces):
            cut = [x]
            if len(x) > LONG:
                b = np.frombuffer(x, np.uint8)
                at = [0, *(np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist(), len(x)]
                cut = [x[i:j] for i, j in zip(at, at[1:], strict=False)]
            parts += cut
            owner += [k] * len(cut)
        ids: list[bytes] = [b""] * len(parts)
        short = [i for i, x in enumerate(parts) if len(x) <= LONG]
        for a in range(0, len(short), AT_ONCE):
            some = short[a : a + AT_ONCE]
            for i, got in zip(some, self._contract([parts[i] for i in some], ENCODE), strict=True):
                ids[i] = got
        for i, x in enumerate(parts):
            if len(x) > LONG:
                ids[i] = self._contract([x], ENCODE_LONG)[0]
        if len(parts) == len(pieces):
            return ids
        out: list[list[bytes]] = [[] for _ in pieces]
        for k, x in zip(owner, ids, strict=True):
            out[k].append(x)
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence ids[cut[i]:cut[i + 1]]."""
        k = len(cut) - 1
        self._load("x", pa.table({"d": np.repeat(np.arange(k, dtype=np.int32), np.diff(cut)), "p": np.arange(len(ids), dtype=np.int64), "t": ids.astype(np.int32)}))
        got = self.con.execute(DECODE).fetchnumpy()
        out = [b""] * k
        for d, h in zip(got["d"].tolist(), got["h"].tolist(), strict=True):
            out[d] = bytes.fromhex(h)
        return out

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of distinct pieces, from the memo where it has them."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        known, new = self.memo, [x for x in pieces if x not in self.memo]
        for x, got in zip(new, self.encode(new), strict=True):
            known[x] = self.whole.get(x, got)
        return [known[x] for x in pieces]


_CLASS: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """0: other, 1: letter, 2: number, 3: white space, for each code point."""
    if "t" not in _CLASS:
        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for k, pat in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
            t[[ord(c) for c in regex.findall(pat, every)]] = k
        _CLASS["t"] = t
    return _CLASS["t"]


def piece_starts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the matches of the byte-level pattern begin (contractions; runs of
    letters, of numbers or of others, each with one space before it; white space)."""
    if b.max() < 128:
        cp, lead = b, np.arange(len(b))
    else:
        cp, lead = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.flatnonzero((b & 0xC0) != 0x80)
    n = len(cp)
    c = _classes()[cp]
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(lead, off[:-1])] = True
    doc[n] = True
    start = doc[:n].copy()
    start[1:] |= c[1:] != c[:-1]
    space = c == 3
    # The last of a run of white space before something else joins it if it is a blank, else stands alone.
    last = space & ~doc[1:]
    last[:-1] &= c[1:] != 3
    last[-1] = False
    start |= last
    blank = np.flatnonzero(last & (cp == 32))
    start[blank + 1] = False
    # A contraction begins where a piece begins with an apostrophe and the letters follow in the same text.
    q = np.flatnonzero(start & (cp == 39))
    if len(q):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        end = np.concatenate([doc, np.ones(2, bool)])
        one, two = pad[q + 1], pad[q + 2]
        ok1 = ~end[q + 1]
        ok2 = ok1 & ~end[q + 2]
        n1 = ok1 & np.isin(one, [ord(x) for x in "stmd"])
        n2 = ok2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[q[n1] + 1] = start[q[n2] + 1] = False
        for at in (q[n1] + 2, q[n2] + 3):
            start[at[at < n]] = True
    return lead[start]


def distinct(data: bytes, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans data[s:e], and which of them each is. Hashes only find equal ones: their bytes are compared."""
    _, first, inv = np.unique(keys, return_index=True, return_inverse=True)
    b, n, same = np.frombuffer(data, np.uint8), e - s, first[inv]
    if (n == n[same]).all() and (b == b[np.arange(len(b)) + np.repeat(s[same] - s, n)]).all():  # spans are side by side
        return [data[x:y] for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)], inv
    seen: dict[bytes, int] = {}
    inv = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(s.tolist(), e.tolist(), strict=True)])
    return list(seen), inv


def encode_block(part: pa.RecordBatch, path: str) -> tuple[list[bytes], list[bytes]]:
    """The ids (little-endian, 4 bytes each) of each text, and the bytes that those ids decode to."""
    bpe = Bpe.of(path)
    keys, starts, ends, cut, data, at, n = [], [], [], [np.zeros(1, np.int64)], [], 0, 0
    for small in blocks(part, 128 << 10):  # what the processor's cache holds
        b, off = raw(column(small))
        if len(b):
            s = piece_starts(b, off)
            e = np.append(s[1:], len(b))
            keys.append(span_hashes(prefix_sums(b), s, e))
        else:
            s = e = np.zeros(0, np.int64)
        cut.append(np.searchsorted(s, off[1:]) + n)
        starts.append(s + at)
        ends.append(e + at)
        data.append(b.tobytes())
        at, n = at + len(b), n + len(s)
    if not n:
        return [b""] * part.num_rows, [b""] * part.num_rows
    cut = np.concatenate(cut)
    pieces, inv = distinct(b"".join(data), np.concatenate(starts), np.concatenate(ends), np.concatenate(keys))
    known = bpe.ids(pieces)
    size = np.array([len(x) for x in known], np.int64) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    begin, size = (np.cumsum(size) - size)[inv], size[inv]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    ids, ends = flat[np.arange(to[-1]) + np.repeat(begin - to[:-1], size)], to[cut]
    return [ids[x:y].tobytes() for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)], bpe.decode(ids, ends)


def tokenize(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of docs by the rank file at `path`, without special tokens.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (little-endian
    unsigned 32-bit integers). A null text counts as empty and has no tokens. Repeated rows, and rows without doc_id, stay;
    an empty table gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("pieces are cut by another pattern than that of the rank files")

    def run(part: pa.RecordBatch) -> dict:
        codes, text = encode_block(part, path)
        sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
        out = {"doc_id": part.column(0), "n_tokens": pa.array([len(x) // 4 for x in codes], pa.int64()), "ids_sha256": sha(codes), "decoded_sha256": sha(text)}
        return out | ({"ids": pa.array(codes, pa.binary())} if ids else {})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(src, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids, 2 << 20, "bpe")
