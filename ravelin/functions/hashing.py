"""Hashes: FNV-1a in two 32-bit halves, graph levels, keyed digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes, as the BIGINT of the same bits. Halves keep every product below 2**63 (ANSI mode)."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(3421674724).alias("hi"), F.lit(2216829733).alias("lo"))

    def step(s: Column, i: Column) -> Column:
        b = F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        x = s["lo"].bitwiseXOR(b)
        p = x * 435
        hi = (s["hi"] * 435 + F.shiftright(p, 32) + F.shiftleft(x, 8)).bitwiseAND(0xFFFFFFFF)
        return F.struct(hi.alias("hi"), p.bitwiseAND(0xFFFFFFFF).alias("lo"))

    return F.aggregate(at, start, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def level(item_id: Column, most: int = 16) -> Column:
    """The graph level of an id: how often 4 divides its hash, at most `most`."""
    b = F.bin(fnv1a(item_id))
    zeros = F.length(b) - F.length(F.rtrim(F.translate(b, "0", " ")))
    return F.least(F.lit(most), F.floor(zeros / 2).cast("int"))


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 as lower-case hexadecimal."""
    k = key.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in k), bytes(x ^ 0x5C for x in k)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))), 256)
