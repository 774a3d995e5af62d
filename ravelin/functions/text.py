"""Text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold(text: Column, nfkc: bool = False) -> Column:
    """Lower case character by character: no final sigma, and dotted I as i. nfkc: compatibility forms are composed
    first, in Python for texts beyond ASCII; without it the plan stays in the JVM."""
    if nfkc:
        text = F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text)
    return F.lower(F.translate(text, "Σİ", "σi"))


def tokens(text: Column, nfkc: bool = False) -> Column:
    """The index's words: runs of letters, numbers and marks."""
    return F.filter(F.split(fold(text, nfkc), "[^\\p{L}\\p{N}\\p{M}]+"), lambda x: x != "")


def embed_tokens(text: Column) -> Column:
    """The embedder's words: marks part them, and there is no normalisation."""
    return F.filter(F.split(fold(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def trigrams(word: Column) -> Column:
    """The three-letter runs of ^word$."""
    w = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))


def snippet(content: Column, most: int = 180) -> Column:
    """White space collapsed; what is longer than `most` is cut, trimmed and marked."""
    flat = F.trim(F.regexp_replace(content, "(?U)\\s+", " "))
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def clean_list(values: Column, ordered: bool = False) -> Column:
    """Trimmed, without empty ones and repeats; sorted if asked."""
    out = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
    return F.sort_array(out) if ordered else out  # no nulls are left


def query_features(q: Column) -> dict[str, Column]:
    """What the planner looks at in a query text."""
    t = F.trim(q)
    n = F.when(t == "", 0).otherwise(F.size(F.split(t, "\\s+")))
    natural = (n >= 6) | t.endswith("?") | F.lower(t).rlike("^(how|why|what|which) ")
    return {
        "tokens": n,
        "runes": F.char_length(t),
        "quoted": t.rlike('^[^"]*("\\s*"[^"]*)*"[^"]*[^"\\s][^"]*"'),
        "id_like": (n == 1) & (F.octet_length(t) >= 4) & t.rlike("[-_:/]") & t.rlike("\\p{Nd}"),
        "natural": natural,
    }
