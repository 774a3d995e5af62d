"""Fielded BM25 over collections; every statistic is a collection's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.sources.shared import fresh_folder

K1, B, TITLE, BODY = 1.2, 0.75, 2.5, 1.0
#: Distinct query terms that are looked for in each document's own row; more are joined with its postings.
MOST = 64


def analyzed(docs: DataFrame, nfkc: bool = False) -> DataFrame:
    """(collection_id, doc_id, title_tokens, body_tokens)."""
    return docs.select("collection_id", "doc_id", tokens(F.col("title"), nfkc).alias("title_tokens"), tokens(F.col("body"), nfkc).alias("body_tokens"))


def lengths(words: DataFrame) -> DataFrame:
    return words.select("collection_id", "doc_id", F.size("title_tokens").cast("long").alias("len_title"), F.size("body_tokens").cast("long").alias("len_body"))


def stats(words: DataFrame) -> DataFrame:
    """(collection_id, n, avg_title, avg_body) over all documents, empty ones as well."""
    return lengths(words).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len_title").alias("avg_title"), F.avg("len_body").alias("avg_body"))


def postings(words: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(collection_id, doc_id, term, tf_title, tf_body), of the given terms only if there are any.

    Tokens meet the terms before anything is shuffled, and counts are made in each task first.
    """
    # Titles and bodies are exploded in one pass; the field is known by the position.
    both = words.select("collection_id", "doc_id", F.size("title_tokens").alias("cut"), F.posexplode(F.concat("title_tokens", "body_tokens")).alias("pos", "term"))
    if terms is not None:
        both = both.join(terms.select("term").distinct(), "term", "left_semi")
    title = F.col("pos") < F.col("cut")
    return both.groupBy("collection_id", "doc_id", "term").agg(F.sum(title.cast("long")).alias("tf_title"), F.sum((~title).cast("long")).alias("tf_body"))


def query_terms(queries: DataFrame, nfkc: bool = False) -> DataFrame:
    """(query_id, term, n_terms): the distinct terms of each query."""
    t = F.array_distinct(tokens(F.col("text"), nfkc))
    return queries.select("query_id", F.size(t).alias("n_terms"), F.explode(t).alias("term"))


def saturated(tf: Column, length: Column, average: Column) -> Column:
    """The normalised term frequency: 0 without the term, an average of 0 as 1."""
    avg = F.when(average == 0, F.lit(1.0)).otherwise(average)
    return F.when(tf == 0, F.lit(0.0)).otherwise(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg)))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _slim(words: DataFrame, named: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings with lengths, and stats(). Texts are tokenised once: a row a document, with its lengths and its tokens of a few named
    terms, goes to the shared folder, from where both are counted. A document's postings come from its own row, without a shuffle."""
    wanted = F.array(*map(F.lit, named)) if named else F.array().cast("array<string>")
    own = lambda c: F.filter(c, lambda t: F.array_contains(wanted, t))
    slim = words.select("collection_id", "doc_id", F.size("title_tokens").cast("long").alias("len_title"), F.size("body_tokens").cast("long").alias("len_body"), own("title_tokens").alias("t"), own("body_tokens").alias("b"))
    path = fresh_folder(words.sparkSession, "tokens")
    slim.write.parquet(path)
    slim = words.sparkSession.read.schema(slim.schema).parquet(path)
    size = slim.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len_title").alias("avg_title"), F.avg("len_body").alias("avg_body"))
    n = lambda c: F.size(F.filter(c, lambda t: t == F.col("term"))).cast("long")
    post = slim.select("*", F.explode(F.array_union("t", "b")).alias("term")).select("collection_id", "doc_id", "len_title", "len_body", "term", n("t").alias("tf_title"), n("b").alias("tf_body"))
    return post, size


def search(docs: DataFrame, queries: DataFrame, mode: str = "any", limit: int = 0, nfkc: bool = False) -> DataFrame:
    """(query_id, collection_id, doc_id, score, rank) for all queries at once.

    mode: any or all of a query's distinct terms, in either field. limit 0: all. Equal scores rank by doc_id;
    scores are compared to nine digits, so that the order of a sum decides nothing.
    """
    if mode not in ("any", "all") or limit < 0:
        raise ValueError("mode is any or all, and limit is not negative")
    words = analyzed(docs.filter(F.trim("doc_id") != ""), nfkc)
    terms = query_terms(queries, nfkc)
    named = [r["term"] for r in terms.select("term").distinct().limit(MOST + 1).collect()]
    if len(named) <= MOST:
        post, size = _slim(words, named)
    else:
        post, size = postings(words, terms).join(lengths(words), ["collection_id", "doc_id"]), stats(words)
    df = post.groupBy("collection_id", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = post.join(df, ["collection_id", "term"]).join(size, "collection_id")
    weight = idf(F.col("n"), F.col("df")) * (TITLE * saturated(F.col("tf_title"), F.col("len_title"), F.col("avg_title")) + BODY * saturated(F.col("tf_body"), F.col("len_body"), F.col("avg_body")))
    hits = scored.select("collection_id", "doc_id", "term", weight.alias("w")).join(terms, "term").groupBy("query_id", "collection_id", "doc_id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("found"), F.first("n_terms").alias("n_terms"))
    if mode == "all":
        hits = hits.filter(F.col("found") == F.col("n_terms"))
    return ranked(hits.select("query_id", "collection_id", "doc_id", "score"), ["query_id", "collection_id"], limit)


def ranked(hits: DataFrame, by: list[str], limit: int = 0, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """hits with rank, by score to nine digits; the window's limit reaches below the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), *ties)
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= limit) if limit else out
