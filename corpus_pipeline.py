"""A corpus pipeline: language, near-duplicates, repeated passages, source weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of `documents`, whatever other columns docs has, of any name. An empty table
gives an empty result in every stage; each stage judges whole texts, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, langid, mixing, neardup, substring
from ravelin.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), and those that no language explains better than all others
    together, go. Null ids stay; repeated rows stay or go together."""
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs), COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies stays. Repeated rows of an id count once, each of its texts is judged by
    itself; rows without doc_id stay, and documents without words are copies of none."""
    return neardup.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; so does a document of which nothing is left. Others keep their
    text as it is, null and empty ones as well. A null doc_id counts as the largest; rows of equal doc_id take nothing from each other."""
    cut = substring.dedup(docs.select(*COLUMNS), texts=True, keep=COLUMNS)
    changed = F.col("n_removed") > 0
    cut = cut.filter(~changed | (F.col("n_removed") < F.col("n_words")))
    return cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, evenly over domains, languages and sources as far as they reach, in one epoch. Each row is drawn
    by itself, whatever its doc_id: null and repeated ids as well. Texts without words are never drawn; ties of the seeded order go by doc_id, tokens and row."""
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")  # the numbers stay what they are
    drawn = mixing.mix(rows, fraction=0.9, epochs=1, seed=7, key="_row").filter("copies > 0").select("_row")
    return rows.join(drawn, "_row", "left_semi").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of what they decode to. A row for each row; a null text is an empty one."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_weights),
    ("byte-level BPE", tokens),
]

#: SQL can express neither language identification nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
