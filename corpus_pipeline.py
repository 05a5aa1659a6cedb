"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Toxic and poor documents go, one document of each
group of near copies stays, passages that repeat are cut out of the texts, and
what is left is packed into sequences. Empty tables give no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import neardup, packing, quality, substrings, toxicity
from tideline.llm.common import durable, table

TOXIC_FROM = 0.5
GOOD_FROM = 0.5
NEAR = neardup.Rule(words=5, percent=80)
#: Words of a passage that may not occur twice.
PASSAGE_WORDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_FROM. Null and empty texts score the intercept
    and stay as a rule; very long texts are scored whole; repeated rows stay or go
    together; further columns are carried along, one called score too."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC_FROM).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score GOOD_FROM or more. Null and empty texts count as one empty
    line; very long texts are scored whole; repeated rows stay or go together."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model).filter(F.col("score") >= GOOD_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id. Documents
    without words or with a null id stay; rows that share an id stay or go together."""
    return neardup.deduplicate(docs, NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE_WORDS words that occur twice anywhere;
    a text that loses nothing stays as it is, n_chars follows the text, and null
    texts stay null. Repeated rows lose all passages that are long enough."""
    return substrings.remove_repeats(docs, PASSAGE_WORDS, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document's ids, placed in a sequence. Null and empty texts
    give one piece with the end id; very long ones fill several sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]
#: Fitted classifiers and tokenizers have no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
