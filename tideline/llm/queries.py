"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat, fingerprints, graphsearch, neardup, packing, pieces, quality, substrings, toxicity, urltree
from tideline.llm.common import table
from tideline.llm.sampling import remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphsearch.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(chat.ADDED, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.union(added)))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), neardup.Rule(words=4, percent=80))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' bands joined and verified: links that join all documents whose
    bands meet and whose Jaccard index is 0.8 or more."""
    return fingerprints.near_pairs(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality.score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_neighbours": op2_neighbours,
        "op3_urls": op3_urls,
        "op4_packing": op4_packing,
        "op5_chat": op5_chat,
        "op6_neardup": op6_neardup,
        "op7_fingerprints": op7_fingerprints,
        "fingerprint_pairs": fingerprint_pairs,
        "op8_substrings": op8_substrings,
        "op9_quality": op9_quality,
        "op10_pieces": op10_pieces,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_urls": urltree.judge_sql(),
        "op5_chat": chat.digests_sql(),
        "op6_neardup": neardup.cluster_sql(neardup.Rule(words=4, percent=80)),
        "op8_substrings": substrings.removal_sql(),
    }
