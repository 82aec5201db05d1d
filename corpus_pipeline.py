"""The corpus pipeline: filter, deduplicate, decontaminate and pack ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that the caller writes as Parquet and reads again as the next stage's
docs.  All stages but the last return the columns of ``documents``.

Defined cases, in every stage: a null text stays null, and null, empty and wordless
texts are kept; repeated rows are copies of each other, of which near_dedup keeps one;
without labels no document is toxic, without a benchmark none is contaminated; an
empty table stays empty; columns that bear names an operator uses itself pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, op1_suffix_dedup, op2_decontaminate, op5_minhash, op6_toxicity, op10_pack

def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    return op6_toxicity.drop_toxic(docs, op6_toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return op5_minhash.near_dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; n_chars follows the text."""
    out = op1_suffix_dedup.dedup_documents(docs, words=op1_suffix_dedup.PASSAGE)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return op2_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return op10_pack.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No SQL form: scores, components, substrings and tokens are all beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage kept is stored before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
