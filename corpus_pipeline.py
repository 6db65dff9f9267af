"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all the rows its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import bpe, ngram_join, packing, quality, toxicity
from claimlens.llm.common import free_name, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows stay or go together; an empty table stays empty.

    The columns are those of docs: what the rules add doesn't stay, and a column of docs of such a name keeps its own values.
    """
    return quality.kept_only(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled documents of this stage's input, doesn't predict as toxic.

    Null and empty texts get the network's prior and so stay; repeated rows stay or go together; an empty table stays empty.
    """
    net = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    marked = toxicity.with_toxicity(docs.select(F.struct("*").alias("row"), "text"), net)
    return marked.where("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest doc_id; a repeated row stays once.

    Rows without a doc_id stand behind those with one; rows of one doc_id with different texts are told apart, and of those in
    one class the one with the smallest hash of the row stays, so that reruns agree. Rows whose texts have no words are classes
    of their own and stay. An empty table stays empty.
    """
    row = free_name(docs.columns, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-duplicate-rows")
    classes = ngram_join.similar_texts(rows.select(F.col(row).alias("doc_id"), "text"))
    ranked = rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(row).alias("row")).alias("rank"))
    firsts = classes.select(F.col("doc_id").alias(row), "class_id").join(ranked, row).groupBy("class_id").agg(F.min("rank").alias("rank"))
    return rows.join(firsts.select(F.col("rank.row").alias(row)), row, "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document, or of each piece of a long one, by its tokens of a byte-level BPE.

    Null and empty texts are pieces of 0 tokens; repeated rows are documents of their own, which conflict as copies; null sources conflict
    with nothing; an empty table gives no rows. Only doc_id, source, lang and text are read, so that other columns may have any name.
    """
    counted = bpe.with_bpe(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.packed(counted.withColumn("cluster", F.col("decoded_sha256")).drop("text"), keep=("source", "lang"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Suffix arrays, a trained network and greedy packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
