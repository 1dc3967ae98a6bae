"""The corpus pipeline: five stages over ``documents``, each one of the operators.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each
result and hands the reread table to the next. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from plumbline.llm.byte_bpe import byte_bpe_roundtrip
from plumbline.llm.decontamination import find_leaks
from plumbline.llm.quality_mil import fit_quality, keep_quality
from plumbline.llm.scratch import free_name, written
from plumbline.llm.secret_scan import redact_secrets
from plumbline.llm.simhash import simhash_groups, with_fingerprint

#: Neither the scores of a trained model nor fingerprints, masks and token ids can be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier accepts; the labels are of this table's own documents.

    A null text is scored as an empty one; repeated rows fare alike; without
    labels of both classes all rows score the same; an empty table stays empty.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document of smallest id, once; rows without id cannot be named by a group and stay."""
    groups = simhash_groups(docs)
    first, print_, turn = free_name(docs, "_first"), free_name(docs, "_print"), free_name(docs, "_turn")
    names = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("root", F.col("doc_id").alias(first)).agg(F.min("fp").alias(print_ + "_"))
    same = (F.col("doc_id") == F.col(first)) & (F.col(print_) == F.col(print_ + "_"))
    kept = with_fingerprint(docs, print_).join(names.hint("merge"), same, "left_semi")  # one plan at every size
    order = W.partitionBy("doc_id", print_).orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    kept = kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn, print_)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold an item of the benchmark.

    A row is named by a digest of its id and text: rows that share an id are judged
    one by one, rows without id like all others. Rows without text stay; an empty
    table gives an empty one, and an empty benchmark drops nothing.
    """
    row, leak = free_name(docs, "_row"), free_name(docs, "_leak")
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    leaks = find_leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select(F.col("doc_id").alias(leak)).distinct()
    return named.join(leaks.hint("merge"), F.col(row) == F.col(leak), "left_anti").drop(row)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts and counts their characters anew; all rows stay, null and empty texts as they are."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of what is left, as digests; a null text has no tokens, a repeated row gives a repeated result."""
    return byte_bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
    ("secret scans", secrets), ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
