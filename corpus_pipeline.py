"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing sources, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; between stages the rows are
written as Parquet in the shared folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, line_dedup, mix, simhash, toxicity
from lodestar.llm.kept import small_batches
from lodestar.storage import new_path, remove, settle

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored toxic go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go from the texts; all documents stay."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the smallest doc_id stays: fingerprints of five-word shingles meet in the byte-position index, and what
    it links counts if the shingles are alike by 0.8; so do pairs of that likeness that lie farther apart than the index sees."""
    small_batches(spark)
    return simhash.one_of_each(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources' words come near their targets."""
    return mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, and the digest of what they decode to."""
    small_batches(spark)
    out = bpe.encode_decode(docs, VOCABULARY)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: SQL can express neither the learned first stage nor what depends on it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        docs = settle(stage(spark, docs, sf_dir), "stage", path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
