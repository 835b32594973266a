"""The thin queries of the thirteen operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from lodestar.llm import bpe, codes, counts, forest, langid, line_dedup, mix, paragraphs, quality, search, simhash, tokens, toxicity


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_paragraph_sketches(spark, sf_dir):
    return paragraphs.op1(_docs(spark, sf_dir))


def op2_token_orc(spark, sf_dir):
    return tokens.op2(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.op3(_docs(spark, sf_dir))


def op4_nearest_neighbours(spark, sf_dir):
    return forest.op4(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_token_counts(spark, sf_dir):
    return counts.op5(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language_id(spark, sf_dir):
    return langid.op6(_docs(spark, sf_dir))


def op7_mix_sources(spark, sf_dir):
    return mix.op7(_docs(spark, sf_dir))


def op8_toxicity(spark, sf_dir):
    return toxicity.op8(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_bpe_round_trip(spark, sf_dir):
    return bpe.op9(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.op10(_docs(spark, sf_dir))


def op11_quality(spark, sf_dir):
    return quality.op11(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_ranked_search(spark, sf_dir):
    return search.op12(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_codes(spark, sf_dir):
    return codes.op13(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_paragraph_sketches, op2_token_orc, op3_simhash_near_dedup, op4_nearest_neighbours, op5_token_counts, op6_language_id, op7_mix_sources, op8_toxicity, op9_bpe_round_trip, op10_line_dedup, op11_quality, op12_ranked_search, op13_vector_codes)}
