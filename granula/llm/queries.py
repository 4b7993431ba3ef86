"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from granula.llm import license_scan, line_dedup, mixing, sharding
from granula.llm.chat_format import op9_hmm_transcripts
from granula.llm.common import table
from granula.llm.decontamination import op3_window_simhash_decontamination
from granula.llm.fingerprints import op5_one_permutation_minhash
from granula.llm.quality import op6_attention_quality
from granula.llm.simhash_dedup import op10_simhash_pigeonring
from granula.llm.toxicity import op7_compression_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_winnowing": lambda spark, d: line_dedup.op1_line_winnowing(table(spark, d, "documents")),
        "op2_license_set_join": lambda spark, d: license_scan.op2_license_set_join(table(spark, d, "documents")),
        "op3_window_simhash_decontamination": lambda spark, d: op3_window_simhash_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op4_splitting_tree_mix": lambda spark, d: mixing.op4_splitting_tree_mix(table(spark, d, "documents")),
        "op5_one_permutation_minhash": lambda spark, d: op5_one_permutation_minhash(table(spark, d, "documents")),
        "op6_attention_quality": lambda spark, d: op6_attention_quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op7_compression_toxicity": lambda spark, d: op7_compression_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_hash_tree_sharding": lambda spark, d: sharding.op8_hash_tree_sharding(table(spark, d, "documents")),
        "op9_hmm_transcripts": lambda spark, d: op9_hmm_transcripts(table(spark, d, "conversations")),
        "op10_simhash_pigeonring": lambda spark, d: op10_simhash_pigeonring(table(spark, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_winnowing": line_dedup.oracle_sql(),
        "op2_license_set_join": license_scan.oracle_sql(),
        "op4_splitting_tree_mix": mixing.oracle_sql(),
        "op8_hash_tree_sharding": sharding.oracle_sql(),
    }
