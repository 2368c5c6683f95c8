"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from homerange.llm import (
    conversation_repair,
    embedding_dedup,
    html_text,
    language_id,
    packing,
    prefix_trie,
    quality_rules,
    sentence_pieces,
    simhash,
    subword_quality,
    suffix_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": language_id.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_packing": packing.query,
        "op4_simhash": simhash.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_toxicity": toxicity.query,
        "op7_quality_rules": quality_rules.query,
        "op8_sentence_pieces": sentence_pieces.query,
        "op9_html_text": html_text.query,
        "op10_token_counts": token_counts.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_subword_quality": subword_quality.query,
        "op13_prefix_trie": prefix_trie.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op11_conversation_repair": conversation_repair.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
