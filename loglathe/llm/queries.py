"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglathe.llm import bpe, chat, collocations, jaccard, language, linededup, media, mixing, oracles, quality, substring, toxicity, whitening, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        media.op1_media_columns,
        substring.op2_substring_dedup,
        bpe.op3_bpe,
        quality.op4_quality_rules,
        jaccard.op5_ngram_jaccard_join,
        wordpiece.op6_token_counts,
        mixing.op7_mixing_sources,
        toxicity.op8_toxicity,
        language.op9_language_id,
        chat.op10_chat_formatting,
        whitening.op11_embedding_whitening,
        collocations.op12_phrase_collocations,
        linededup.op13_line_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": oracles.op4_sql(),
        "op7_mixing_sources": oracles.op7_sql(),
        "op10_chat_formatting": oracles.OP10_SQL,
        "op12_phrase_collocations": oracles.OP12_SQL,
        "op13_line_dedup": oracles.OP13_SQL,
    }
