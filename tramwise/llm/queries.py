"""The registered corpus queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramwise.llm import (
    alignment,
    decontaminate,
    language_id,
    lm_score,
    minhash,
    mixing,
    neighbours,
    quality,
    substrings,
    templates,
    token_counts,
    toxicity,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Near(words=4))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", "text"
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_substrings": op3_substrings,
        "op4_toxicity": op4_toxicity,
        "op5_minhash": op5_minhash,
        "op6_decontaminate": op6_decontaminate,
        "op7_token_counts": op7_token_counts,
        "op8_templates": op8_templates,
        "op9_neighbours": op9_neighbours,
        "op10_quality": op10_quality,
        "op11_lm_score": op11_lm_score,
        "op12_whitening": op12_whitening,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_templates": templates.ORACLE_SQL}
