"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import audio, bpe, chunk_reuse, exact_substrings, language, lexical, minhash, mixing, phrases, rans, sharding, tiles, token_counts
from quarry.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.deduplicated(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op5_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digests(table(spark, sf_dir, "documents"))


def op6_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.linked(table(spark, sf_dir, "embeddings"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op11_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_mixing, op4_language, op5_rans, op6_tiles, op7_audio, op8_token_counts, op9_minhash, op10_sharding, op11_chunk_reuse, op12_lexical, op13_phrases)}

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": exact_substrings.sql(), "op3_mixing": mixing.sql(), "op6_tiles": tiles.sql(), "op9_minhash": minhash.sql(words=4, percent=80), "op12_lexical": lexical.sql(), "op13_phrases": phrases.sql()}
