"""The corpus pipeline: language ID, near-dedup, passage dedup, mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_substrings, language, minhash, mixing
from quarry.llm.common import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that are noise to a network of the labelled languages; labels null ones.

    Null and empty texts have no letters and go. Null or repeated doc_ids change nothing. Without
    labelled documents only texts without letters go. An empty table stays empty.
    """
    return language.spoken(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles link at 0.8 or more: the one of the least doc_id.

    Rows without a doc_id, and different rows of one, are documents of their own: copies among them
    go, different texts stay. Texts without words are linked with nothing. An empty table stays empty.
    """
    return minhash.representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every string of 100 bytes that starts earlier in the corpus too; n_chars counts anew.

    Rows without a doc_id, and different texts of one, are documents of their own. A null text stays
    null, a text of which nothing is left becomes empty. An empty table stays empty.
    """
    return exact_substrings.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents towards the target of their source; null sources are one source.

    Null and empty texts have size 0 and are taken like others. Rows that repeat doc_id and text
    share their draw. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text, a row for every row; a null text has no ids."""
    return bpe.encoded(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Trained and signature stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    What a stage wrote on its way is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
