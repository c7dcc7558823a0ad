"""A corpus pipeline over `documents`: each stage reads what the one before kept.

Toxic documents go, of each group of near-duplicates one stays, personal data is replaced, sources are
mixed, and what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swaralens.llm import mixing, pieces, pii, simhash, similar, toxicity
from swaralens.llm.common import drop_table, materialize, table
from swaralens.llm.queries import tokenizer_path

#: Times a small source may be repeated to come closer to the large ones. Every document stays.
MAX_REPEATS = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, judge=similar.near_duplicates)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, max_repeats=MAX_REPEATS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.piece_codes(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read back, and
    the one before it goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
