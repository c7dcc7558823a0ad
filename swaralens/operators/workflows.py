"""Whole workflows from tables to reports, and single requests as tables of one kind of row.

Each is a composition of the operators beside it; nothing is collected on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.english import clean_pipeline, detect_english
from ..functions.text import is_blank
from . import lattices, reports, sampling, spelling

#: Words a spell-check request may hold.
REQUEST_WORDS = 500


def required(column: str) -> Column:
    """The column; a blank or null value raises."""
    c = F.col(column)
    return F.when(c.isNull() | is_blank(c), F.raise_error(F.lit(f"{column} is required"))).otherwise(c)


def normalize_request(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds normalized, tagged and english_words; blank texts raise."""
    found = rows.withColumn("_c", clean_pipeline(required(text)))
    return found.select(*rows.columns, "_c.normalized", "_c.tagged", "_c.english_words")


def detect_request(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("_e", detect_english(required(text))).select(*rows.columns, "_e.tagged", F.col("_e.words").alias("english_words"))


def spell_request(words: DataFrame, position: str, word: str = "word", most: int = REQUEST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(verdicts, summary) of the first `most` words."""
    results = spelling.spell_classify(words.orderBy(position).limit(most), word=word)
    return results, spelling.summary(results)


def word_sheet(words: DataFrame, position: str, word: str = "word") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, summary, most frequent reasons) of a sheet's distinct words."""
    distinct = spelling.first_seen(words.where(~is_blank(word)), word, position)
    results = spelling.spell_classify(distinct, word=word)
    return results, spelling.summary(results), spelling.top_reasons(results)


def lattice_sheet(sheet: DataFrame, utt_id: str = "utt_id", least: int = 2) -> DataFrame:
    """Model averages of a sheet with a column Human and columns 'Model *'."""
    return lattices.averages(lattices.from_wide(sheet, utt_id=utt_id), least=least)


def cleanup_pairs(sheet: DataFrame, model: str = "Model H", utt_id: str = "utt_id") -> DataFrame:
    """(utt_id, raw_asr, reference) of one model's hypotheses on a sheet."""
    return lattices.from_wide(sheet, utt_id=utt_id).where(F.col("model") == model).select("utt_id", F.col("hyp").alias("raw_asr"), "reference")


def cleanup_report(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(error rates before and after, examples)."""
    rows = reports.cleanup_rows(pairs)
    return reports.cleanup_evaluation(rows), reports.cleanup_examples(rows)


def error_report(pairs: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sampled errors, severities of all errors, effect of rewriting Roman words) of pairs (idx,
    reference, predicted)."""
    errors = sampling.error_rows(pairs)
    fix = reports.fix_evaluation(pairs.select("reference", F.col("predicted").alias("hypothesis")))
    return sampling.stratified_sample(errors, n), reports.value_counts(errors, "severity"), fix
