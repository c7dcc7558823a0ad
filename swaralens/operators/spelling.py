"""Spelling over tables of words: classification, character models, reviews and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spell import classify, normal_word, signals
from ..functions.text import nfc, reason_prefix, round_even, strip, tokens


def _neighbours(word: str) -> Column:
    """(prev, char) of each character of a word but the first, one row each; one null row for others. A
    filter on the composed word would compose it twice."""
    at = F.sequence(F.lit(2), F.length(word))
    pairs = F.transform(at, lambda k: F.struct(F.substr(word, k - 1, F.lit(1)).alias("prev"), F.substr(word, k, F.lit(1)).alias("char")))
    return F.explode_outer(F.when(F.length(word) > 1, pairs))


def word_counts(corpus: DataFrame, column: str = "line") -> DataFrame:
    """(w, n): the composed words of a corpus. Words are counted before Python composes them, so it sees
    each once."""
    counts = corpus.select(F.explode(tokens(column)).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return counts.select(nfc("raw").alias("w"), "n")


def char_counts(corpus: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(char, n) and (prev, char, n): characters and neighbours within the words of a corpus."""
    words = word_counts(corpus, column)
    at = F.sequence(F.lit(1), F.length("w"))
    single = words.select(F.explode(F.transform(at, lambda k: F.substr("w", k, F.lit(1)))).alias("char"), "n")
    pairs = words.select(_neighbours("w").alias("p"), "n").where("p is not null")
    return single.groupBy("char").agg(F.sum("n").alias("n")), pairs.select("p.*", "n").groupBy("prev", "char").agg(F.sum("n").alias("n"))


def bigram_scores(words: DataFrame, unigrams: DataFrame, bigrams: DataFrame, word: str = "word") -> DataFrame:
    """(word, bigram_score): the mean log probability of a word's character pairs, add-one smoothed.
    Words of one character score 0.0."""
    size = unigrams.agg(F.count("*").alias("v"))
    distinct = words.select(F.col(word).alias("word")).distinct()
    normal = distinct.select("word", nfc("word").alias("w"))
    pairs = normal.select("word", _neighbours("w").alias("p")).where("p is not null").select("word", "p.*")
    u = unigrams.select(F.col("char").alias("prev"), F.col("n").alias("u"))
    b = bigrams.select("prev", "char", F.col("n").alias("b"))
    counted = pairs.join(u, "prev", "left").join(b, ["prev", "char"], "left").crossJoin(size)  # one row
    logs = F.ln((F.coalesce("b", F.lit(0)) + 1) / (F.coalesce("u", F.lit(0)) + F.col("v") + 1))
    scored = counted.groupBy("word").agg(F.avg(logs).alias("bigram_score"))
    return distinct.join(scored, "word", "left").select("word", F.coalesce("bigram_score", F.lit(0.0)).alias("bigram_score"))


def spell_classify(words: DataFrame, wordlist: DataFrame | None = None, dictionary: DataFrame | None = None, corpus: DataFrame | None = None, word: str = "word", with_signals: bool = False) -> DataFrame:
    """Adds verdict, confidence and reason to a table of words, without removing repeats.

    wordlist (word) is taken as it is written; dictionary (word) decides both ways; corpus (line)
    gives a character model. Each is joined on the normal word.
    """
    out = words.withColumn("normal", normal_word(word))
    listed = known = likely = None
    if wordlist is not None:
        out = out.join(wordlist.select(strip("word").alias("normal"), F.lit(True).alias("listed")).where("normal <> ''").distinct(), "normal", "left")
        listed = F.coalesce("listed", F.lit(False))
    if dictionary is not None:
        out = out.join(dictionary.select(normal_word("word").alias("normal"), F.lit(True).alias("known")).distinct(), "normal", "left")
        known = F.coalesce("known", F.lit(False))
    if corpus is not None:
        scores = bigram_scores(out.select(F.col("normal").alias("word")), *char_counts(corpus))
        out = out.join(scores.withColumnRenamed("word", "normal"), "normal", "left")
        likely = F.col("bigram_score") > -4.0
    none = F.lit(None).cast("boolean")
    out = out.withColumn("judged", classify("normal", listed, known, likely))
    if with_signals:
        early = (F.length("normal") < 2) | F.col("normal").rlike(r"(?U)^\d+$")
        given = signals(F.col("normal"), listed if listed is not None else F.lit(False), known if known is not None else none, likely if likely is not None else none)
        out = out.withColumn("signals", F.when(early, F.create_map().cast("map<string,boolean>")).otherwise(given))
    keep = [*words.columns, *(["signals"] if with_signals else [])]
    return out.select(*keep, "judged.*")


def summary(results: DataFrame) -> DataFrame:
    """One row of counts by verdict and confidence."""
    count = lambda c: F.count_if(F.expr(c))
    return results.agg(
        F.count("*").alias("total"), count("verdict = 'correct spelling'").alias("correct"), count("verdict = 'incorrect spelling'").alias("incorrect"),
        count("confidence = 'high'").alias("high"), count("confidence = 'medium'").alias("medium"), count("confidence = 'low'").alias("low"),
    )


def review_accuracy(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewed words (word, true_verdict) against results: matches, reviewed and accuracy in percent."""
    joined = reviewed.join(results.select("word", "verdict"), "word")
    n, right = F.count("*"), F.count_if(F.col("verdict") == F.col("true_verdict"))
    return joined.agg(n.alias("reviewed"), right.alias("matches")).withColumn("accuracy", F.when(F.col("reviewed") > 0, round_even(F.col("matches") * 100 / F.col("reviewed"), 2)))


def top_reasons(results: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent reasons, by what stands before a ';', over all rows; ties by text."""
    return results.groupBy(reason_prefix("reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def low_confidence(results: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    from .sampling import hash_sample

    return hash_sample(results.where("confidence = 'low'"), "word", n, seed)


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, at its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def first_rows(rows: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
