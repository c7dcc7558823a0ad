"""Edit distances and error rates.

token_distance() is native: it maps each distinct token of a pair to one character and uses the built-in
levenshtein. wer_edits() and what is built on it run in Python, with a bit a token.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .lattice import distance
from .text import col, round_even, tokens

#: First of the characters that stand for tokens, and how many there are before the surrogates.
BASE, ROOM = 0x4E00, 0xD800 - 0x4E00 - 1


def _as_characters(words: Column, vocabulary: Column) -> Column:
    char = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + BASE), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(words, char), "")


def token_distance(left: Column, right: Column) -> Column:
    """Fewest substitutions, deletions and insertions between two token arrays. Raises beyond ROOM
    distinct tokens a pair."""
    # As fields of a one-row array, the sides and their vocabulary are worked out once a pair; within
    # a lambda they would be worked out again for every token.
    both = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), F.array_distinct(F.concat(p["l"], p["r"])).alias("v")))

    def distance(p: Column) -> Column:
        fits = F.when(F.size(p["v"]) > ROOM, F.raise_error(F.lit("too many distinct tokens in a pair")).cast("int"))
        return F.coalesce(fits, F.levenshtein(_as_characters(p["l"], p["v"]), _as_characters(p["r"], p["v"])))

    return F.element_at(F.transform(both, distance), 1)


@F.pandas_udf(IntegerType())
def _edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else distance(r.split(), h.split()) for r, h in zip(reference, hypothesis)], dtype="Int32")


def wer_edits(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word edits of a pair, tokens as they are. Each token is a bit here, where token_distance() looks it
    up among all of the pair."""
    return _edits(col(reference), col(hypothesis))


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Word error rate of a pair in percent; null for an empty reference."""
    n = F.size(tokens(reference))
    return F.when(n > 0, wer_edits(reference, hypothesis) / n * 100)


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Character error rate in percent, by code points; null for an empty reference."""
    r, h = col(reference), col(hypothesis)
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r) * 100)


@F.pandas_udf(StructType([StructField("reference", StringType()), StructField("hypothesis", StringType())]))
def _comparable(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Both texts, lower-cased and composed, with one character for each distinct token of the pair."""
    import unicodedata

    rows = []
    for pair in zip(reference, hypothesis):
        numbers: dict[str, int] = {}
        sides = [None if t is None else [numbers.setdefault(w, len(numbers)) for w in unicodedata.normalize("NFC", t).lower().split()] for t in pair]
        if len(numbers) > ROOM:
            raise ValueError("too many distinct tokens in a pair")
        rows.append([None if side is None else "".join(chr(BASE + k) for k in side) for side in sides])
    return pd.DataFrame(rows, columns=["reference", "hypothesis"], dtype=object)


def standard_wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Lower-cased, composed, rounded to two digits. An empty reference gives 1.0, or 0.0 if the
    hypothesis is empty too."""
    pair = _comparable(col(reference), col(hypothesis))
    n = F.length(pair["reference"])
    empty = F.when(F.length(pair["hypothesis"]) > 0, 1.0).otherwise(0.0)
    return F.when(n == 0, empty).otherwise(round_even(F.levenshtein(pair["reference"], pair["hypothesis"]) / n * 100, 2))


def corpus_wer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Aggregate: all edits over all reference words, in percent."""
    words = F.sum(F.size(tokens(reference)))
    return F.when(words > 0, F.sum(wer_edits(reference, hypothesis)) / words * 100)


def relative_reduction(before: Column, after: Column) -> Column:
    return F.when(before != 0, (before - after) / before * 100).otherwise(F.lit(0.0))
