"""Spoken Hindi numbers.

`normalize_numbers` is exact for every input (Python integers have no bound) and runs as one Arrow
UDF. `number_value`, the value of one span of words, is a native fold; it gives null where the value
would pass 64 bits.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import DEVANAGARI_DIGITS, IDIOM_ORDER, MULTIPLIERS, ONES, literal_map
from .text import col

WINDOW = 6
#: Private-use characters that stand for idioms while numbers are read.
GUARD = 0xE000
_GUARDED = re.compile(f"[{chr(GUARD)}-{chr(GUARD + len(IDIOM_ORDER) - 1)}]").search


def protect_idioms(c: Column | str) -> Column:
    """Each idiom, also within longer words, becomes one private-use character."""
    out = col(c)
    for k, phrase in enumerate(IDIOM_ORDER):
        out = F.replace(out, F.lit(phrase), F.lit(chr(GUARD + k)))
    return out


def restore_idioms(c: Column | str) -> Column:
    out = col(c)
    for k, phrase in enumerate(IDIOM_ORDER):
        out = F.replace(out, F.lit(chr(GUARD + k)), F.lit(phrase))
    return out


def number_value(words: Column) -> Column:
    """The number an array of words stands for; null if it is none or zero. A multiplier of a thousand
    or more multiplies all that stands before it."""
    ones, multipliers = literal_map(ONES), literal_map({w: v for w, v in MULTIPLIERS.items()})

    def step(acc: Column, word: Column) -> Column:
        one = F.try_element_at(ones, word).cast("long")
        times = F.try_element_at(multipliers, word).cast("long")
        current = F.when(acc["current"] == 0, F.lit(1).cast("long")).otherwise(acc["current"])
        big = times >= 1000
        total = F.when(big, F.try_multiply(acc["total"] + current, times)).otherwise(acc["total"])
        after = F.when(one.isNotNull(), acc["current"] + one).when(big, F.lit(0).cast("long")).otherwise(F.try_multiply(current, times))
        return F.struct(F.when(one.isNotNull(), acc["total"]).otherwise(total).alias("total"), after.alias("current"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("current"))
    value = F.aggregate(words, zero, step, lambda acc: acc["total"] + acc["current"])
    return F.when(value > 0, value)


def _value(words: list[str], additive: bool = False) -> int:
    """additive: a thousand or more multiplies what stands right before it only, so that descending
    multipliers add up; otherwise it multiplies all that stands before it."""
    total = current = 0
    for w in words:
        if w in ONES:
            current += ONES[w]
            continue
        times = MULTIPLIERS[w]
        current = current or 1
        if times >= 1000:
            total, current = total + current * times if additive else (total + current) * times, 0
        else:
            current *= times
    return total + current


def spoken_to_digits(text: str, additive: bool = False) -> str:
    """Number words of a text as digits. Runs of number words are read six at a time; zero is no
    number and stays a word."""
    for k, phrase in enumerate(IDIOM_ORDER):
        if phrase in text:
            text = text.replace(phrase, chr(GUARD + k))
    words = text.translate(str.maketrans(DEVANAGARI_DIGITS, "0123456789")).split()
    out: list[str] = []
    at, n = 0, len(words)
    while at < n:
        stop = at
        while stop < n and stop - at < WINDOW and (words[stop] in ONES or words[stop] in MULTIPLIERS):
            stop += 1
        value = _value(words[at:stop], additive)
        if value:
            out.append(str(value))
            at = stop
        else:
            out.append(words[at])
            at += 1
    joined = " ".join(out)
    if not _GUARDED(joined):
        return joined
    for k, phrase in enumerate(IDIOM_ORDER):
        joined = joined.replace(chr(GUARD + k), phrase)
    return joined


@F.pandas_udf(StringType())
def normalize_numbers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else spoken_to_digits(t))


@F.pandas_udf(StringType())
def normalize_numbers_composed(texts: pd.Series) -> pd.Series:
    """As normalize_numbers, of the composed text: letters with a sign apart are read as well."""
    import unicodedata

    return texts.map(lambda t: None if t is None else spoken_to_digits(unicodedata.normalize("NFC", t)))


@F.pandas_udf(StringType())
def normalize_numbers_additive(texts: pd.Series) -> pd.Series:
    """As normalize_numbers, but 'one lakh five thousand' is 105000."""
    return texts.map(lambda t: None if t is None else spoken_to_digits(t, True))
