"""Scalar text functions: Column in, Column out, without Python except for Unicode normalization.

Blanks are the 29 code points Python's str.split() knows; Java's Unicode class lacks four of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"[\s\x1c-\x1f]"
SOLID = r"[^\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Words between blanks; a blank text has none."""
    return F.filter(F.split(col(c), f"(?U){BLANK}+"), lambda t: t != "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U)^{BLANK}+|{BLANK}+\\z", "")


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(f"(?U){SOLID}")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition. Spark has no function for it; texts that are composed pass as they are."""
    import unicodedata

    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def clean_transcript(c: Column | str) -> Column:
    """Drops direction and zero-width marks, composes, makes blanks single, then deletes ASCII
    punctuation and strips. Blanks that stood around punctuation stay double."""
    visible = nfc(F.regexp_replace(col(c), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", ""))
    return strip(F.regexp_replace(F.regexp_replace(visible, f"(?U){BLANK}+", " "), r"[!-/:-@\[-`{-~]", ""))


def _share(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", "")) / F.greatest(F.length(c), F.lit(1))


def devanagari_share(c: Column | str) -> Column:
    """Devanagari letters, signs and spaces among all characters of a text."""
    return _share(col(c), r"\x{0900}-\x{097F} ")


def is_devanagari_text(c: Column | str, least: float = 0.70) -> Column:
    return devanagari_share(c) >= least


def devanagari_ratio(c: Column | str) -> Column:
    """Devanagari characters among all characters of a word; 0 for the empty word."""
    return _share(col(c), r"\x{0900}-\x{097F}")


def is_devanagari_token(c: Column | str) -> Column:
    return devanagari_ratio(c) > 0.3


def is_roman_word(c: Column | str) -> Column:
    """More than 0.6 of all characters are ASCII letters."""
    return _share(col(c), "A-Za-z") > 0.6


#: A letter beyond Latin-1.
FOREIGN = r"[\p{L}&&[^\x{0000}-\x{00FF}]]"


def is_latin_token(c: Column | str) -> Column:
    """More than half of the letters are Latin-1; no letters: false. Only tokens with other letters
    need their letters counted."""
    letters = F.regexp_replace(col(c), r"\P{L}", "")
    latin = F.regexp_replace(letters, r"[^\x{0000}-\x{00FF}]", "")
    return F.when(col(c).rlike(FOREIGN), F.length(latin) * 2 > F.length(letters)).otherwise(col(c).rlike(r"\p{L}"))


def has_ascii_letter(c: Column | str) -> Column:
    return col(c).rlike("[A-Za-z]")


def is_number(c: Column | str) -> Column:
    return col(c).rlike(r"(?U)^\d+([.,]\d+)?$")


def is_punctuation(c: Column | str) -> Column:
    """No letter or digit; so is the empty token."""
    return ~col(c).rlike(r"[\p{L}\p{N}]")


def is_numeral(c: Column | str) -> Column:
    return col(c).rlike(r"(?U)^\d+$")


def ascii_digits(c: Column | str) -> Column:
    from .lexicons import DEVANAGARI_DIGITS

    return F.translate(col(c), DEVANAGARI_DIGITS, "0123456789")


def percent(part: Column, whole: Column) -> Column:
    return part / whole * 100


def round_even(c: Column | str, digits: int) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(col(c), digits)


def title_id(c: Column | str) -> Column:
    """Underscores become blanks, and every run of letters gets a capital and small letters."""
    runs = F.regexp_extract_all(F.replace(col(c), F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def reason_prefix(c: Column | str) -> Column:
    """What stands before the first ';'; 'unspecified' for nothing or null."""
    head = strip(F.substring_index(F.coalesce(col(c), F.lit("")), ";", 1))
    return F.when(head == "", "unspecified").otherwise(head)
