"""English words within Hindi text: tagging, and rewriting in Devanagari."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import IDIOMS, TO_DEVANAGARI, literal_array, literal_map
from .numbers import normalize_numbers, normalize_numbers_composed
from .text import BLANK, FOREIGN, SOLID, col, is_latin_token, is_roman_word, tokens

OPEN, CLOSE = "[EN]", "[/EN]"


#: A word with a letter, entered at its start only.
LETTERED = rf"(?U)(?<!{SOLID})[^\s\x1c-\x1f\p{{L}}]*+\p{{L}}{SOLID}*+"


def is_english_token(t: Column) -> Column:
    """A token that is to be tagged: mostly Latin letters. Blanks, punctuation and numbers have none,
    and the loanwords that stay as they are have Devanagari ones."""
    return is_latin_token(t)


def detect_english(c: Column | str) -> Column:
    """Struct (tagged, words). Blanks stay as they are; punctuation at a word is tagged with it.

    In a text without letters beyond Latin-1 the words with a letter are the English ones, which one
    pattern finds; other texts are read token by token."""
    c = col(c)
    parts = F.regexp_extract_all(c, F.lit(f"(?U)({BLANK}+|{SOLID}+)"), F.lit(1))
    read = F.transform(parts, lambda t: F.struct(t.alias("t"), is_english_token(t).alias("english")))

    def tagged(all_: Column) -> Column:
        joined = F.array_join(F.transform(all_, lambda x: F.when(x["english"], F.concat(F.lit(OPEN), x["t"], F.lit(CLOSE))).otherwise(x["t"])), "")
        return F.struct(joined.alias("tagged"), F.transform(F.filter(all_, lambda x: x["english"]), lambda x: x["t"]).alias("words"))

    # As the one element of an array, the tokens are read once for both fields.
    slow = F.element_at(F.transform(F.array(read), tagged), 1)
    fast = F.struct(F.regexp_replace(c, f"({LETTERED})", r"\[EN\]$1\[/EN\]").alias("tagged"), F.regexp_extract_all(c, F.lit(f"({LETTERED})"), F.lit(1)).alias("words"))
    return F.when(c.rlike(FOREIGN), slow).when(c.isNotNull(), fast).otherwise(F.struct(F.lit(None).cast("string").alias("tagged"), F.lit(None).cast("array<string>").alias("words")))


def strip_tags(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))


def clean_pipeline(c: Column | str, compose: bool = False) -> Column:
    """Struct (original, normalized, tagged, english_words). compose: numbers are read in the composed
    text; otherwise a word whose letters and signs stand apart is no number."""
    normal = (normalize_numbers_composed if compose else normalize_numbers)(col(c))
    found = detect_english(normal)
    return F.struct(col(c).alias("original"), normal.alias("normalized"), found["tagged"].alias("tagged"), found["words"].alias("english_words"))


def transliterate_word(c: Column | str) -> Column:
    """The usual Devanagari spelling of a known English word; other words as they are."""
    return F.coalesce(F.try_element_at(literal_map(TO_DEVANAGARI), F.lower(col(c))), col(c))


def roman_to_devanagari(c: Column | str) -> Column:
    """A text with its known Roman words rewritten; blanks become single."""
    return F.array_join(F.transform(tokens(c), lambda t: F.when(is_roman_word(t), transliterate_word(t)).otherwise(t)), " ")


def is_code_mixed(c: Column | str) -> Column:
    return F.exists(tokens(c), is_roman_word)


def has_idiom(c: Column | str) -> Column:
    return F.exists(literal_array(IDIOMS), lambda p: F.contains(col(c), p))
