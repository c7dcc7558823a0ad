"""Rule-based spelling verdicts of Hindi words, as one native decision list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import INVALID_WORD, LOAN_SPELLINGS, MATRAS, SUFFIXES, VIRAMA, literal_array
from .text import col, devanagari_ratio, has_ascii_letter, is_numeral, nfc, strip

CORRECT, INCORRECT = "correct spelling", "incorrect spelling"
HIGH, MEDIUM, LOW = "high", "medium", "low"


def has_invalid_sequence(word: Column) -> Column:
    return word.rlike(INVALID_WORD)


def has_bad_virama(word: Column) -> Column:
    """A virama at the end, or before a vowel sign or another virama. The word must be composed."""
    return word.rlike(f"{VIRAMA}(\\z|[{MATRAS}{VIRAMA}])")


def has_suffix(word: Column) -> Column:
    return F.exists(literal_array(SUFFIXES), lambda s: F.endswith(word, s))


def in_loanwords(word: Column) -> Column:
    return F.array_contains(literal_array(LOAN_SPELLINGS), word)


def _result(verdict: str, confidence: str, reason: Column | str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def normal_word(c: Column | str) -> Column:
    return nfc(strip(c))


def signals(word: Column, in_wordlist: Column, in_dictionary: Column, bigram_ok: Column) -> Column:
    """Map of the signals; null where a source was not given."""
    pairs = {
        "no_roman_chars": ~has_ascii_letter(word), "no_invalid_deva_seq": ~has_invalid_sequence(word), "devanagari_dominant": devanagari_ratio(word) >= 0.70,
        "in_loanword_list": in_loanwords(word), "in_custom_wordlist": in_wordlist, "enchant_ok": in_dictionary, "has_valid_suffix": has_suffix(word),
        "virama_position_ok": ~has_bad_virama(word), "min_length_ok": F.length(word) >= 2, "bigram_plausible": bigram_ok,
    }
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))


def classify(word: Column | str, in_wordlist: Column | None = None, in_dictionary: Column | None = None, bigram_ok: Column | None = None) -> Column:
    """Struct (verdict, confidence, reason) of a normal_word(). The three further signals are optional
    boolean columns; a null one has no say."""
    word = col(word)
    none = F.lit(None).cast("boolean")
    listed, known, likely = (x if x is not None else none for x in (in_wordlist, in_dictionary, bigram_ok))
    score = (
        F.when(devanagari_ratio(word) >= 0.70, 2).otherwise(-2)
        + F.when(has_suffix(word), 1).otherwise(0)
        + F.when(~known, -2).otherwise(0)
        + F.when(likely, 1).when(~likely, -1).otherwise(0)
    )

    def told(text: str, end: str = "") -> Column:
        return F.concat(F.lit(f"{text} (score="), score.cast("string"), F.lit(f"){end}"))

    return (
        F.when(word == "", _result(INCORRECT, HIGH, "Empty string"))
        .when(is_numeral(word), _result(CORRECT, HIGH, "Pure numeral — not a spelling check target"))
        .when((F.length(word) == 1) & word.rlike(r"^[\x{0900}-\x{097F}]"), _result(CORRECT, LOW, "Single Devanagari char — likely abbreviation"))
        .when(F.length(word) == 1, _result(INCORRECT, LOW, "Single non-Devanagari char"))
        .when(has_ascii_letter(word), _result(INCORRECT, HIGH, "Contains Roman/ASCII letters — not valid Devanagari"))
        .when(has_invalid_sequence(word), _result(INCORRECT, HIGH, "Invalid Devanagari character sequence detected"))
        .when(has_bad_virama(word), _result(INCORRECT, HIGH, "Virama (halant) in illegal position"))
        .when(in_loanwords(word), _result(CORRECT, HIGH, "Matches known correct Devanagari loanword transliteration"))
        .when(listed, _result(CORRECT, HIGH, "Found in verified Hindi wordlist"))
        .when(known, _result(CORRECT, HIGH, "Validated by Hunspell Hindi dictionary"))
        .when(score >= 3, _result(CORRECT, HIGH, told("Strong positive signals")))
        .when(score >= 1, _result(CORRECT, MEDIUM, told("Moderate positive signals")))
        .when(score == 0, _result(INCORRECT, LOW, told("Balanced/conflicting signals", " — ambiguous")))
        .when(score >= -2, _result(INCORRECT, MEDIUM, told("Negative signals dominate")))
        .otherwise(_result(INCORRECT, HIGH, told("Strong negative signals")))
    )
